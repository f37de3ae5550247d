"""DuckDB statements of the trie, the spelling variants and the licence scan."""

from __future__ import annotations

from docsieve.llm.license_scan import ANCHORS, BAND, LEAST, template_words
from docsieve.llm.licenses import BASE_PHRASES, NOTICES

#: The table of the reflected CRC-32, a value per byte.
_CRC = """
crc_table AS MATERIALIZED (
    SELECT n, list_reduce(generate_series(1, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END,
                          n) AS v FROM range(256) t(n))"""

PREFIX_TRIE = f"""
WITH RECURSIVE {_CRC},
turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(
               't' || length(r) || ':' || r || x)) AS place, sha256(length(r) || ':' || r || x) AS id, length(x) AS chars
    FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
          WHERE conv_id IS NOT NULL)),
crc AS (
    SELECT conv_id, conv_id::VARCHAR AS s, 1 AS i, 4294967295::BIGINT AS v FROM (SELECT DISTINCT conv_id FROM turns)
    UNION ALL
    SELECT conv_id, s, i + 1, xor(crc.v >> 8, crc_table.v) FROM crc
    JOIN crc_table ON crc_table.n = xor(crc.v & 255, ascii(s[i])) WHERE i <= length(s)),
plan AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(v, 4294967295) % 6 AS h FROM crc WHERE i = length(s) + 1),
rebuilt AS (
    SELECT p.conv_id, place, id, chars FROM plan p JOIN turns t ON t.conv_id = p.base WHERE place <= h
    UNION ALL SELECT p.conv_id, h + place, id, chars FROM plan p JOIN turns t ON t.conv_id = p.conv_id WHERE place > h),
whole AS (
    SELECT conv_id, coalesce(list(id ORDER BY place) FILTER (id IS NOT NULL), []) AS ids,
           coalesce(list(chars ORDER BY place) FILTER (id IS NOT NULL), []) AS chars
    FROM plan LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id),
prefixes AS (
    SELECT conv_id, d, sha256(array_to_string(ids[1:d], ',')) AS key, len(ids) AS n, coalesce(chars[d], 0) AS chars,
           CASE WHEN d > 0 THEN sha256(array_to_string(ids[1:d - 1], ',')) END AS above
    FROM (SELECT *, unnest(generate_series(0, len(ids))) AS d FROM whole)),
nodes AS (
    SELECT d, key, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
    FROM prefixes GROUP BY d, key),
children AS (SELECT d - 1 AS d, above AS key, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (
    SELECT p.d, p.key, sum((n.n_convs - 1) * n.chars) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
    FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.d <= n.d
    LEFT JOIN children c ON c.key = n.key AND c.d = n.d GROUP BY p.d, p.key)
SELECT n.conv_id, n.d::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
       b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes u ON u.d = n.d - 1 AND u.key = n.above
LEFT JOIN children c ON c.d = n.d AND c.key = n.key JOIN below b ON b.d = n.d AND b.key = n.key"""

SPELLING_VARIANTS = rf"""
WITH RECURSIVE {_CRC},
runs AS (
    SELECT doc_id, run, count(*) AS k FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY doc_id, run),
spelled AS MATERIALIZED (
    SELECT doc_id, run, k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hexed FROM runs),
crc AS (
    SELECT doc_id, run, k, hexed, 0 AS i, 4294967295::BIGINT AS v FROM spelled
    UNION ALL
    SELECT doc_id, run, k, hexed, i + 1, xor(crc.v >> 8, crc_table.v) FROM crc
    JOIN crc_table ON crc_table.n = xor(crc.v & 255, ('0x' || substr(hexed, 2 * i + 1, 2))::BIGINT)
    WHERE i < length(hexed) // 2),
hashed AS (SELECT run, k, xor(v, 4294967295) AS h FROM crc WHERE i = length(hexed) // 2),
words AS MATERIALIZED (
    SELECT word, sum(k)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
               ELSE run END AS word, k FROM hashed)
    WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
places AS (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM words),
replaced AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS key FROM places),
shorter AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS key FROM places),
near AS (
    SELECT a.word, b.word AS other, b.n AS m FROM replaced a JOIN replaced b ON a.key = b.key AND a.word <> b.word
    UNION SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON w.word = s.key
    UNION SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON w.word = s.key),
ranked AS (
    SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near,
           row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS r FROM near),
forms AS MATERIALIZED (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form,
           CASE WHEN m >= 2 * w.n THEN m END AS form_n
    FROM words w LEFT JOIN ranked r ON r.word = w.word AND r = 1),
ways AS (
    SELECT word, word AS root FROM forms
    UNION ALL SELECT ways.word, forms.form FROM ways JOIN forms ON forms.word = ways.root WHERE forms.form IS NOT NULL),
ends AS (SELECT ways.word, root FROM ways JOIN forms f ON f.word = root WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e USING (word)"""


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_TEMPLATES = ", ".join(f"({t}, '{n.label}', {_quoted(template_words(n.text))})" for t, n in enumerate(NOTICES))
_MANDATORY = ", ".join(f"({t}, {j}, {_quoted(p.split())})" for t, n in enumerate(NOTICES)
                       for j, p in enumerate(n.mandatory))
_BASE = ", ".join(f"({_quoted(p.split())}, '{label}')" for p, label in BASE_PHRASES)

LICENSE_SCAN = rf"""
WITH docs AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
templates(t, label, w) AS (VALUES {_TEMPLATES}),
base(phrase, label) AS (VALUES {_BASE}),
mandatory(t, j, phrase) AS (VALUES {_MANDATORY}),
known AS (SELECT DISTINCT unnest(w) AS word FROM templates UNION SELECT unnest(phrase) FROM base),
spots AS MATERIALIZED (
    SELECT r, i - 1 AS place, word FROM (
        SELECT r, unnest(generate_series(1, len(w))) AS i, unnest(w) AS word FROM docs) SEMI JOIN known USING (word)),
weights AS (
    SELECT word, greatest(1, length(ltrim(((SELECT count(*) FROM docs) // greatest(count(DISTINCT r), 1))::BIT::VARCHAR,
                                          '0'))) AS weight
    FROM known LEFT JOIN spots USING (word) GROUP BY word),
inside AS (
    SELECT t, i - 1 AS at_word, word, weight FROM (
        SELECT t, unnest(generate_series(1, len(w))) AS i, unnest(w) AS word FROM templates) JOIN weights USING (word)),
anchors AS (
    SELECT t, word FROM (SELECT DISTINCT t, word, weight FROM inside)
    QUALIFY row_number() OVER (PARTITION BY t ORDER BY weight DESC, word) <= {ANCHORS}),
postings AS (SELECT * FROM inside SEMI JOIN anchors USING (t, word)),
totals AS (SELECT t, sum(weight) AS total FROM postings GROUP BY t),
phrase_spots AS (
    SELECT t, j, phrase, len(phrase) AS n FROM mandatory
    UNION ALL SELECT NULL, row_number() OVER (), phrase, len(phrase) FROM base),
said AS (
    SELECT s.r, p.t, p.j, p.phrase, s.place FROM spots s JOIN phrase_spots p ON p.phrase[1] = s.word
    JOIN docs d ON d.r = s.r AND d.w[s.place + 1:s.place + p.n] = p.phrase),
own AS (
    SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
           string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels, list(DISTINCT label) AS names
    FROM said JOIN base USING (phrase) WHERE t IS NULL GROUP BY r),
begins AS (
    SELECT m.t, j, min(i - 1) AS at_word FROM mandatory m JOIN (
        SELECT t, w, unnest(generate_series(1, len(w))) AS i FROM templates) x
    ON x.t = m.t AND x.w[i:i + len(phrase) - 1] = phrase GROUP BY m.t, j),
shifts AS (
    SELECT r, t, at_word, place - at_word AS shift, weight, NULL AS j FROM spots JOIN postings USING (word)
    UNION ALL SELECT r, t, at_word, place - at_word, 0, j FROM said JOIN begins USING (t, j)),
bands AS (
    SELECT r, t, grid, floor((shift + grid * {BAND // 2}) / {BAND}) AS band, at_word, j, max(weight) AS weight
    FROM shifts, (VALUES (0), (1)) g(grid) GROUP BY ALL),
shares AS (
    SELECT r, t, sum(weight) AS weight, count(j) AS n FROM bands GROUP BY r, t, grid, band),
found AS (
    SELECT r, list(DISTINCT label) AS names, max(weight / total) AS share
    FROM shares JOIN totals USING (t) JOIN templates USING (t)
    WHERE n = (SELECT count(*) FROM mandatory m WHERE m.t = shares.t) AND {LEAST[1]} * weight >= {LEAST[0]} * total
    GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(own.names, []), coalesce(found.names, [])))), ',')
           AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM docs LEFT JOIN own USING (r) LEFT JOIN found USING (r)"""
