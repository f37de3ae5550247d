"""DuckDB statements for the registered queries, built from the rule files independently of Spark."""

from __future__ import annotations

from catalog.corpus import CORPUS, ORDER_FILES, ORDER_TEXTS, RENDERED, for_duckdb
from docsieve.functions.files import (
    BLOCKED_EXTENSIONS, DOCUMENT_EXTENSIONS, SUPPORTED_MIME_TYPES)
from docsieve.functions.markup import HTML_STEPS
from docsieve.functions.regex import PY_WHITESPACE
from docsieve.operators.fallback import PROMPT_CHARS, PROMPT_PARTS
from docsieve.operators.redact import load_privacy_rules
from docsieve.plans.process import NO_TEXT
from docsieve.rules import load_rules

RULES = load_rules()
PRIVACY = load_privacy_rules()


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(values) -> str:
    return "[" + ", ".join(map(q, values)) + "]::VARCHAR[]"


def _score_branch(ordinal: int, c) -> str:
    hit = "lambda k: contains(low, k)"
    return f"""SELECT doc_id, {ordinal} AS ordinal, {q(c.slug)} AS category,
  CAST({c.threshold} AS DOUBLE) AS threshold, {c.min_primary} AS min_primary,
  list_filter({words(c.primary)}, {hit}) AS p, list_filter({words(c.secondary)}, {hit}) AS s,
  len(list_filter({words(c.exclusion)}, {hit})) > 0 AS x,
  {c.primary_weight} AS pw, {c.secondary_weight} AS sw, CAST({c.max_score} AS DOUBLE) AS top FROM low"""


def scoring(source: str) -> str:
    """CTEs: ``docs``, ``scores`` with one row per document and category, ``best``, ``decided``."""
    branches = "\nUNION ALL ".join(_score_branch(i, c) for i, c in enumerate(RULES))
    return f"""WITH docs AS MATERIALIZED ({for_duckdb(source)}),
low AS MATERIALIZED (SELECT doc_id, lower(text) AS low FROM docs),
hits AS ({branches}),
scores AS MATERIALIZED (SELECT doc_id, ordinal, category, threshold, len(p) AS n_primary,
  CASE WHEN len(p) < min_primary THEN 0 ELSE len(s) END AS n_secondary,
  len(p) >= min_primary AND x AS excluded,
  CASE WHEN len(p) < min_primary THEN [] ELSE list_concat(p, s) END AS matched,
  CASE WHEN len(p) < min_primary THEN 0.0::DOUBLE
    WHEN x THEN (len(p) * pw + len(s) * sw) / top * 0.3::DOUBLE
    ELSE (len(p) * pw + len(s) * sw) / top END AS confidence FROM hits),
best AS (SELECT * FROM scores WHERE confidence > 0
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, ordinal) = 1),
decided AS MATERIALIZED (SELECT d.*, coalesce(b.confidence, 0.0) AS confidence,
  coalesce(b.matched, []) AS matched,
  coalesce(b.confidence >= b.threshold, false) AS accepted,
  CASE WHEN b.confidence >= b.threshold THEN b.category ELSE 'unclassified' END AS category,
  CASE WHEN b.confidence >= b.threshold THEN 'deterministic' ELSE 'unclassified' END AS method,
  CASE WHEN b.category IS NULL THEN 'No categories available for scoring'
    WHEN b.confidence < b.threshold THEN 'Best match ''' || b.category || ''' scored '
      || printf('%.4f', b.confidence) || ' but threshold is ' || printf('%.2f', b.threshold) END AS reason
  FROM docs d LEFT JOIN best b USING (doc_id))
"""


def _field_branch(c, p) -> str:
    strip = q(PY_WHITESPACE)
    return (f"SELECT doc_id, category, {q(p.field)} AS field, "
            f"trim(regexp_extract(text, {q('(?i)' + p.pattern)}, {p.group}), {strip}) AS value "
            f"FROM decided WHERE category = {q(c.slug)}")


def fields(source: str) -> str:
    branches = "\nUNION ALL ".join(_field_branch(c, p) for c in RULES for p in c.patterns)
    return scoring(source) + f", found AS MATERIALIZED (SELECT * FROM ({branches}) f WHERE value <> '')\n"


def validation(source: str) -> str:
    """Adds ``checked``: status and ordered errors per document."""
    need = ", ".join(f"({q(c.slug)}, {i}, {q(f)})" for c in RULES for i, f in enumerate(c.mandatory))
    return fields(source) + f""",
need AS (SELECT * FROM (VALUES {need}) v(category, pos, field)),
missing AS MATERIALIZED (SELECT d.doc_id, n.category, n.pos, n.field FROM decided d JOIN need n ON n.category = d.category
  LEFT JOIN found f ON f.doc_id = d.doc_id AND f.field = n.field WHERE f.field IS NULL),
errors AS (SELECT doc_id, string_agg('Missing mandatory field: ''' || field || '''', '|' ORDER BY pos) AS errors
  FROM missing GROUP BY doc_id),
checked AS MATERIALIZED (SELECT d.*, CASE WHEN e.errors IS NULL THEN 'valid' ELSE 'partial' END AS status,
  coalesce(e.errors, '') AS errors FROM decided d LEFT JOIN errors e USING (doc_id))
"""


_OUTCOME = "CASE status WHEN 'valid' THEN 'passed' WHEN 'partial' THEN 'partial' ELSE 'failed' END"

_CLASSIFY = scoring(CORPUS)
_REVIEW = "CASE WHEN contains(text, 'Invoice Number') THEN 'invoice' ELSE expected_category END"

# Empty texts never reach the classifier in the full flow; the given tables hold none.
assert NO_TEXT

_EXTENSION = (
    "CASE WHEN regexp_matches(base, '^.+\\.[^.]+$') THEN lower(regexp_extract(base, '(\\.[^.]+)$', 1)) ELSE '' END")
_NAMED = f"""names AS (SELECT *, regexp_extract(regexp_replace(file_name, '(/\\.?)+$', ''), '([^/]*)$', 1) AS base
  FROM (SELECT * FROM ({for_duckdb(ORDER_FILES)}) o)),
files AS (SELECT *, {_EXTENSION} AS ext,
  CASE head WHEN '255044462D' THEN 'application/pdf' WHEN 'FFD8FFE0' THEN 'image/jpeg'
    WHEN '4D5A90' THEN 'application/x-msdownload' END AS mime FROM names)"""


def _in(values) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


def _html(column: str) -> str:
    for pattern, replacement in HTML_STEPS:
        column = f"regexp_replace({column}, {q(pattern)}, {q(replacement)}, 'g')"
    return f"trim({column}, {q(' ' + chr(10))})"


def _privacy_columns() -> str:
    counts = ", ".join(
        f"len(regexp_extract_all(text, {q(r.pattern)})) AS {r.label.lower()}" for r in PRIVACY)
    flags = ", ".join(f"CASE WHEN {r.label.lower()} > 0 THEN {q(r.label)} END" for r in PRIVACY)
    return f"SELECT *, concat_ws('|', {flags}) AS flags FROM (SELECT doc_id, {counts} FROM documents) c"


def _redacted() -> str:
    text = "text"
    for r in PRIVACY:
        text = f"regexp_replace({text}, {q(r.pattern)}, {q(r.mask)}, 'g')"
    return f"SELECT doc_id, {text} AS text FROM documents"


def _prompt() -> str:
    slots = (q(", ".join(sorted(RULES.slugs))), "reason", "'unclassified'", "printf('%.4f', confidence)",
             f"substr(text, 1, {PROMPT_CHARS})")
    return " || ".join(x for part, slot in zip(PROMPT_PARTS, slots) for x in (q(part), slot))


_RESOLVED = """, resolved AS (SELECT *, reason IS NOT NULL AND contains(text, 'Invoice Number') AS hit
  FROM checked)"""
_INVOICE_MANDATORY = "|".join(f"Missing mandatory field: '{f}'" for f in RULES.get("invoice").mandatory)

ORACLES = {
    "classify_best": _CLASSIFY + """SELECT doc_id, category AS document_category, method AS classification_method,
  confidence AS classification_confidence, array_to_string(matched, '|') AS matched_keywords,
  reason AS llm_escalation_reason FROM decided""",
    "score_explain": _CLASSIFY + """SELECT doc_id, category, ordinal, confidence, threshold, n_primary, n_secondary,
  excluded, array_to_string(matched, '|') AS matched_keywords FROM scores""",
    "matched_keywords": f"""WITH low AS (SELECT doc_id, lower(text) AS low FROM ({for_duckdb(CORPUS)}) c),
kw AS (SELECT * FROM (VALUES {", ".join(
        f"({q(c.slug)}, {q(tier)}, {i}, {q(k)})" for c in RULES
        for tier, ks in (("primary", c.primary), ("secondary", c.secondary), ("exclusion", c.exclusion))
        for i, k in enumerate(ks))}) v(category, tier, pos, keyword))
SELECT doc_id, category, tier, pos, keyword FROM low JOIN kw ON contains(low, keyword)""",
    "classify_relational": _CLASSIFY + """SELECT doc_id, category, confidence, threshold,
  array_to_string(matched, '|') AS matched FROM best""",
    "exclusion_penalty": _CLASSIFY + """SELECT doc_id, category, confidence, n_primary, n_secondary
FROM scores WHERE excluded""",
    "primary_guard": _CLASSIFY + """SELECT s.category, count(*) AS documents,
  count(*) FILTER (n_primary < m) AS guarded, count(*) FILTER (confidence > 0) AS scored
FROM scores s JOIN (SELECT DISTINCT category, min_primary AS m FROM hits) h USING (category) GROUP BY s.category""",
    "threshold_route": _CLASSIFY + """SELECT reason IS NOT NULL AS needs_fallback, category AS document_category,
  count(*) AS documents, max(confidence) AS top_confidence FROM decided GROUP BY ALL""",
    "escalation_reasons": _CLASSIFY + """SELECT reason AS llm_escalation_reason, count(*) AS documents
FROM decided WHERE reason IS NOT NULL GROUP BY ALL""",
    "rounded_confidence": _CLASSIFY + """SELECT doc_id, category, CAST(printf('%.4f', confidence) AS DOUBLE) AS confidence
FROM scores WHERE confidence > 0""",
    "extracted_fields": fields(CORPUS) + "SELECT doc_id, category, field, value FROM found",
    "mandatory_validation": validation(CORPUS) + """SELECT doc_id, category AS document_category,
  status AS validation_status, errors AS validation_errors FROM checked""",
    "missing_mandatory": validation(CORPUS) + "SELECT doc_id, category, field FROM missing",
    "config_lookup": _CLASSIFY + f""", dim AS (SELECT * FROM (VALUES {", ".join(
        f"({q(c.slug)}, {q(c.display_name)}, CAST({c.threshold} AS DOUBLE), {len(c.mandatory)})" for c in RULES
    )}) v(category, display_name, threshold, mandatory_fields))
SELECT d.category, display_name, threshold, mandatory_fields, count(*) AS documents
FROM decided d LEFT JOIN dim USING (category) GROUP BY ALL""",
    "known_slugs": f"""WITH p AS (SELECT doc_id, CASE WHEN starts_with(text, 'PURCHASE') THEN 'purchase_order'
  ELSE lower(regexp_extract(text, '^([A-Za-z]+)', 1)) END AS category FROM ({for_duckdb(RENDERED)}) r)
SELECT doc_id, category FROM p WHERE category IN {_in(RULES.slugs)}""",
    "record_checks": """SELECT CAST(o_orderkey AS VARCHAR) AS document_id, concat_ws('|',
  CASE WHEN NOT (o_totalprice / 400000.0::DOUBLE BETWEEN 0 AND 1) THEN 'confidence_score' END,
  CASE WHEN o_orderstatus NOT IN ('F', 'P') THEN 'validation_outcome' END) AS record_violations FROM orders""",
    "file_extensions": f"""WITH both_names AS (SELECT doc_id, file_name FROM ({for_duckdb(ORDER_FILES)}) o
  UNION ALL SELECT 'page-' || page_id, url FROM pages),
names AS (SELECT doc_id, regexp_extract(regexp_replace(file_name, '(/\\.?)+$', ''), '([^/]*)$', 1) AS base FROM both_names),
ext AS (SELECT doc_id, {_EXTENSION} AS extension FROM names)
SELECT doc_id, extension, extension IN {_in(DOCUMENT_EXTENSIONS)} AS watched FROM ext""",
    "mime_types": f"WITH {_NAMED} SELECT doc_id, mime FROM files",
    "file_gate": f"""WITH {_NAMED} SELECT doc_id, CASE WHEN head = '' THEN 'No file bytes provided for ''' || file_name || ''''
  WHEN ext IN {_in(BLOCKED_EXTENSIONS)} THEN 'File rejected: dangerous extension ''' || ext || ''' is not allowed'
  WHEN ext IN {_in(DOCUMENT_EXTENSIONS)} THEN NULL
  WHEN mime IS NULL THEN 'File rejected: unknown extension ''' || ext || ''' and content type could not be determined'
  WHEN mime IN {_in(SUPPORTED_MIME_TYPES)} THEN NULL
  ELSE 'File rejected: unsupported content type ''' || mime || ''' (extension: ''' || ext || ''')' END AS parse_error
FROM files""",
    "file_properties": f"""WITH {_NAMED} SELECT doc_id, CAST(length(head) / 2 AS BIGINT) AS file_size_bytes,
  ext AS file_extension, mime AS mime_type,
  CASE WHEN ext = '.pdf' OR mime LIKE '%pdf%' THEN 'pdf' END AS reader FROM files""",
    "page_text": f"SELECT page_id, {_html('html')} AS text FROM pages",
    "html_parse": f"SELECT page_id, {_html('html')} AS text, CAST(NULL AS VARCHAR) AS parse_error FROM pages",
    "privacy_scan": _privacy_columns(),
    "privacy_redact": _redacted(),
    "fallback_prompt": _CLASSIFY + f"""SELECT doc_id, length(p) AS chars, md5(p) AS digest FROM (
  SELECT doc_id, {_prompt()} AS p FROM decided WHERE reason IS NOT NULL) x""",
    "fallback_replies": """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'invoice'
  WHEN '3-MEDIUM' THEN 'report' WHEN '4-NOT SPECIFIED' THEN 'resume' END AS category,
  CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 1.0::DOUBLE WHEN '1-URGENT' THEN (o_orderkey % 1000) / 1000.0::DOUBLE
    WHEN '3-MEDIUM' THEN (o_orderkey % 1000) / 1000.0::DOUBLE END AS confidence FROM orders""",
    "fallback_resolve": validation(CORPUS) + _RESOLVED + f""" SELECT doc_id,
  CASE WHEN hit THEN 'invoice' ELSE category END AS document_category,
  CASE WHEN hit THEN 'llm_fallback' ELSE method END AS classification_method,
  CASE WHEN hit THEN 0.75::DOUBLE ELSE confidence END AS classification_confidence,
  reason IS NOT NULL AND NOT hit AS llm_unavailable,
  CASE WHEN hit THEN 'partial' ELSE status END AS validation_status,
  CASE WHEN hit THEN {q(_INVOICE_MANDATORY)} ELSE errors END AS validation_errors FROM resolved""",
    "audit_log": validation(CORPUS) + f"""SELECT doc_id AS document_id, doc_id || '.pdf' AS source_filename,
  method AS extraction_method, reason AS llm_escalation_reason, reason IS NOT NULL AS llm_unavailable,
  category AS classification_result, confidence AS confidence_score, {_OUTCOME} AS validation_outcome,
  errors AS validation_errors, 0 AS processing_duration_ms FROM checked""",
    "result_payload": validation(CORPUS) + """SELECT doc_id AS document_id, doc_id || '.pdf' AS source_filename,
  category AS document_category, method AS classification_method, confidence AS classification_confidence,
  array_to_string(matched, '|') AS matched_keywords, reason AS llm_escalation_reason,
  reason IS NOT NULL AS llm_unavailable,
  coalesce((SELECT n FROM (SELECT doc_id AS id, count(*) AS n FROM found GROUP BY doc_id) k WHERE k.id = checked.doc_id), 0) AS n_fields,
  status AS validation_status, errors AS validation_errors, 0 AS processing_duration_ms FROM checked""",
    "audit_from_payload": validation(RENDERED) + f"""SELECT doc_id AS document_id, method AS extraction_method,
  category AS classification_result, CAST(printf('%.4f', confidence) AS DOUBLE) AS confidence_score,
  {_OUTCOME} AS validation_outcome FROM checked""",
    "audit_output_join": validation(RENDERED) + f"""SELECT doc_id AS document_id, category AS classification_result,
  category AS document_category, confidence AS confidence_score, {_OUTCOME} AS validation_outcome,
  status AS validation_status FROM checked""",
    "audit_integrity": """SELECT doc_id, count(DISTINCT d.doc_id) AS documents, count(l.doc_id) AS audit_entries
FROM documents d FULL JOIN labels l USING (doc_id) GROUP BY doc_id HAVING count(DISTINCT d.doc_id) <> 1 OR count(l.doc_id) <> 1""",
    "metrics": validation(CORPUS) + """SELECT count(*) AS documents,
  avg(CASE WHEN reason IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS fallback_rate,
  avg(CASE WHEN reason IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS fallback_unavailable_rate,
  avg(CASE WHEN status <> 'valid' THEN 1.0::DOUBLE ELSE 0 END) AS validation_failure_rate FROM checked""",
    "metrics_by_window": validation(RENDERED) + """SELECT
  CAST(floor(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) / 30) * 30 AS BIGINT) AS start_day,
  count(*) AS documents, avg(CASE WHEN reason IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS fallback_rate,
  avg(CASE WHEN status <> 'valid' THEN 1.0::DOUBLE ELSE 0 END) AS validation_failure_rate
FROM checked JOIN orders ON doc_id = 'order-' || o_orderkey GROUP BY 1""",
    "acceptance_eval": _CLASSIFY + """SELECT count(*) AS documents,
  avg(CASE WHEN accepted THEN 1.0::DOUBLE ELSE 0 END) AS deterministic_rate,
  avg(CASE WHEN accepted AND category = expected_category THEN 1.0::DOUBLE ELSE 0 END) AS correct_rate,
  avg(CASE WHEN accepted THEN 0 ELSE 1.0::DOUBLE END) AS fallback_rate,
  1.0::DOUBLE AS parse_rate, 1.0::DOUBLE AS completion_rate FROM decided""",
    "feedback_confusion": _CLASSIFY + f"""SELECT category AS predicted_category, {_REVIEW} AS reviewer_correct_category,
  count(*) AS documents FROM decided GROUP BY ALL""",
    "feedback_matrix": _CLASSIFY + f"""SELECT category AS predicted_category,
  """ + ", ".join(f"count(*) FILTER ({_REVIEW} = {q(s)}) AS {s}" for s in (*RULES.slugs, "unclassified")) + f""",
  count(*) FILTER (coalesce({_REVIEW}, '') NOT IN {_in((*RULES.slugs, "unclassified"))}) AS other
FROM decided GROUP BY category""",
    "generated_ids": """SELECT count(*) AS "rows", count(*) AS ids, count(*) AS audit_ids FROM documents""",
    "keyword_misfires": _CLASSIFY + f"""SELECT keyword, count(*) AS matches, count(*) FILTER (wrong) AS misfires FROM (
  SELECT unnest(matched) AS keyword, category <> {_REVIEW} AS wrong FROM decided) x GROUP BY keyword""",
    "keyword_gap": _CLASSIFY + f""", wrong AS (SELECT doc_id, {_REVIEW} AS label FROM decided WHERE category <> {_REVIEW})
SELECT label AS reviewer_correct_category, keyword, count(*) AS documents FROM (
  SELECT w.label, unnest(list_concat(h.p, h.s)) AS keyword
  FROM wrong w JOIN hits h ON h.doc_id = w.doc_id AND h.category = w.label) x GROUP BY ALL""",
    "end_to_end": f"""WITH docs AS ({for_duckdb(ORDER_TEXTS)})
SELECT doc_id AS document_id, 'INV-' || substr(doc_id, 7) AS invoice_number,
  strftime(o_orderdate, '%d/%m/%Y') AS invoice_date, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS total_amount,
  51 / 73.0::DOUBLE AS classification_confidence, 'valid' AS validation_status
FROM docs JOIN orders ON doc_id = 'order-' || o_orderkey WHERE o_orderpriority = '1-URGENT'""",
    "stream_ingest": validation(ORDER_TEXTS) + f"""SELECT doc_id AS document_id, category AS document_category,
  method AS extraction_method, confidence AS confidence_score, status AS validation_status,
  {_OUTCOME} AS validation_outcome FROM checked""",
}
ORACLES["branch_merge"] = ORACLES["fallback_resolve"]
ORACLES["feedback_sink"] = ORACLES["feedback_confusion"]
ORACLES["audit_csv"] = validation(RENDERED) + f"""SELECT doc_id AS document_id, method AS extraction_method,
  category AS classification_result, {_OUTCOME} AS validation_outcome, errors AS validation_errors FROM checked"""
ORACLES["failed_documents"] = """SELECT CAST(o_orderkey AS VARCHAR) AS document_id, 'unclassified' AS extraction_method,
  'unclassified' AS classification_result, 0.0::DOUBLE AS confidence_score, 'failed' AS validation_outcome,
  CASE WHEN o_orderkey % 10 IN (0, 4, 7, 8) THEN 'upstream ' || o_orderstatus
    ELSE 'No parsed Markdown available for classification' END AS validation_errors
FROM orders WHERE o_orderkey % 10 NOT IN (6, 9)"""
# The same patterns in the dialect of DuckDB.
_CUSTOM = (("name", r"(INV-\d+)", 1), ("count", r"total[^\d]{0,9}(\d+)", 1), ("brace", r"no\{t|(customer)", 1),
           ("condition", r"(supplier|invoice)", 1), ("flag", r"date:?\s*(\w+)", 1),
           ("loop", r"((?:[a-z]+ ){2,4}?[a-z]+)\.", 1))
ORACLES["custom_fields"] = f"WITH docs AS ({for_duckdb(CORPUS)}) SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, {q(name)} AS field, trim(regexp_extract(text, {q('(?i)' + pattern)}, {group}), {q(PY_WHITESPACE)}) "
    f"AS value FROM docs" for name, pattern, group in _CUSTOM) + ") x WHERE value <> ''"
