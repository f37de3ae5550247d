import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docsieve.llm import html_extract, mixing, quality_rules, substring_dedup, token_counts, toxicity
from docsieve.llm.queries import QUERIES
from tests.llm.conftest import SF, SF_LARGER
from tests.llm.test_jaccard_join import plain_groups

# HTML ---------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li>Menu</li></ul></nav><!-- ad --><div class="ad">Buy &amp; go</div><article><header><h1>Head&nbsp;line
two</h1></header><p>One <b>bold</b>\n text &lt;ok&gt;<br><p>Two<aside>side</aside><form>name<input></form>
<div class="comments"><p>first!</p></div><p hidden>no<p>Last</article><footer>&copy; x</footer></body></html>"""


def lines(page):
    found = html_extract.blocks(page)
    return html_extract.article(found) or html_extract.candidates(found)


def test_article_of_a_page():
    assert lines(PAGE) == ["Head line two", "One bold text <ok>", "Two", "Last"]


@pytest.mark.parametrize("page, want", [
    (None, []), ("", []), ("plain", ["plain"]), ("<p>a<p>b", ["a", "b"]), ("<p>a < b &am; c", ["a < b &am; c"]),
    ("<!-- open <p>x", []), ("<script>x", []), ("<div><div>" * 5000 + "deep", ["deep"]),
    ("<main><p>x</p></main><p>y</p>", ["x"]), ('<div id="main" class="sidebar">x</div>y', ["y"]),
    ("<article class=comment>c</article><p>t", ["t"]), ('<p title="a > b">x</p>', ["x"])])
def test_odd_pages(page, want):
    assert lines(page) == want


def plain_lcs(a, b):
    n, m = len(a), len(b)
    t = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[n][m]


@pytest.mark.parametrize("page,want", [
    ('<article><section title="The hidden valley"><p>a</p></section><p data-note="not hidden at all">b</p></article>',
     ["a", "b"]),
    ("<article><p>a <svg/> b</p><p>c <select><option>x</p><p>d</p></article>", ["a b", "c", "d"]),
    ("<article><p>a <svg><text>x</text></svg> b</p><p>c <button>press</button> d <span class='ad'>buy</span> e</p></article>",
     ["a b", "c d e"]),
    *[(f'<div class="{c}"><article><p>a</p></article></div>', ["a"]) for c in (
        "layout has-sidebar", "page-header-fixed", "post social-ready", "notice-of-award", "replies-to-critics", "sidebar")],
    *[(f'<article class="{c}"><p>a</p></article>', ["a"]) for c in (
        "layout has-sidebar", "page-header-fixed", "post social-ready", "notice-of-award", "replies-to-critics")],
    ('<article><p>a</p><div class="ad-slot">x</div><div class="siteNav">y</div><ul id="share_buttons"><li>z</ul></article>',
     ["a"]),
    ('<article><p>a</p></article><div class="comments"><article><p>first!</p></article></div>', ["a"])])
def test_attributes_names_and_unclosed_elements(page, want):
    assert html_extract.article(html_extract.blocks(page)) == want


def test_title_is_no_text():
    found = html_extract.blocks("<html><head><title>The title</title></head><body><p>a</p></body></html>")
    assert [b.text for b in found] == ["a"]


def test_common_lines():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(0, 25))] for _ in range(2))
        got = html_extract.common_lines(a, b)
        assert len(got) == plain_lcs(a, b) and got == sorted(set(got))
        it = iter(b)
        assert all(a[i] in it for i in got)


def test_template_is_deleted_where_no_article_is_declared(spark):
    def page(i):
        return f"<body><div>Site name</div><div>Hot: deals</div><p>story {i} " + f"word{i} " * 40 + "</p><div>End</div>"
    rows = [(i, f"http://h{i % 3}.com/a/{i:03d}", page(i)) for i in range(40)]
    rows += [(40, None, page(40)), (41, "http://alone.org/x", page(41)), (None, "http://h0.com/a/001", None),
             (42, "http://copy.com/a", page(99)), (43, "http://copy.com/b", page(99))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("own"))
    got = {r.page_id: r.text for r in html_extract.main_text(df).collect()}
    for i in range(40):
        assert got[i] == " ".join((f"story {i} " + f"word{i} " * 40).split())
    assert got[40].startswith("Site name\n") and got[41].endswith("\nEnd") and got[None] == ""
    assert got[42] == got[43] and "story 99" in got[42]
    assert html_extract.main_text(df.where("false")).count() == 0


def test_heavy_templates_and_runs_of_copies(spark):
    menu = "".join(f"<div>Menu entry {k} of the site</div>" for k in range(30))
    rows = [(i, f"http://a.com/n/{i:02d}", f"<body>{menu}<p>short {i}</p><div>End</div>") for i in range(20)]
    rows += [(20 + i, f"http://a.com/n/07?copy={i}", rows[7][2]) for i in range(5)]
    rows += [(30 + i, f"http://a.com/mirror{i}/07", rows[7][2]) for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.main_text(df).collect()}
    assert got == {i: f"short {i if i < 20 else 7}" for i, _, _ in rows}


def test_differencing_reaches_declared_articles(spark):
    """What most pages of a host repeat inside their article goes; what only some share, or a small host repeats, stays."""
    def page(i, more=""):
        return (f"<body><article><h1>Title {i}</h1><p>story {i}</p>{more}<p>Sign up for our letter</p></article>"
                f"<div>Date {i}</div>")
    rows = [(i, f"http://a.com/n/{i:02d}", page(i, "<p>a shared passage</p>" if i < 4 else "")) for i in range(12)]
    rows += [(20 + i, f"http://b.com/n/{i}", page(i)) for i in range(3)]
    rows += [(30 + i, f"http://c.com/n/{i:02d}", f"<article>all the same</article><div>Date {i}</div>") for i in range(9)]
    rows += [(40 + i, f"http://d.com/{i}", page(1)) for i in range(9)]
    rows += [(None, "http://a.com/n/13", None), (50, None, page(50))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.main_text(df).collect()}
    for i in range(12):
        assert got[i] == f"Title {i}\nstory {i}" + ("\na shared passage" if i < 4 else "")
    assert all(got[20 + i] == f"Title {i}\nstory {i}\nSign up for our letter" for i in range(3))
    assert all(got[30 + i] == "all the same" for i in range(9))
    assert all(got[40 + i] == "Title 1\nstory 1\nSign up for our letter" for i in range(9))
    assert got[None] == "" and got[50].endswith("Sign up for our letter")


def test_page_query(spark):
    rows = QUERIES["op1_html_extraction"](spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select(
        "page_id", "html"), "page_id").collect()
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = [" ".join(x.replace("&amp;", "&").replace("&quot;", '"').replace("&lt;", "<").replace("&gt;", ">").split())
                for x in re.split(r"(?:</?(?:p|h1|b|br|li|ul)>)+", inner)]
        assert r.text.split("\n") == [x for x in want if x] and r.n_chars == len(r.text)


# Token files ----------------------------------------------------------------------------------------

def test_separator_scan(spark, tmp_path):
    rng = np.random.default_rng(1)
    want = {}
    for name, n, width in (("a", 1000, 2), ("b", 0, 2), ("c", 64, 2), ("d", 1, 2), ("e", 333, 2)):
        t = np.where(rng.random(n) < .1, 9, rng.integers(10, 60000, n)).astype("<u2")
        if name == "c":
            t[:] = 7
        t.tofile(tmp_path / f"{name}.bin")
        at, docs = 0, []
        for i, x in enumerate(t):
            if x == 9:
                docs.append((at, i - at, True))
                at = i + 1
        if at < n:
            docs.append((at, n - at, False))
        want |= {(f"{name}.bin", i): d for i, d in enumerate(docs)}
    for block, group in ((2, 3), (16, 2), (4096, 512)):
        token_counts.GROUP, old = group, token_counts.GROUP
        got = token_counts.count_tokens(spark, str(tmp_path), token_counts.token_files(spark, str(tmp_path)), eod=9,
                                        block_bytes=block).collect()
        token_counts.GROUP = old
        assert {(r.file, r.ordinal): (r.start, r.n_tokens, r.ended) for r in got} == want


def test_token_counts(spark, odd_docs, no_docs):
    encoding = token_counts.load_tokenizer()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: len(encoding.encode_ordinary(r.text or "")) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in QUERIES["op3_token_counts"](spark, SF).collect()} == want
    rows = token_counts.document_token_counts(odd_docs, block_bytes=64).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(
        len(encoding.encode_ordinary(r.text or "")) for r in odd_docs.collect())
    assert token_counts.document_token_counts(no_docs).count() == 0


# Repeated passages ------------------------------------------------------------------------------------

def sentences(rng, n):
    return " ".join(" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randrange(1, 4) + str(rng.randrange(300))
                             for _ in range(rng.randrange(6, 12))) + "." for _ in range(n))


def test_repeated_passages(spark):
    rng = random.Random(8)
    passage = sentences(rng, 9)
    edited = passage.split()
    edited[30] = "changed"
    rows = [(i, sentences(rng, 20)) for i in range(60)]
    rows += [(60 + i, sentences(rng, 4) + " " + passage + " " + sentences(rng, 4)) for i in range(10)]
    rows += [(70, "intro\n" + " ".join(edited) + "\n" + sentences(rng, 3)), (71, None), (72, ""), (73, "short. text."),
             (None, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit(1), "spans": F.lit("own")})
    got = {r.doc_id: r for r in substring_dedup.report(df).collect()}
    assert set(got) == set(range(61, 71))
    assert all(60 in r.kept_in and r.n_chars_removed >= 250 for r in got.values())
    out = substring_dedup.remove_repeats(df)
    assert out.columns == df.columns and out.count() == len(rows)
    texts = {r.doc_id: r.text for r in out.collect()}
    before = dict(rows)
    assert all(texts[i] == before[i] for i in [*range(61), 71, 72, 73])
    core = " ".join(passage.split()[:50])
    assert core in texts[60] and not any(core in texts[i] for i in range(61, 70))
    assert substring_dedup.report(df.where("false")).count() == 0


def test_bands():
    bands, rows = substring_dedup.tune_bands(0.75, 0.98)
    assert 1 - (1 - 0.75 ** rows) ** bands >= 0.98


def test_every_pair_of_a_mixed_entry_is_found(spark):
    """Near and equal paragraphs around one phrase that all of them share, unlike ones between them."""
    rng = random.Random(5)
    phrase = " ".join(f"common{i}" for i in range(25))
    rows = []
    for g in range(60):
        own = [f"g{g}w{i}" for i in range(36)]
        for copy in range(2):
            if copy and g % 2:
                own[rng.choice((1, 34))] = "edited"
            rows.append((" ".join(own[:18]) + " " + phrase + " " + " ".join(own[18:]) + ".", g))
    order = rng.sample(range(len(rows)), len(rows))
    df = spark.createDataFrame([(i, rows[k][0]) for i, k in enumerate(order)], "doc_id long, text string")
    group = defaultdict(list)
    for i, k in enumerate(order):
        group[rows[k][1]].append(i)
    got = {(r.doc_id, *r.kept_in) for r in substring_dedup.report(df).collect()}
    assert got == {(max(p), min(p)) for p in group.values()}


def test_passages_at_any_offset_without_sentence_ends(spark):
    rng = random.Random(6)

    def words(n):
        return [f"{rng.choice('abcdefgh')}{rng.randrange(100_000)}" for _ in range(n)]
    rows, want = [], {}
    for g in range(40):
        passage = words(rng.choice((50, 51, 60, 85, 150)))
        for copy in range(2):
            low = words(rng.randrange(0, 90))
            i = 2 * g + copy
            rows.append((i, " ".join(low + passage + words(rng.randrange(0, 90)))))
            if copy:
                want[i] = (len(" ".join(low)) + bool(low), " ".join(passage), i - 1)
    lone = " ".join(words(49))
    rows += [(100, lone), (101, lone.upper()), (102, "so " * 400), (103, "go on " * 80 + "x")]
    got = {r.doc_id: r for r in substring_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == set(want) | {102, 103}
    for i, (start, passage, keep) in want.items():
        assert any(s.start <= start and s.stop >= start + len(passage) for s in got[i].spans) and got[i].kept_in == [keep]
        if len(passage.split()) <= 60:
            assert got[i].n_chars_removed <= 1.5 * len(passage)


def test_every_repeat_within_a_document_goes(spark):
    """A passage five times in one document, each time with another word changed, and once in a later one."""
    rng = random.Random(7)
    words = [f"p{i}" for i in range(60)]
    parts = []
    for k in range(6):
        parts.append(" ".join(words[:30] + [f"changed{k}"] + words[31:]) + ".")
    text = " ".join(x for p in parts[:5] for x in (p, sentences(rng, 8)))
    rows = [(1, text), (2, sentences(rng, 8) + " " + parts[5]), (3, sentences(rng, 30))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in substring_dedup.remove_repeats(df).collect()}
    assert "changed0" in out[1] and not any(f"changed{k}" in out[1] + out[2] for k in range(1, 6)) and out[3] == rows[2][1]


def test_report_finds_all_long_repeats(spark):
    """Every line of 60 words or more that is equal in two documents is found, by a plain search."""
    docs = spark.read.parquet(f"{SF_LARGER}/documents.parquet")
    where = defaultdict(set)
    for r in docs.collect():
        for line in (r.text or "").split("\n"):
            if len(line.split()) >= 60 and "." in line:
                where[line.lower()].add(r.doc_id)
    got = {r.doc_id for r in substring_dedup.report(docs).collect()}
    repeated = [d for d in where.values() if len(d) > 1]
    later = {i for d in repeated for i in d if i != min(d)}
    assert later and len(later - got) <= 0.02 * len(later)


# Toxicity ---------------------------------------------------------------------------------------------

def test_rows_of_one_id_lose_only_their_own_text(spark):
    """A shared id: the passage goes from the row that repeats it, and the other text of that id stays whole."""
    passage = " ".join(f"alpha{i}" for i in range(120)) + "."
    alone = " ".join(f"beta{i}" for i in range(140)) + "."
    rows = [(1, passage), (5, alone), (5, "lead " + passage), (7, alone + " tail"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = substring_dedup.remove_repeats(docs).collect()
    assert sorted((r.doc_id, len(r.text or "")) for r in left)[:1] == [(1, len(passage))]
    both = sorted((r.text for r in left if r.doc_id == 5), key=len)
    assert both[1] == alone and len(both[0]) <= len("lead ")
    assert all(len(r.text or "") <= len(" tail") for r in left if r.doc_id == 7)
    found = {(r.doc_id, tuple(r.kept_in)) for r in substring_dedup.report(docs).collect()}
    assert found == {(5, (1,)), (7, (5,))}


def test_an_id_with_many_rows_gives_one_training_text(spark):
    docs = spark.createDataFrame([(0, f"text {i}") for i in range(500)] + [(2, None), (3, "x"), (5, "y")],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    texts, toxic = toxicity.training_rows(docs, labels, sample=5)
    assert len(texts) == len(toxic) <= 4 and sum(t.startswith("text") for t in texts) <= 1


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = docs.join(labels.select("doc_id", "toxic"), "doc_id")
    texts, y = toxicity.training_rows(docs, labels, 400)
    assert len(texts) <= 800
    model = toxicity.fit(texts, y)
    rows = [r for r in known.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    hits = defaultdict(list)
    for r in rows:
        hits[r.toxic].append(model.score(r.text) >= toxicity.CUT)
    assert np.mean(hits[1]) > 0.7 and np.mean(hits[0]) < 0.02


def test_long_runs_are_read_to_their_end():
    model = toxicity.fit(["you idiot there", "fine day there"] * 20, [1, 0] * 20)
    for n in range(55, 190):
        assert model.score("x" * n + "idiot" + "x" * 9) > model.score("x" * (n + 14))
    assert toxicity.words("a" * 64 + " b") == ["a" * 64, "b"]


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    model = toxicity.fit(["you idiot there", "fine day there"] * 20, [1, 0] * 20)
    assert model.score("an idiott speaks") > model.score("a day speaks")
    rows = toxicity.scores(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(odd_docs, none).where("score > 0.01").count() == 0
    assert toxicity.toxicity(no_docs, none).count() == 0


# Mixing -----------------------------------------------------------------------------------------------

def test_rows_of_one_id_are_mixed_row_by_row(spark):
    rows = [(None if i % 2 else 7, f"text of {i} here", "ab"[i % 3 == 0]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("row", F.lit("own"))
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    taken = {r.source: r.words for r in got.groupBy("source").agg((4 * F.count("*")).alias("words")).collect()}
    target = {r.source: r.target for r in mixing.mix(df).select("source", "target").distinct().collect()}
    assert set(taken) == set(target) and all(abs(taken[s] - target[s]) <= 4 for s in target)


# Pipeline ---------------------------------------------------------------------------------------------

def test_pipeline_against_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    kept = [r for r in docs if quality_rules.passes is not None and not plain_bits(r.text)]
    last = {}
    for r in kept:
        k = (r.text or "").encode().lower()
        last[k] = max(last.get(k, r), r, key=lambda x: x.doc_id)
    groups = plain_groups([(r.doc_id, r.text) for r in last.values()])
    kept = [r for r in last.values() if groups[r.doc_id][1] == r.doc_id]
    frame = spark.createDataFrame(kept, spark.read.parquet(f"{SF}/documents.parquet").schema)
    want = sorted(i for r in mixing.mix(frame).collect() for i in [r.doc_id] * r.copies)
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == want


def plain_bits(text):
    n, chars, symbols, dup, repeat, n_lines, long = quality_rules.measure(text)
    return (n < 50 or 100 * repeat > 50 * n or 10 * symbols > n or n_lines >= 4 and 100 * dup > 50 * n_lines
            or chars > 15 * n or 20 * long > n)
