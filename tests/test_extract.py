import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docsieve.functions.regex import (
    any_word_pattern, first_match, from_first_letter, java_regex, java_search, py_strip, recursive_loops)
from docsieve.operators.classify import extract_fields
from docsieve.operators.redact import PrivacyRule, privacy_counts, privacy_flags, redacted
from docsieve.rules import Category, FieldPattern, RuleSet, load_rules
from tests import expected
from tests.texts import OTHERS, SAMPLES

PATTERNS = [
    r"(\w+)", r"(\d+)", r"a(\s+)b", r"(\S+)", r"(\W+)", r"(\D+)", r"([\w\-/]{2,30})", r"([^\n]{2,9})", r"(.+)",
    r"^(.*)$", r"(?P<x>a)(?P=x)", r"(b)\Z", r"\b(in)\b", r"([A-Z]+)", r"([a-z]{2})", r"([\s:]+)", r"([][]+)",
    r"([^]a]+)", r"([a&&b]+)", r"(a|)(b)?", r"(ſ|k)", r"(é+)", r"([[:]+)", r"(kiss)", r"([^a-z ]+)", r"([g-j]+)", r"([k]+)", r"(éc)", r"(a)\1", r"(?:(?i:s)|x)(k)?", r"(a-z|i-s)", r"(i{2,3}|s+|k?i)", r"(?i)(invoice\s*(?:no\.?|#))"]
TEXTS = [
    "", "a", "Invoice No. 7", "a\x1cb", "a b", "a\x85b c", "½ Ⅳ ²x", "٣٤ 12", "é é É", "aa bb",
    "b\n", "b\r\n", "in inn ‿in", "İıſK", "[x]&&b", "no_match-here/1", "\ta b\n", "日本語 漢字", "x​z"]


def test_patterns_agree_with_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    rows = df.select("id", *[F.regexp_extract("text", java_regex(p), 1).alias(str(n)) for n, p in enumerate(PATTERNS)]).collect()
    for r in rows:
        for n, p in enumerate(PATTERNS):
            m = re.search(p, TEXTS[r.id], re.IGNORECASE)
            assert r[str(n)] == ((m.group(1) or "") if m else ""), (p, TEXTS[r.id])


def test_strip_agrees_with_python(spark):
    values = [f"{c}x{c}" for c in map(chr, [*range(1, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])]
    for r in spark.createDataFrame([(v,) for v in values], "v string").select("v", py_strip(F.col("v")).alias("s")).collect():
        assert r.s == r.v.strip()


def check_fields(spark, rules, slugs, values):
    cases = [(slug, i, v) for slug in slugs for i, v in enumerate(values)]
    df = spark.createDataFrame(cases, "document_category string, i int, text string")
    want = {slug: expected.fields(rules.get(slug), values) for slug in slugs}
    for r in extract_fields(df, rules).collect():
        assert r.extracted_fields == want[r.document_category][r.i]


@pytest.mark.parametrize("variant", ["standard", "corrected"])
def test_samples_extract_like_python(spark, variant):
    rules = load_rules(variant=variant)
    check_fields(spark, rules, rules.slugs, [*SAMPLES.values(), *OTHERS])


ALPHABET = st.sampled_from(list("invoce nuaber:#.-/0123456789\n\t£$,dtl") + ["Invoice Number: ", "Total Amount", "Date ", "15/01/2025", "PO No ", "Tax "])


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(ALPHABET, max_size=25).map("".join), min_size=1, max_size=10))
def test_random_texts_extract_like_python(spark, rules, values):
    check_fields(spark, rules, ("invoice", "receipt", "purchase_order"), values)


def test_dates_by_variant(spark):
    """Layout whitespace inside the folded patterns keeps most date forms from matching."""
    texts = [f"Invoice Date: {d}" for d in ("15/01/2025", "2025-01-15", "Jan 15, 2025", "15 January 2025")]
    def found(variant):
        rules = load_rules(variant=variant)
        df = spark.createDataFrame([("invoice", t) for t in texts], "document_category string, text string")
        return [r.extracted_fields.get("invoice_date") for r in extract_fields(df, rules).collect()]
    assert found("standard") == ["15/01/2025", None, None, None]
    assert found("corrected") == ["15/01/2025", "2025-01-15", "Jan 15, 2025", "15 January 2025"]


def test_no_category_no_fields(spark, rules):
    df = spark.createDataFrame([("unclassified", "Invoice Number: 1"), ("memo", "x"), (None, "x")], "document_category string, text string")
    assert [r.extracted_fields for r in extract_fields(df, rules).collect()] == [{}, {}, {}]
    none = RuleSet((Category(slug="c", display_name="C", threshold=0.5),))
    assert extract_fields(df, none).first().extracted_fields == {}


def test_group_zero_and_empty_capture(spark):
    c = Category(slug="c", display_name="C", threshold=0.5, patterns=(
        FieldPattern("whole", "a(b)?", 0), FieldPattern("part", "a(b)?", 1), FieldPattern("blank", "( +)")))
    df = spark.createDataFrame([("c", "xa  ")], "document_category string, text string")
    assert extract_fields(df, RuleSet((c,))).first().extracted_fields == {"whole": "a"}


def test_word_pattern_is_empty_without_words(spark):
    df = spark.createDataFrame([("abc",)], "t string")
    assert df.select(F.regexp_extract_all("t", F.lit(any_word_pattern([])), F.lit(1)).alias("h")).first().h == []
    assert df.select(first_match(F.col("t"), "(z)").alias("v")).first().v == ""


LOOPS = [r"(a(?:\.\d+)*(?:\s*[a-z])?)", r"((?:ab)+c)", r"((?:a|b)*?c)", r"(x(?:\d{2,}-)*)", r"([a-z.]+@[a-z]+)", r"(?i)([ab]+b)", r"((?:[)*]+x)*y)"]
LOOP_TEXTS = ["a.1.22.333 b", "ababac ababc", "abbac", "x12-345-6-", "a.b@c d.@e @x", "aabab b", ")*x))xy", "a.1.", "abab", ""]


def test_group_loops_agree_with_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(LOOP_TEXTS)], "id int, text string")
    rows = df.select("id", *[first_match(F.col("text"), p).alias(str(n)) for n, p in enumerate(LOOPS)]).collect()
    for r in rows:
        for n, p in enumerate(LOOPS):
            m = re.search(p, LOOP_TEXTS[r.id], re.IGNORECASE)
            assert r[str(n)] == ((m.group(1) or "").strip() if m else ""), (p, LOOP_TEXTS[r.id])


def test_no_bundled_pattern_needs_python():
    for variant in ("standard", "corrected"):
        assert not any(recursive_loops(p.pattern)[1] for c in load_rules(variant=variant) for p in c.patterns)
    assert recursive_loops(r"((?:ab)+c)")[1] and not recursive_loops(r"(a[)*]*b)")[1]


def test_hostile_texts_neither_overflow_nor_stall(spark, rules):
    texts = ["version: 1" + ".1" * 50_000, "a." * 100_000, "x" * 200_000 + "@", "Aa " * 50_000, "statement period " * 5_000]
    looping = Category(slug="loop", display_name="L", threshold=0.5, patterns=(FieldPattern("f", r"^((?:[a-z]\.)+)!"), FieldPattern("g", r"(a)")))
    rows = [(slug, t) for slug in ("report", "resume", "bank_statement", "loop") for t in texts]
    got = extract_fields(spark.createDataFrame(rows, "document_category string, text string"), RuleSet((*rules, looping))).collect()
    assert len(got) == len(rows)
    assert next(r for r in got if r.document_category == "report" and r.text[:8] == "version:").extracted_fields["version"] == texts[0][9:]


@pytest.mark.parametrize("pattern, text, want", [(r"([a-z]+)-\1", "xab-ab", "ab"), (r"(?P<r>[0-9]+)/(?P=r)", "112/12", "12")])
def test_back_reference_may_need_part_of_a_run(spark, pattern, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(first_match(F.col("t"), pattern).alias("m")).first().m == want


PYTHON_ONLY = [r"(?P<inv_no>\d+)", r"(a{,3})b", r"(a{b)", r"(x)?(a+)(?(1)x|b)", r"(?a)(\w+)", r"((?:ab ?){1,}?c)", r"((?:a|b){0,5000}c)",
               r"([a-z]+)-\1"]


def test_patterns_that_java_refuses_are_searched_in_python(spark):
    values = ["inv 42", "aaab aab", "a{b", "xaax xab aab", "wörd", "ab ab abc", "abab" * 5000 + "c", "xab-ab", "", "é7"]
    df = spark.createDataFrame(list(enumerate(values)), "id int, text string")
    rows = df.select("id", *[first_match(F.col("text"), p).alias(str(n)) for n, p in enumerate(PYTHON_ONLY)]).collect()
    for r in rows:
        for n, p in enumerate(PYTHON_ONLY):
            m = re.search(p, values[r.id], re.IGNORECASE)
            assert r[str(n)] == ((m.group(1) or "").strip() if m else ""), (p, values[r.id][:20])


def test_privacy_rules_of_any_kind_mask_alike(spark):
    values = ["id aaab, aab", "x a{b y", "ab-ab xab-ab", "c" + "ab" * 3000, None, ""]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    for pattern in (r"a{,3}b", r"a{b", r"([a-z]+)-\1", r"(?:a|b){0,5000}?b", r"(?P<own_name>id)"):
        rule = (PrivacyRule("M", pattern),)
        rows = df.select("t", redacted(F.col("t"), rule).alias("r"), privacy_counts(F.col("t"), rule).alias("n"),
                         privacy_flags(F.col("t"), rule).alias("f")).collect()
        for r in rows:
            want = None if r.t is None else re.subn(pattern, "[M]", r.t)
            assert (r.r, r.n.m) == (want or (None, None)), (pattern, r.t)
            assert r.f == (["M"] if want and want[1] else [])


LED = [r"(?i)(?:due|pay\s*by|terms?)[\s:]*([a-z0-9]+)", r"(cash|credit\s*card|kiss)", r"(?:sub|is)(\w)(\w)?", r"(?:a|b)(c)|x(d)",
       r"(?:^|from\s)([a-z]+)", r"(?i)(?:in(?:voice)?\s)+(no)", r"(?:k|s)(?P<x>i)(?P=x)", r"(?:tax|gs?t|e-mail|ski)\W*(\w+)",
       r"(?i)(?:tax|gst|ski)[\s:]*(\d+)"]


def test_patterns_led_by_a_letter_read_like_python(spark):
    """The first letter is consumed before the rest is looked at; choices of whole patterns and anchored heads are not."""
    values = ["", "Due: 7", "pay  by x terms: y", "credit card", "KISS", "kiſS", "subxy isz", "ac xd", "xd", "from here", "invoice in no",
              "SİI", "kii sii", "gt 1 e-mail 2", "ſKİ: 1 ſkı 2 SKI 3", "taxgst 4 tax", "\nterms\n9", "due", "İſue due due:ü1", "x" * 300 + "due 3"]
    assert [from_first_letter(p) is not None for p in LED] == [True, True, True, False, False, True, True, False, True]
    assert from_first_letter(LED[-1]).startswith("(?i)[gst](?=[aks])(?<=")
    assert java_search(LED[0], group_only=True) != java_search(LED[0])
    df = spark.createDataFrame(list(enumerate(values)), "id int, text string")
    for n, p in enumerate(LED):
        for group in (1, 2) if re.compile(p).groups > 1 else (1,):
            for r in df.select("id", first_match(F.col("text"), p, group).alias("m")).collect():
                m = re.search(p, values[r.id], re.IGNORECASE)
                assert r.m == ((m.group(group) or "").strip() if m else ""), (p, values[r.id])
