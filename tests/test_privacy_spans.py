import re

import pytest
from pyspark.sql import functions as F

from docsieve.operators.redact import PrivacyRule, iban_valid, load_privacy_rules, luhn_valid, mask_privacy, privacy_spans

RULES = (PrivacyRule("MAIL", "[a-z0-9]+@[a-z.]+"), PrivacyRule("CARD", "[0-9](?:[ -]?[0-9]){12,18}", "luhn"),
         PrivacyRule("IBAN", "[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", "iban"), PrivacyRule("LONG", "[0-9]{8,}"),
         PrivacyRule("WORD", "CARD|MAIL"))


def test_check_sums(spark):
    df = spark.createDataFrame([(v,) for v in (
        "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "79927398713", "79927398710")], "v string")
    assert [r.ok for r in df.select(luhn_valid(F.col("v")).alias("ok")).collect()] == [True, False, True, True, False]
    df = spark.createDataFrame([(v,) for v in (
        "GB82WEST12345698765432", "DE89370400440532013000", "DE00370400440532013000")], "v string")
    assert [r.ok for r in df.select(iban_valid(F.col("v")).alias("ok")).collect()] == [True, True, False]


@pytest.mark.parametrize("text,want", [
    ("no number", "no number"), ("", ""), (None, None),
    ("pay 4111 1111 1111 1111 now", "pay [CARD] now"), ("pay 4111 1111 1111 1112 now", "pay 4111 1111 1111 1112 now"),
    # an unproven card is still a long number; a proven one is both, under the first label
    ("4111111111111112", "[LONG]"), ("4111111111111111", "[CARD]"),
    # the union of overlapping spans is masked: no part of either stays
    ("x 5500005555555559@bank.example y", "x [MAIL] y"), ("4111 1111 1111 1111@b.c", "[MAIL]"),
    # a mask is not matched by a later rule
    ("a@b.c CARD", "[MAIL] [WORD]"),
    ("GB82WEST12345698765432, DE00370400440532013000", "[IBAN], DE[LONG]"),
    ("\ue000 4111111111111111 \ue000", "\ue000 [CARD] \ue000"), ("😀é 4111111111111111é", "😀é [CARD]é")])
def test_spans_are_resolved_on_the_original_text(spark, text, want):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    row = mask_privacy(df, RULES).first()
    assert row.text == want
    assert all(s.start < s.stop for s in row.privacy_spans)


def test_checks_are_known(tmp_path):
    (tmp_path / "p.yaml").write_text("rules: [{label: A, pattern: a, check: odd}]")
    with pytest.raises(ValueError, match="odd"):
        load_privacy_rules(tmp_path / "p.yaml")


def test_texts_are_not_rebuilt_letter_by_letter(spark):
    """Marks in a text are replaced where they stand; all other texts stay as they are."""
    df = spark.createDataFrame([("a@b.example and 123-45-6789",)], "text string")
    found = mask_privacy(df)
    assert "translate(" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.first().text == "[EMAIL] and [NATIONAL_ID]"


def test_texts_are_freed_of_the_mark_once(spark):
    """Not once for every rule."""
    text = str(privacy_spans(F.col("text"), RULES))
    assert len(re.findall(r"(?<!regexp_)replace\(", text)) == 1 and text.count("regexp_replace(") >= len(RULES)
