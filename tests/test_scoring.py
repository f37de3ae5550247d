import math
import random
from dataclasses import replace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docsieve.functions.rounding import round_exact
from docsieve.functions.scoring import best_score, category_scores, keyword_hits, may_score, scored_best
from docsieve.operators.classify import classify, classify_long, explain_scores, keyword_evidence
from docsieve.rules import Category, RuleSet
from tests import expected
from tests.texts import OTHERS, SAMPLES


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id int, text string")


def check(spark, rules, values):
    got = {r.id: r for r in classify(texts(spark, values), rules).collect()}
    for (i, value), want in zip(enumerate(values), expected.decisions(rules, values)):
        r = got[i]
        assert (r.document_category, r.classification_method, r.classification_confidence,
                r.matched_keywords, r.llm_escalation_reason) == want, value


def test_samples_reach_their_category(spark, rules):
    rows = classify(texts(spark, list(SAMPLES.values())), rules).collect()
    assert [r.document_category for r in sorted(rows, key=lambda r: r.id)] == list(SAMPLES)
    assert all(r.classification_method == "deterministic" and r.llm_escalation_reason is None for r in rows)


def test_samples_and_odd_texts_match_the_query(spark, rules):
    check(spark, rules, [*SAMPLES.values(), *OTHERS])


def mixtures(rules, n, seed):
    """Texts assembled from keywords, keyword pieces and noise, in every overlap."""
    draw = random.Random(seed)
    words = [k for c in rules for k in (*c.primary, *c.secondary, *c.exclusion)]
    out = []
    for _ in range(n):
        c = draw.choice(list(rules))
        parts = draw.sample(list(c.primary), draw.randint(0, len(c.primary)))
        parts += draw.sample(list(c.secondary), draw.randint(0, len(c.secondary)))
        parts += draw.sample(words, draw.randint(0, 4))
        parts += [w[draw.randint(0, 2):] for w in draw.sample(words, 3)]
        draw.shuffle(parts)
        out.append(draw.choice(["", " ", "\n", " - "]).join(p.title() if draw.random() < .3 else p for p in parts))
    return out


def test_random_mixtures_match_the_query(spark, rules):
    check(spark, rules, mixtures(rules, 400, 7))


def test_long_form_equals_expression_form(spark, rules):
    values = [*SAMPLES.values(), *OTHERS, *mixtures(rules, 150, 11)]
    df = texts(spark, values)
    long = {r.id: (r.category, r.confidence, r.matched) for r in classify_long(df, rules, "id").collect()}
    scores = expected.scores(rules, values)
    for i in range(len(values)):
        slug = max(rules.slugs, key=lambda slug: scores[i, slug][0])
        assert long.get(i) == ((slug, *scores[i, slug]) if scores[i, slug][0] > 0 else None)


def test_explain_lists_every_category(spark, rules):
    rows = explain_scores(texts(spark, [SAMPLES["receipt"]]), rules).orderBy("ordinal").collect()
    assert [r.category for r in rows] == rules.slugs
    scores = expected.scores(rules, [SAMPLES["receipt"]])
    for r in rows:
        assert (r.confidence, r.matched_keywords) == scores[0, r.category]


def test_evidence_rows(spark, rules):
    rows = keyword_evidence(texts(spark, ["the po number"]), rules, "id").collect()
    assert ("purchase_order", "primary", 1, "po number") in {(r.category, r.tier, r.pos, r.keyword) for r in rows}
    assert {r.keyword for r in rows} == {"po", "po number"}


def small_rules(**changes):
    base = Category(slug="a", display_name="A", threshold=0.5, min_primary=1, primary=("ab", "abc"),
                    secondary=("x",), exclusion=("no",))
    return RuleSet((replace(base, **changes), replace(base, slug="b")))


@pytest.mark.parametrize("changes", [
    {}, {"primary": ("ab", "ab", "b")}, {"min_primary": 0}, {"primary": (), "secondary": (), "min_primary": 0},
    {"primary": ("", "ab")}, {"primary_weight": 5, "secondary_weight": 3}, {"threshold": 0.0},
    {"secondary": ("x.", "[x", "x-y", "#", "a b", "é", "😀")}])
def test_unusual_dictionaries(spark, changes):
    check(spark, small_rules(**changes), ["", "ab", "abc x", "abc no", "zabcx x. [x x-y # a b é 😀", "AB", "x"])


def test_ties_go_to_the_first_category(spark):
    row = classify(texts(spark, ["abc"]), small_rules()).first()
    assert row.document_category == "a"
    assert classify(texts(spark, ["abc"]), RuleSet(small_rules().categories[::-1])).first().document_category == "b"


def test_threshold_looks_at_the_top_category_only(spark):
    high, low = small_rules(threshold=0.99, secondary=()).categories
    rules = RuleSet((replace(high, primary=("ab", "abc", "q")), replace(low, primary=("ab", "zz"), threshold=0.1)))
    row = classify(texts(spark, ["abc"]), rules).first()
    assert row.document_category == "unclassified" and "'a'" in row.llm_escalation_reason


def test_no_categories(spark):
    row = classify(texts(spark, ["invoice"]), RuleSet()).first()
    assert row.llm_escalation_reason == "No categories available for scoring"


WORDS = st.text(alphabet="ab.-# é", min_size=1, max_size=4)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(WORDS, min_size=1, max_size=12), st.lists(st.text(alphabet="ab.-# éc", max_size=30), min_size=1, max_size=8))
def test_hits_are_exactly_the_substrings(spark, words, values):
    rules = RuleSet((Category(slug="a", display_name="A", threshold=0.5, primary=tuple(words)),))
    got = texts(spark, values).select("id", keyword_hits(F.col("text"), rules).alias("h")).collect()
    for r in got:
        assert sorted(r.h) == sorted({w for w in words if w in values[r.id]})


def test_a_score_worked_by_hand(spark):
    """Two of two primary words at weight 2 and one of one secondary: 5 of 5; one primary word only: 2 of 5."""
    rows = classify(texts(spark, ["abc x", "ab", "abc x no"]), small_rules()).orderBy("id").collect()
    assert [r.classification_confidence for r in rows] == [1.0, 0.4, 1.0 * 0.30]
    assert [r.matched_keywords for r in rows] == [["ab", "abc", "x"], ["ab"], ["ab", "abc", "x"]]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(WORDS, min_size=1, max_size=10), st.integers(0, 3),
       st.lists(st.text(alphabet="ab.-# éc", max_size=30), min_size=1, max_size=8))
def test_the_first_pass_never_loses_a_score(spark, words, need, values):
    rules = RuleSet((Category(slug="a", display_name="A", threshold=0.5, primary=tuple(words), min_primary=need,
                              secondary=("c",)),))
    rows = texts(spark, values).select(
        "text", may_score(F.col("text"), rules).alias("may"), category_scores(F.col("text"), rules).alias("full"),
        category_scores(F.col("text"), rules, only_positive=True).alias("short")).collect()
    for r in rows:
        if r.may:
            assert r.short == r.full
        else:
            assert r.short is None and all(s.confidence == 0 for s in r.full)
            assert sum(w in r.text for w in words) < need


def test_the_first_pass_stops_most_texts_of_other_kinds(spark, rules):
    """Single primary words, and pieces of others, do not open the second pass; enough of one category do."""
    values = ["po", "popular port", "term po receipts", "bill ton nage", "a contract, whereas the parties"]
    rows = texts(spark, values).orderBy("id").select(may_score(F.col("text"), rules).alias("may")).collect()
    assert [r.may for r in rows] == [False, False, False, False, True]


def test_rounding_follows_the_binary_value(spark):
    values = sorted({n / top * f for top in (68, 73, 75, 77, 80, 81) for n in range(top + 1) for f in (1, 0.30)}
                    - {0.0}) + [0.0, 1.0, 0.03125, 0.09375, 0.5, 0.85678, 5e-324, 2 ** -20, 2 ** -10]
    values += [v for n in range(30) for t in ((2 * n + 1) / 20000,)
               for v in (t, math.nextafter(t, 0), math.nextafter(t, 1))]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", round_exact(F.col("v")).alias("r")).collect()
    assert all(r.r == round(r.v, 4) for r in rows)


def test_reason_uses_the_binary_value_too(spark):
    """0.0125 * 0.30 = 0.00375 is stored below the tie and reads 0.0037."""
    words = tuple(f"w{i:02d}" for i in range(40))
    c = Category(slug="c", display_name="C", threshold=0.5, min_primary=0, primary=words, secondary=(), primary_weight=2,
                 exclusion=("no",))
    check(spark, RuleSet((c, replace(c, slug="d", primary=words * 2, primary_weight=1))), ["w00 no", "w00", "w01 w02 no"])


def test_scores_stay_in_the_unit_interval(spark, rules):
    df = texts(spark, [" ".join(k for c in rules for k in (*c.primary, *c.secondary))])
    scores = df.select(category_scores(F.col("text"), rules).alias("s")).first().s
    assert all(0.0 <= s.confidence <= 1.0 for s in scores)


def test_a_text_may_pass_by_its_beginning(spark, rules):
    """The first pass takes the beginning of a long text before the whole; one that only the rest lets pass is found."""
    rest = "nothing of any kind stands here. " * 30
    values = [SAMPLES["invoice"] + rest, rest + SAMPLES["invoice"], rest, "é" * 200 + SAMPLES["contract"]]
    may = may_score(F.lower("text"), rules)
    assert "substr" in str(may)
    rows = texts(spark, values).orderBy("id").select(may.alias("may")).collect()
    assert [r.may for r in rows] == [True, True, False, True]
    check(spark, rules, values)


def test_the_best_score_is_that_of_all_categories(spark, rules):
    """Only categories with enough primary words are scored, and of their scores only the best leaves the lambda."""
    values = [*SAMPLES.values(), *OTHERS, *mixtures(rules, 60, 23)]
    best = scored_best(F.col("text"), rules)
    assert str(best).index("array_max") > str(best).index("regexp_extract_all")
    rows = texts(spark, values).select(best.alias("best"), best_score(category_scores(F.col("text"), rules)).alias("want")).collect()
    assert all(r.best == r.want for r in rows) and sum(r.best is not None for r in rows) > 20
    for odd in (small_rules(min_primary=0), small_rules(primary=("ab", "ab", "b")), small_rules(primary=(), min_primary=0), RuleSet()):
        rows = texts(spark, ["ab x", "x", "", "abc no"]).select(scored_best(F.col("text"), odd).alias("best"), best_score(
            category_scores(F.col("text"), odd)).alias("want")).collect()
        assert all(r.best == r.want for r in rows)
