"""Keyword scoring as column expressions.

The rule set enters the plan as one constant array, so the plan has the same size for seven
categories or seven hundred, and every document is scanned once whatever the number of keywords.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsieve.functions.binding import constant, let
from docsieve.functions.regex import anchored_pattern, any_word_pattern
from docsieve.rules import Category, RuleSet

# The exclusion factor and the messages are part of every result.
EXCLUSION_FACTOR = 0.30
NO_SCORE_REASON = "No categories available for scoring"

#: Characters at the beginning of a longer text that the first pass looks at before the rest.
BEGINNING = 160

_RULE_DDL = (
    "array<struct<ordinal:int,slug:string,threshold:double,threshold_text:string,"
    "primary_weight:int,secondary_weight:int,min_primary:int,max_score:int,"
    "primary:array<string>,secondary:array<string>,exclusion:array<string>>>"
)


def rule_array(rules: RuleSet) -> Column:
    return constant(
        [
            {
                "ordinal": i,
                "slug": c.slug,
                "threshold": c.threshold,
                "threshold_text": f"{c.threshold:.2f}",
                "primary_weight": c.primary_weight,
                "secondary_weight": c.secondary_weight,
                "min_primary": c.min_primary,
                "max_score": c.max_score,
                "primary": c.primary,
                "secondary": c.secondary,
                "exclusion": c.exclusion,
            }
            for i, c in enumerate(rules)
        ],
        _RULE_DDL,
    )


def _vocabulary(rules: RuleSet) -> list[str]:
    return sorted({k for c in rules for tier in (c.primary, c.secondary, c.exclusion) for k in tier})


def keyword_hits(low: Column, rules: RuleSet) -> Column:
    """Distinct keywords of any category or tier that occur in the lower-cased text as substrings."""
    words = _vocabulary(rules)
    found = F.regexp_extract_all(low, F.lit(any_word_pattern(words)), F.lit(1))
    # The pattern reports the longest word at a position; the words it starts with occur there too.
    shorter = {w: [v for v in words if v and v != w and w.startswith(v)] for w in words}
    shorter = {w: v for w, v in shorter.items() if v}
    if shorter:
        prefixes = constant(shorter, "map<string,array<string>>")
        found = let(found, lambda hits: F.concat(hits, F.flatten(F.transform(
            F.filter(F.array_distinct(hits), lambda h: h.isin(*shorter)), lambda h: F.element_at(prefixes, h)))))
    found = F.array_distinct(found)
    if "" in words:
        found = F.concat(found, F.array(F.lit("")))
    return found


def may_score(low: Column, rules: RuleSet) -> Column:
    """Whether any category can reach its least number of primary words: false only if none does.

    A cheap first pass over the lower-cased text. It finds the tails of primary words from their rare letters on;
    the words whose tails begin these bound a category's hits from above. Only texts that pass are searched for
    the words themselves, and so for secondary and exclusion words. Many texts pass by their beginning; the others
    are looked at whole.
    """
    pattern, tails = anchored_pattern(k for c in rules for k in c.primary)
    every, bounds = sorted(set(tails.values())), []
    for c in rules:
        short = sum(word not in tails for word in c.primary)  # a word without an anchor counts as found
        if c.min_primary <= short:
            return F.lit(True)
        counts = {t: sum(t.startswith(tails[w]) for w in c.primary if w in tails) for t in every}
        bounds.append({"need": c.min_primary - short, "counts": {t: n for t, n in counts.items() if n}})
    if not bounds:
        return F.lit(False)
    table = constant(bounds, "array<struct<need:int,counts:map<string,int>>>")

    def enough(found: Column) -> Column:
        return F.exists(table, lambda b: F.aggregate(
            found, F.lit(0), lambda n, tail: n + F.coalesce(F.try_element_at(b["counts"], tail), F.lit(0))) >= b["need"])

    def passes(part: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(part, F.lit(pattern), F.lit(1)))
        return let(found, lambda f: (F.size(f) > 0) & enough(f))

    return F.exists(F.when(F.octet_length(low) > 2 * BEGINNING, F.array(F.substring(low, 1, BEGINNING), low))
                    .otherwise(F.array(low)), passes)


def _tier(words: Column, hits: Column, rules: RuleSet) -> Column:
    """The words of a tier that were hit, in dictionary order; a word listed twice counts twice."""
    if any(len(set(t)) < len(t) for c in rules for t in (c.primary, c.secondary)):
        return F.filter(words, lambda w: F.array_contains(hits, w))
    return F.array_intersect(words, hits)


def category_scores(text: Column, rules: RuleSet, only_positive: bool = False) -> Column:
    """One struct per category: confidence, evidence counts and matched keywords.

    ``rank`` falls with the index position, so ordering by (confidence, rank) puts the first of
    several equal categories on top. With ``only_positive`` a text in which no category can score has no
    structs, after the first pass of ``may_score`` alone; for all others the result is the same.
    """
    def one(c: Column, hits: Column) -> Column:
        return let(_tier(c["primary"], hits, rules), lambda p: let(
            F.when(F.size(p) >= c["min_primary"], _tier(c["secondary"], hits, rules)), lambda s: let(
                s.isNotNull() & F.arrays_overlap(c["exclusion"], hits),
                lambda x: _score(c, p, s, x))))

    def scores(low: Column) -> Column:
        return let(keyword_hits(low, rules), lambda h: F.transform(rule_array(rules), lambda c: one(c, h)))

    low = F.lower(F.coalesce(text, F.lit("")))
    if not only_positive:
        return scores(low)
    return let(low, lambda low: F.when(may_score(low, rules), scores(low)))


def _score(c: Column, p: Column, s: Column, excluded: Column) -> Column:
    """The struct of a category from its primary and secondary words; these are null below the least of the former."""
    guarded = s.isNotNull()
    raw = F.when(guarded, F.size(p) * c["primary_weight"] + F.size(s) * c["secondary_weight"])
    ratio = raw / F.when(c["max_score"] != 0, c["max_score"])
    confidence = F.when(excluded, ratio * F.lit(EXCLUSION_FACTOR)).otherwise(ratio)
    return F.struct(
        F.coalesce(confidence, F.lit(0.0)).alias("confidence"),
        (-c["ordinal"]).alias("rank"),
        c["slug"].alias("slug"),
        c["threshold"].alias("threshold"),
        c["threshold_text"].alias("threshold_text"),
        F.coalesce(raw, F.lit(0)).alias("raw"),
        excluded.alias("excluded"),
        F.size(p).alias("n_primary"),
        F.when(guarded, F.size(s)).otherwise(F.lit(0)).alias("n_secondary"),
        F.when(guarded, F.concat(p, s)).otherwise(F.array().cast("array<string>")).alias("matched"),
    )


def scored_best(text: Column, rules: RuleSet) -> Column:
    """``best_score`` of a text; texts without enough primary words are passed over once and cheaply.

    Only categories with enough primary words are scored. A bound value is copied with all it holds when it leaves
    the lambda, so the best score alone does.
    """
    own = sorted({w for c in rules for w in c.primary})

    def one(c: Column, hits: Column) -> Column:
        found = F.struct(_tier(c["primary"], hits, rules).alias("p"), _tier(c["secondary"], hits, rules).alias("s"),
                         F.arrays_overlap(c["exclusion"], hits).alias("x"))
        return let(found, lambda f: _score(c, f["p"], f["s"], f["x"]))

    def best(hits: Column) -> Column:
        return let(F.filter(hits, lambda w: w.isin(*own)), lambda primary: best_score(F.transform(
            F.filter(rule_array(rules), lambda c: F.size(_tier(c["primary"], primary, rules)) >= c["min_primary"]),
            lambda c: one(c, hits))))

    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.when(
        may_score(low, rules), let(keyword_hits(low, rules), best)))


def best_score(scores: Column) -> Column:
    """The highest positive score; the first in index order on a tie; NULL if all are zero."""
    return F.array_max(F.filter(scores, lambda s: s["confidence"] > 0))


def _labels(category: Category, factor: float | None) -> list[str]:
    """Every score a category can reach, formatted from its exact binary value."""
    scores = (raw / category.max_score for raw in range(category.max_score + 1)) if category.max_score else ()
    return [f"{s if factor is None else s * factor:.4f}" for s in scores]


def confidence_text(best: Column, rules: RuleSet) -> Column:
    """``%.4f`` of the best score. SQL rounds decimal digits, which differs on binary near-ties, but
    the possible scores are finite, so each one is formatted ahead of the query."""
    table = constant(
        [{"plain": _labels(c, None), "reduced": _labels(c, EXCLUSION_FACTOR)} for c in rules],
        "array<struct<plain:array<string>,reduced:array<string>>>",
    )
    entry = F.get(table, -best["rank"])
    label = F.get(F.when(best["excluded"], entry["reduced"]).otherwise(entry["plain"]), best["raw"])
    return F.coalesce(label, F.lit("0.0000"))


def escalation_reason(best: Column, rules: RuleSet) -> Column:
    return F.when(best.isNull(), F.lit(NO_SCORE_REASON)).otherwise(F.concat(
        F.lit("Best match '"), best["slug"], F.lit("' scored "), confidence_text(best, rules),
        F.lit(" but threshold is "), best["threshold_text"]))
