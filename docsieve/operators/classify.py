"""Keyword classification, field extraction and per-category explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions.binding import computed_once, let
from docsieve.functions.regex import first_match, java_search
from docsieve.functions.scoring import (
    EXCLUSION_FACTOR, category_scores, confidence_text, escalation_reason, keyword_hits, may_score,
    scored_best)
from docsieve.rules import RuleSet
from docsieve.session import tasks_for
from docsieve.sources.rule_tables import category_table, keyword_table, small

UNCLASSIFIED = "unclassified"


def classification(best: Column, rules: RuleSet) -> Column:
    """Decision for one document from its best score.

    The threshold is applied to the top category only: a lower scorer that clears its own threshold
    never wins. A document below the threshold keeps the confidence and keywords of its best match.
    """
    accepted = F.coalesce(best["confidence"] >= best["threshold"], F.lit(False))
    return F.struct(
        F.when(accepted, best["slug"]).otherwise(F.lit(UNCLASSIFIED)).alias("document_category"),
        F.when(accepted, F.lit("deterministic")).otherwise(F.lit(UNCLASSIFIED))
        .alias("classification_method"),
        F.coalesce(best["confidence"], F.lit(0.0)).alias("classification_confidence"),
        F.coalesce(best["matched"], F.array().cast("array<string>")).alias("matched_keywords"),
        F.when(~accepted, escalation_reason(best, rules)).alias("llm_escalation_reason"),
        F.when(~accepted, confidence_text(best, rules)).alias("confidence_text"))


def classify(df: DataFrame, rules: RuleSet, text: str = "text") -> DataFrame:
    """Add the classification columns. One scan of the text, no shuffle, no Python."""
    scored = computed_once(df, "_best", scored_best(F.col(text), rules))
    decided = scored.withColumn("_decision", classification(F.col("_best"), rules))
    return decided.select("*", "_decision.*").drop("_best", "_decision", "confidence_text")


def field_map(text: Column, category: Column, rules: RuleSet) -> Column:
    """Fields of the given category as a map; the patterns of other categories are not evaluated."""
    empty = F.create_map().cast("map<string,string>")
    chain = None
    for c in rules:
        if not c.patterns:
            continue
        # A search in Python sees only the texts of its category; the others arrive as NULL.
        own = F.when(category == c.slug, text)
        pairs = [x for p in c.patterns for x in (F.lit(p.field), first_match(
            own if java_search(p.pattern) is None else text, p.pattern, p.group))]
        found = F.map_filter(F.create_map(*pairs), lambda _, v: v != "")
        chain = (F if chain is None else chain).when(category == c.slug, found)
    return empty if chain is None else chain.otherwise(empty)


def extract_fields(df: DataFrame, rules: RuleSet, text: str = "text",
                   category: str = "document_category") -> DataFrame:
    return computed_once(df, "extracted_fields", field_map(F.col(text), F.col(category), rules))


def explain_scores(df: DataFrame, rules: RuleSet, text: str = "text") -> DataFrame:
    """One row per document and category with the evidence behind each score; stays row-local."""
    scored = df.withColumn("_score", F.explode(category_scores(F.col(text), rules)))
    return scored.select(
        *df.columns,
        F.col("_score.slug").alias("category"),
        (-F.col("_score.rank")).alias("ordinal"),
        F.col("_score.confidence").alias("confidence"),
        F.col("_score.threshold").alias("threshold"),
        F.col("_score.n_primary").alias("n_primary"),
        F.col("_score.n_secondary").alias("n_secondary"),
        F.col("_score.excluded").alias("excluded"),
        F.col("_score.matched").alias("matched_keywords"))


def keyword_evidence(df: DataFrame, rules: RuleSet, key: str, text: str = "text",
                     only_positive: bool = False) -> DataFrame:
    """Long form: one row per document, category, tier and keyword that occurs in the text.

    With ``only_positive`` documents in which no category can score have no rows.

    The text is scanned once for all words; what follows is an equi join of the few hits with the
    keyword table, so the text itself never meets a join or a shuffle.
    """
    return _evidence(df.select(key, F.explode(_hits(text, rules, only_positive)).alias("keyword")), rules)


def _hits(text: str, rules: RuleSet, only_positive: bool) -> Column:
    def hits_of(low: Column) -> Column:
        return F.when(may_score(low, rules), keyword_hits(low, rules)) if only_positive else keyword_hits(low, rules)

    return let(F.lower(F.coalesce(text, F.lit(""))), hits_of)


def _evidence(hits: DataFrame, rules: RuleSet) -> DataFrame:
    words = keyword_table(hits.sparkSession, rules)
    return hits.join(small(words, sum(len(c.primary) + len(c.secondary) + len(c.exclusion) for c in rules)),
                     "keyword")


def classify_long(df: DataFrame, rules: RuleSet, key: str, text: str = "text") -> DataFrame:
    """The winning category of each document that has one, computed relationally.

    Equal to the expression form. One row per document, with its hits and no text, is shuffled; the evidence is made
    behind that, where each hit has become a row for every category and tier that lists it, and both aggregations keep
    the partitioning by document. The documents are counted for the number of tasks, so that the evidence in each fits
    its memory; by bytes it would be cut by the hits, which are few next to their evidence.
    """
    tasks = tasks_for(df.count(), df.sparkSession.sparkContext.defaultParallelism)
    found = computed_once(df.select(key, text), "_hits", _hits(text, rules, only_positive=True)).select(key, "_hits")
    dealt = found.where("size(_hits) > 0").repartition(tasks, key)
    evidence = _evidence(dealt.select(key, F.explode("_hits").alias("keyword")), rules)
    counts = evidence.groupBy(key, "category").agg(
        F.count_if(F.col("tier") == "primary").alias("p"),
        F.count_if(F.col("tier") == "secondary").alias("s"),
        F.bool_or(F.col("tier") == "exclusion").alias("excluded"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("tier") != "exclusion", F.struct(
                (F.col("tier") == "secondary").alias("late"), "pos", "keyword")))),
            lambda m: m["keyword"]).alias("matched"))
    ratio = (F.col("p") * F.col("primary_weight") + F.col("s") * F.col("secondary_weight")) / F.when(
        F.col("max_score") != 0, F.col("max_score"))
    confidence = F.when(F.col("excluded"), ratio * F.lit(EXCLUSION_FACTOR)).otherwise(ratio)
    scored = (
        counts.join(small(category_table(df.sparkSession, rules), len(rules)), "category")
        .filter(F.col("p") >= F.col("min_primary"))
        .withColumn("confidence", confidence)
        .filter(F.col("confidence") > 0))
    best = F.max_by(F.struct("category", "confidence", "threshold", "matched"),
                    F.struct("confidence", -F.col("ordinal")))
    return scored.groupBy(key).agg(best.alias("best")).select(key, "best.*")
