"""Exact duplicates with a heavy-hitter split, in DataFrame operations only.

A Misra-Gries summary (Spark's frequent-items sketch ``approx_top_k``, merged in two levels) names digests
that may be frequent. Their exact counts and winners are computed with map-side combining and broadcast, a
table of at most ``MAX_FREQUENT`` rows, so rows of frequent digests never move. All other digests have at
most about ``rows / TRACKED`` copies and go through an ordinary shuffle.

Defined cases: a null text equals the empty one; of equal texts the largest doc_id stays, a null doc_id only
if there is no other; of repeated rows (same id, same text) exactly one stays; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsieve.llm.common import ascii_lower
from docsieve.session import stage

TRACKED = 4096
MAX_FREQUENT = 1024
_MERGERS = 512
_DIGEST = "__digest__"


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(ascii_lower(text), 256))


def resolve(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, digest, keep_id, group_size, kept."""
    rows = stage(docs.select("doc_id", text_digest(F.col("text")).alias("digest"),
                             F.monotonically_increasing_id().alias("row")), "digests")
    partial = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(_MERGERS)).alias("m")).agg(
        F.expr(f"approx_top_k_accumulate(xxhash64(digest), {TRACKED})").alias("sketch"))
    candidates = partial.groupBy(F.lit("all").alias("g")).agg(
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {TRACKED}), {MAX_FREQUENT})").alias("top")
    ).select(F.explode("top").alias("t")).select(F.col("t.item").alias("h"))
    last = F.max(F.struct("doc_id", "row"))
    frequent = rows.join(F.broadcast(candidates), F.xxhash64("digest") == F.col("h"), "left_semi").groupBy(
        "digest").agg(last.alias("winner"), F.count("*").alias("group_size"))
    # Each candidate hash stands for one digest, but for collisions; the bound is the number of candidates.
    frequent = stage(frequent.where("group_size > 1"), "winners")
    known = rows.join(F.broadcast(frequent), "digest", "left")
    group = W.partitionBy("digest")
    rare = known.where(F.col("winner").isNull()).select("doc_id", "digest", "row").select(
        "*", last.over(group).alias("winner"), F.count("*").over(group).alias("group_size"))
    done = known.where(F.col("winner").isNotNull()).select(*rare.columns).unionByName(rare)
    return done.select("doc_id", "digest", F.col("winner.doc_id").alias("keep_id"), "group_size",
                       (F.col("row") == F.col("winner.row")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    found = stage(resolve(docs), "resolved")
    marked = docs.withColumn(_DIGEST, text_digest(F.col("text")))
    away = found.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "digest").distinct()
    rest = marked.join(away, (marked[_DIGEST] == away["digest"]) & marked["doc_id"].eqNullSafe(away["doc_id"]),
                       "left_anti")
    # Rows that repeat the winner's id and text are rare; only they meet a shuffle by digest.
    twice = found.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy(
        F.col("digest").alias(_DIGEST)).count().where("count > 1").select(_DIGEST)
    once = rest.join(twice, _DIGEST, "left_anti")
    again = rest.join(twice, _DIGEST, "left_semi").dropDuplicates([_DIGEST])
    return once.unionByName(again).select(*[
        F.col(f"`{c}`") for c in docs.columns])


def duplicates(docs: DataFrame) -> DataFrame:
    """The report per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return resolve(docs).select("doc_id", "keep_id", "group_size", "kept",
                                F.lower(F.hex("digest")).alias("text_sha256"))
