"""Shared steps: ASCII folding, ordered positions, connected components, texts of candidate pairs."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.session import stage

#: A stated bound: 20 rounds of alternating stars halve a path of a million nodes to nothing.
MAX_ROUNDS = 40


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z only; null counts as the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def with_position(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """Add the global rank (from 0, a long) of each row by ``order``, without a single-task sort.

    The rows are range-partitioned and written once, so that the offsets and the rows see the same
    partitioning; only one count per partition passes through the driver.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order]).sortWithinPartitions(
        *[F.col(c).asc_nulls_last() for c in order])
    low = F.monotonically_increasing_id()
    placed = stage(ranged.withColumn("_part", F.shiftright(low, 33)).withColumn(
        "_row", low.bitwiseAND(F.lit((1 << 33) - 1))), "positions")
    offsets, total = [], 0
    for part, rows in sorted(placed.groupBy("_part").count().collect()):
        offsets.append((part, total))
        total += rows
    table = spark.createDataFrame(offsets, "_part bigint, _offset bigint")
    return placed.join(F.broadcast(table), "_part").withColumn(
        name, F.col("_row") + F.col("_offset")).drop("_part", "_row", "_offset")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (src, dst: long): one row (id, component) per node.

    ``component`` is the smallest id of the component. Alternating large and small stars; each round is
    written to the shared folder, so that a lost executor costs one round. Minima are combined before
    the shuffle and the joins have one row per key on one side, so a hub may hold any share of the edges.
    Loops and nulls are ignored.
    """
    now = edges.select("src", "dst").where("src <> dst").select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now, last = stage(now, "edges"), None
    for _ in range(MAX_ROUNDS):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v")
        now = stage(small.distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()


def pair_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Put both texts beside each pair (a, b, ...): columns text_a and text_b are added.

    ``texts`` has id and text. Both joins have the texts on one side, so the larger side of a hot id is
    split by adaptive execution; the exchange of the texts is the same for both.
    """
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(right, "b").join(left, "a")
