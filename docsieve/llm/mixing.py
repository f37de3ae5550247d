"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the copies each of its documents should get; the whole part is taken,
the fraction is rounded dependently. Two documents at a time exchange fractional mass, counted in words, at
random but without bias, until one of them is taken whole or not at all. Blocks of bounded size are folded in
parallel, each leaving at most one fractional document; the residuals of a block's neighbours meet in the
next level of a reduction tree until one document per source is left. So a source's words miss its target by
less than one document, and every document's expected copies are exact.

Random numbers are hashes of the documents that meet, so reruns agree. Defined cases: a null text has size
0; documents of size 0 take 0 words; a null source is a source, the last one; repeated rows are rounded
each; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import with_position
from docsieve.session import stage

WORDS = r"[^\x20\x09-\x0D]++"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK = 1024
FAN_IN = 256


def document_sizes(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """source, doc_id, size and a row number (``row`` if given), written once: nothing later reads the texts."""
    row = F.monotonically_increasing_id() if row is None else row
    return stage(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast(
        "long").alias("size"), row.alias("row")), "sizes")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """source, n_docs, source_size, target: ``share`` of all words dealt by weight, at most ``most`` times a
    source's size; what is above is dealt again among the others. Each round is one small aggregation."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("position") % len(weights)).cast("int") + 1)
    dealt = stage(with_position(sources, "source").withColumn("weight", weight), "sources")
    total = dealt.agg(F.sum("source_size")).first()[0] or 0
    level, n_capped = 0.0, -1
    while True:
        capped = F.col("weight") * level >= most * F.col("source_size")
        if n_capped < 0:
            capped = F.lit(False)
        n, full, open_weight = dealt.agg(
            F.count_if(capped), F.sum(F.when(capped, F.col("source_size"))),
            F.sum(F.when(~capped, F.col("weight")))).first()
        if n == n_capped:
            break
        n_capped = n
        if not open_weight:
            break
        level = (share * total - most * (full or 0)) / open_weight
    return dealt.select("source", "n_docs", "source_size", F.least(
        F.col("weight") * level, F.lit(float(most)) * F.col("source_size")).alias("target"))


def _uniform(*keys: int) -> float:
    return xxhash.xxh64_intdigest(",".join(map(str, keys)), seed=20) / 2.0 ** 64


def pivot(keys: list, sizes: list[int], mass: list[float]) -> tuple[list[float], int | None]:
    """Fold masses in (0, size) until at most one is fractional: the masses and that one's place."""
    held: int | None = None
    for j, b in enumerate(sizes):
        y = mass[j]
        if y <= 0.0 or y >= b:
            continue
        if held is None:
            held = j
            continue
        a, x = sizes[held], mass[held]
        up, down = min(a - x, y), min(x, b - y)
        if _uniform(keys[held], keys[j]) * (up + down) < down:
            x, y = (a if up == a - x else x + up), (0.0 if up == y else y - up)
        else:
            x, y = (0.0 if down == x else x - down), (b if down == b - y else y + down)
        mass[held], mass[j] = x, y
        if x <= 0.0 or x >= a:
            held = j if 0.0 < y < b else None
    return mass, held


def _fold(group: pd.DataFrame) -> pd.DataFrame:
    group = group.assign(_h=[xxhash.xxh64_intdigest(str(k)) for k in group["doc_id"]]).sort_values(
        ["_h", "doc_id", "size", "mass", "row"], kind="stable").drop(columns="_h")
    keys = [-1 if pd.isna(k) else int(k) for k in group["doc_id"]]
    mass, held = pivot(keys, group["size"].tolist(), group["mass"].tolist())
    open_ = np.zeros(len(group), bool)
    if held is not None:
        open_[held] = True
    return group.assign(mass=mass, open=open_)


_UNITS = "row long, doc_id long, size long, s long, block long, mass double"


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
        most: float = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken; one row per document."""
    return _plan(document_sizes(docs), weights, share, most).drop("row")


def _plan(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
          most: float = MOST) -> DataFrame:
    """What ``mix`` gives, and row."""
    targets = with_position(source_targets(sizes, weights, share, most), "source", name="s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # The table of sources is in a file, so the optimizer knows its size and broadcasts it only if small.
    units = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).select(
        "row", "doc_id", sizes["source"], "size", "s", "source_size", "target", "n_docs", rate.alias("rate"))
    fraction = F.col("rate") - F.floor("rate")
    units = units.withColumn("whole", F.floor("rate")).withColumn("mass", fraction * F.col("size"))
    blocks = F.ceil(F.col("n_docs") / BLOCK)
    level = _blocked(units.select("row", "doc_id", "size", "s", blocks.alias("blocks"), "mass"))
    settled = None
    height = _height(targets)
    for _ in range(height):
        folded = stage(level.groupBy("s", "block").applyInPandas(_fold, _UNITS + ", open boolean"), "folded")
        done = folded.where("not open").select("row", "mass")
        settled = done if settled is None else settled.unionByName(done)
        level = folded.where("open").select("row", "doc_id", "size", "s", F.floor(
            F.col("block") / FAN_IN).alias("block"), "mass")
    # One document per source is left; it is rounded to the nearer side.
    left = level.select("row", F.when(2 * F.col("mass") >= F.col("size"), F.col("size")).otherwise(
        F.lit(0)).cast("double").alias("mass"))
    extra = settled.unionByName(left).select("row", F.col("mass").alias("rounded"))
    copies = F.col("whole") + F.when((F.col("rounded") > 0) & (F.col("size") > 0), F.lit(1)).otherwise(F.lit(0))
    return units.drop("mass").join(extra, "row").select(
        "row", "doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies")).withColumn(
        "taken", F.col("size") * F.col("copies"))


def _blocked(units: DataFrame) -> DataFrame:
    """row, doc_id, size, s, block, mass: the first blocks, by hash of id and size.

    More than a block of rows alike in source, id and size, as of a null id, are dealt in turn over all blocks of their
    source. They are interchangeable, so which of them comes where changes nothing.
    """
    hashed = F.pmod(F.xxhash64("doc_id", "size"), F.col("blocks"))
    alike = stage(units.groupBy("s", "doc_id", "size").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select(
        F.col("s").alias("_s"), F.col("doc_id").alias("_id"), F.col("size").alias("_size")), "alike")
    fields = ["row", "doc_id", "size", "s"]
    if alike.isEmpty():
        return units.select(*fields, hashed.alias("block"), "mass")
    same = (units["s"] == alike["_s"]) & units["doc_id"].eqNullSafe(alike["_id"]) & (units["size"] == alike["_size"])
    turn = with_position(units.join(alike, same, "left_semi"), "s", "doc_id", "size").select(
        *fields, F.pmod(F.col("position"), F.col("blocks")).alias("block"), "mass")
    return units.join(alike, same, "left_anti").select(*fields, hashed.alias("block"), "mass").unionByName(turn)


def _height(targets: DataFrame) -> int:
    most = targets.agg(F.max("n_docs")).first()[0] or 1
    blocks, levels = math.ceil(most / BLOCK), 1
    while blocks > 1:
        blocks, levels = math.ceil(blocks / FAN_IN), levels + 1
    return levels


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. The rows are written once with a number, so that rows
    that share an id keep copies of their own."""
    numbered = stage(docs.withColumn("__row__", F.monotonically_increasing_id()), "numbered")
    plan = _plan(document_sizes(numbered, F.col("__row__")), **options).select(
        F.col("row").alias("__row__"), F.col("copies").cast("int").alias("__copies__")).where("__copies__ > 0")
    return numbered.join(plan, "__row__").withColumn(
        "__n__", F.explode(F.array_repeat(F.lit(1), F.col("__copies__")))).select(
        *[F.col(f"`{c}`") for c in docs.columns])
