"""A trie of conversation prefixes, aggregated with ROLLUP over positional columns of turn ids.

A conversation is cut into blocks of ``COLUMNS`` turns, one row each, with a column of turn ids per position.
``GROUP BY block, start, ROLLUP (t0 ... t7)`` with ``grouping_id`` then aggregates all prefixes of all blocks
together, with map-side combining. ``start`` is the key of the node in which the preceding block ended, a digest
of everything before, so that long conversations go on in further blocks; it comes from a tree of digests over
the blocks, in a number of rounds that grows with the logarithm of the longest conversation.

No step walks down the trie. The nodes that have a conversation as their smallest member form one chain that
ends in its last turn, so every node belongs to one conversation. What a subtree sums is then a sum over the
members of its top (all of what they own, less what the smallest member owns above the top), which a second
ROLLUP gives.

Defined cases: a null role or text is empty; turns are ordered by turn (null first), then by a digest of role and
text, so repeated rows are repeated turns; rows with a null conv_id belong to no conversation and are left out;
members without turns belong to the root only; an empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import with_position
from docsieve.session import stage

#: Turns per row, and digests per node of the tree over the blocks.
COLUMNS = 8
FAN = 32
#: Members' ids are first joined in runs of 2**CHUNK_BITS neighbouring ids, so no row grows with a hot node.
CHUNK_BITS = 12
_T = [f"t{i}" for i in range(COLUMNS)]


def _none() -> Column:
    return F.lit("").cast("binary")


def _root() -> Column:
    return F.lit("root").cast("binary")


def _digest(kind: str, *parts: Column) -> Column:
    """SHA-256 as binary; ``kind`` keeps digests of different things apart."""
    return F.unhex(F.sha2(F.concat(F.lit(kind).cast("binary"), *parts), 256))


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, _none(), lambda a, x: F.concat(a, x))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (place in the conversation, from 1), id (digest of role and text), chars (code points).

    Places come from a global range sort, so a conversation may be spread over any number of tasks.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        "conv_id", F.col("turn").isNotNull().alias("known"), "turn",
        _digest("t", F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("id"),
        F.length(text).cast("long").alias("chars"))
    placed = with_position(rows, "conv_id", "known", "turn", "id")
    first = placed.groupBy("conv_id").agg(F.min("position").alias("first"))
    return placed.join(first, "conv_id").select(
        "conv_id", (F.col("position") - F.col("first") + 1).alias("at"), "id", "chars")


def with_shared_openings(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that open alike: c takes the first h turns of c - c % group in place of its own first h,
    h = crc32(decimal c) % most; fewer if that conversation is shorter (% keeps the sign, as in SQL). Returns turns as from ``ordered_turns``
    and the ids of all conversations, of which some may have no turn left."""
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = (F.col("conv_id") - F.col("conv_id") % group).alias("base")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    lender = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    plan = own.select("conv_id", base, h).join(lender, "base", "left").withColumn(
        "lent", F.least("h", F.coalesce("n_base", F.lit(0))))
    rest = turns.join(plan.select("conv_id", "h", "lent"), "conv_id").where("at > h").select(
        "conv_id", (F.col("at") - F.col("h") + F.col("lent")).alias("at"), "id", "chars")
    openings = turns.where((F.col("conv_id") % group == 0) & (F.col("at") < most)).withColumnRenamed("conv_id", "base")
    lent = plan.where("lent > 0").select("conv_id", "base", F.explode(F.sequence(F.lit(1), F.col("lent"))).alias(
        "at")).join(openings, ["base", "at"]).select("conv_id", "at", "id", "chars")
    return rest.unionByName(lent), own.select("conv_id")


def _through(full: DataFrame, last: int) -> DataFrame:
    """For segments (conv_id, i, digest, chars) numbered from 0: conv_id, i, key and chars of all up to i.

    Runs of FAN segments make the segments of the next level, so ``last``, the largest number, falls by that factor.
    """
    runs = full.groupBy("conv_id", F.floor(F.col("i") / FAN).alias("run")).agg(
        F.array_sort(F.collect_list(F.struct("i", "digest", "chars"))).alias("s"))
    runs = runs.withColumns({"key": F.lit(None).cast("binary"), "before": F.lit(0).cast("long")})
    if last >= FAN:
        whole = runs.where(F.size("s") == FAN).select(
            "conv_id", F.col("run").alias("i"), _digest("g", _joined(F.col("s.digest"))).alias("digest"),
            F.aggregate("s.chars", F.lit(0).cast("long"), lambda a, x: a + x).alias("chars"))
        upper = _through(whole, last // FAN).select(
            "conv_id", (F.col("i") + 1).alias("run"), F.col("key").alias("_key"), F.col("chars").alias("_before"))
        runs = runs.join(upper, ["conv_id", "run"], "left").select(
            "conv_id", "run", "s", F.col("_key").alias("key"), F.coalesce("_before", F.lit(0)).alias("before"))
    up_to = F.transform("s", lambda x, j: F.struct(
        x["i"].alias("i"),
        _digest("b", F.coalesce("key", _none()), _joined(F.slice(F.col("s.digest"), F.lit(1), j + 1))).alias("key"),
        (F.col("before") + F.aggregate(F.slice(F.col("s.chars"), F.lit(1), j + 1), F.lit(0).cast("long"),
                                       lambda a, c: a + c)).alias("chars")))
    return runs.select("conv_id", F.inline(up_to))


def _blocks(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row per block: conv_id, block, n_turns and total (of the conversation), start, before, t0 ... t7."""
    marks = members.select("conv_id", F.lit(0).cast("long").alias("block"), F.lit(None).cast(
        "struct<slot:bigint,id:binary,chars:bigint>").alias("t"))
    cut = turns.select(
        "conv_id", F.floor((F.col("at") - 1) / COLUMNS).alias("block"),
        F.struct(((F.col("at") - 1) % COLUMNS).alias("slot"), "id", "chars").alias("t")).unionByName(marks)
    cut = stage(cut.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("t")).alias("t")), "blocks")
    last = cut.agg(F.max("block")).first()[0] or 0
    full = cut.where(F.size("t") == COLUMNS).select(
        "conv_id", F.col("block").alias("i"), _digest("k", _joined(F.col("t.id"))).alias("digest"),
        F.aggregate("t.chars", F.lit(0).cast("long"), lambda a, x: a + x).alias("chars"))
    through = stage(_through(full, last), "through")
    ends = through.select("conv_id", F.col("i").alias("block"), F.col("key").alias("next"))
    starts = through.select("conv_id", (F.col("i") + 1).alias("block"), F.col("key").alias("start"),
                            F.col("chars").alias("before"))
    sums = cut.groupBy("conv_id").agg(
        F.sum(F.size("t")).cast("long").alias("n_turns"),
        F.sum(F.aggregate("t.chars", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))
    rows = cut.join(sums, "conv_id").join(starts, ["conv_id", "block"], "left").join(
        ends, ["conv_id", "block"], "left")

    def column(j: int) -> Column:
        t = F.get("t", F.lit(j))
        following = F.col("next") if j == COLUMNS - 1 else F.lit(None).cast("binary")
        return F.when(t.isNotNull(), F.struct(t["id"].alias("id"), t["chars"].alias("chars"), following.alias(
            "next"))).alias(_T[j])

    return stage(rows.select(
        "conv_id", "block", "n_turns", "total", F.coalesce("start", _none()).alias("start"),
        F.coalesce("before", F.lit(0)).alias("before"), *[column(j) for j in range(COLUMNS)]), "rows")


def _key(filled: Column) -> Column:
    """The key of the node after the first ``filled`` turns of a block, with something after its start."""
    ids = F.transform(F.slice(F.array(*_T), F.lit(1), filled), lambda t: t["id"])
    return F.when(filled == COLUMNS, F.col(_T[-1])["next"]).otherwise(_digest("n", F.col("start"), _joined(ids)))


def _above(filled: Column) -> Column:
    """The key of the node before the last of ``filled`` turns."""
    return F.when(filled > 1, _key(filled - 1)).when(F.col("block") > 0, F.col("start")).otherwise(_root())


def _rolled_up(rows: DataFrame, measures: str) -> DataFrame:
    """All prefixes of all blocks: block, start, t0 ... t7, filled (turns of the prefix in its block), measures."""
    columns = ", ".join(_T)
    found = rows.sparkSession.sql(
        f"SELECT block, start, {columns}, {COLUMNS} - bit_count(grouping_id()) AS filled, {measures} "
        f"FROM {{rows}} GROUP BY block, start, ROLLUP({columns})", rows=rows)
    # A prefix that ends in a missing turn is no prefix; a block's empty prefix is the node before it.
    top = F.get(F.array(*_T), F.col("filled") - 1)
    return found.where(F.when(F.col("filled") > 0, top.isNotNull()).otherwise(F.col("block") == 0))


def _end_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One SHA-256 per key over its comma-joined runs of ids, which come sorted; no list is held."""
    key, digest = None, None
    for batch in batches:
        done = []
        for k, ids in zip(batch["key"], batch["ids"]):
            k = bytes(k)
            if k != key:
                if key is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pd.DataFrame(done, columns=["key", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(key, digest.hexdigest())], columns=["key", "ends_sha256"])


def _ends(rows: DataFrame) -> DataFrame:
    """key, ends_sha256 of the nodes in which conversations end."""
    filled = (F.col("n_turns") - F.col("block") * COLUMNS).cast("int")
    last = rows.where((filled <= COLUMNS) & ((filled > 0) | (F.col("n_turns") == 0)))
    runs = last.select("conv_id", F.when(filled > 0, _key(filled)).otherwise(_root()).alias("key")).groupBy(
        "key", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return runs.repartition("key").sortWithinPartitions("key", "chunk").select("key", "ids").mapInPandas(
        _end_digests, "key binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node, named by its smallest member (conv_id) and depth.

    ``turns`` as from ``ordered_turns``; ``members`` (conv_id) are all conversations, once each. Columns: conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    rows = _blocks(turns, members)
    filled = F.col("filled")
    inside = F.aggregate(F.slice(F.array(*_T), F.lit(1), F.greatest(filled - 1, F.lit(0))), F.lit(0).cast("long"),
                         lambda a, t: a + t["chars"])
    nodes = _rolled_up(rows, "min(conv_id) AS conv_id, count(*) AS n_convs, min(before) AS before").select(
        F.when(filled > 0, _key(filled)).otherwise(_root()).alias("key"),
        F.when(filled > 0, _above(filled)).alias("parent_key"), (F.col("block") * COLUMNS + filled).alias("depth"),
        "conv_id", "n_convs", (F.col("before") + inside).alias("before"),
        F.when(filled > 0, F.get(F.array(*_T), filled - 1)["chars"]).otherwise(F.lit(0)).cast("long").alias("chars"))
    nodes = stage(nodes, "nodes")
    # The chain of each conversation that is some node's smallest member. Only its top has another's node above it.
    chains = nodes.groupBy("conv_id").agg(
        F.sum("chars").alias("owned"), F.min("depth").alias("top"), F.max("depth").alias("bottom"))
    tops = nodes.join(chains.select("conv_id", F.col("top").alias("depth")), ["conv_id", "depth"])
    branches = tops.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(
        F.count("*").alias("branches"))
    nodes = nodes.join(branches, "key", "left").withColumn("branches", F.coalesce("branches", F.lit(0)))
    nodes = stage(nodes, "nodes")
    above = tops.where("parent_key is not null").select("conv_id", F.col("parent_key").alias("key")).join(
        nodes.select("key", F.col("conv_id").alias("above")), "key").select("conv_id", "above")
    bare = nodes.join(chains.select("conv_id", F.col("bottom").alias("depth")), ["conv_id", "depth"]).where(
        "branches = 0").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    totals = rows.where("block = 0").select("conv_id", "total")
    chains = chains.join(above, "conv_id", "left").join(bare, "conv_id", "left").join(totals, "conv_id")
    chains = stage(chains, "chains")
    owned = rows.join(chains.select("conv_id", "owned", "leaf"), "conv_id", "left")
    sums = _rolled_up(owned, "sum(total) AS all_chars, sum(coalesce(owned, 0)) AS all_owned, "
                             "sum(coalesce(leaf, 0)) AS n_leaves").select(
        F.when(filled > 0, _key(filled)).otherwise(_root()).alias("key"), "all_chars", "all_owned", "n_leaves")
    whole = nodes.join(sums, "key").join(_ends(rows), "key", "left").join(
        chains.select("conv_id", "owned", "total", "top", "bottom", "above"), "conv_id")
    # Characters with repeats, then each node's once: what the members own but for the top member's part above.
    said = F.col("all_chars") - F.col("n_convs") * F.col("before")
    once = F.col("all_owned") - F.col("owned") + F.col("total") - F.col("before")
    return whole.select(
        "conv_id", F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("above")).alias("parent_conv_id"),
        "n_convs", (F.col("branches") + (F.col("depth") < F.col("bottom")).cast("long")).alias("n_children"),
        "n_leaves", (said - once).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
