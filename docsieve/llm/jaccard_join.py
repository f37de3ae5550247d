"""Exact similarity join of documents by the Jaccard measure of their word shingles.

Tokens are 64-bit hashes of five-word shingles. Every document orders its tokens by class, rare before
frequent, then by hash. Two sets that reach the threshold share a token among their first
``n - ceil(t n) + 1``; rare tokens there are indexed singly. A document with frequent tokens in that prefix
extends it by g tokens: similar sets then share at least g + 1 tokens, so of g hash classes one holds two of
them, and pairs of tokens of one class are indexed in place of single ones. g follows the set size, which keeps
the number of combinations in proportion to the prefix. Classes only steer the cost: any set of frequent tokens
gives the same links.

Within an index entry the members are not paired with each other. First each is verified against the entry's
first document; what this does not connect is paired across the components found so far, and verified too. So a
group of n near copies costs about n verifications, and no link between components is lost.

Defined cases: a null or wordless text has no shingles and no links; fewer than five words are one shingle;
rows of a null doc_id are counted but not linked; rows with the same doc_id are one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import components, pair_texts
from docsieve.llm.words import folded, mixed, shingle_set, shingle_sets
from docsieve.session import stage

#: The threshold as a fraction, so that all bounds are whole numbers.
T_NUM, T_DEN = 3, 4
#: A token in at least FREQUENT documents is of the frequent class; at most MAX_FREQUENT are told to the tasks
#: (8 bytes each), the most frequent ones. The others count as rare, which costs time and no link.
FREQUENT = 64
MAX_FREQUENT = 200_000
#: Sets up to this size index single tokens of any class.
SMALL = 7
#: Set sizes and bounds share a long; a text has fewer than 2**31 characters, so no set comes near this.
_BITS = 31
_LIMIT = 1 << _BITS


def least_partner(n: int) -> int:
    return -(-T_NUM * n // T_DEN)


def most_partner(n: int, at: int) -> int:
    """The largest set that can still match one of size n whose first shared token is at place ``at``."""
    return (T_NUM + T_DEN) * (n - at) // T_NUM - n


def size_class(n: int) -> int:
    return (n // 4).bit_length() - 1


def signatures(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index entries of a set (sorted tokens) and, for each, the largest partner it can have there."""
    n = len(tokens)
    at = np.minimum(np.searchsorted(frequent, tokens), max(len(frequent) - 1, 0))
    often = frequent[at] == tokens if len(frequent) else np.zeros(n, bool)
    rare, common = tokens[~often], tokens[often]
    prefix = n - least_partner(n) + 1
    place = np.arange(min(len(rare), prefix))
    sig, most = [rare[:prefix]], [most_partner(n, place)]
    if len(rare) < prefix:
        low = least_partner(n)
        if low <= SMALL:
            place = np.arange(len(rare), prefix)
            sig.append(common[:prefix - len(rare)])
            most.append(most_partner(n, place))
        if n > SMALL:
            for c in range(size_class(max(low, SMALL + 1)), size_class(n) + 1):
                g = 1 << c
                part = common[:prefix + g - len(rare)]
                group = (part >> np.uint64(20)) & np.uint64(g - 1)
                order = np.argsort(group, kind="stable")
                ends = np.flatnonzero(np.diff(group[order])) + 1
                for members in np.split(order, ends):
                    if len(members) < 2:
                        continue
                    i, j = np.triu_indices(len(members), 1)
                    i, j = members[i], members[j]
                    with np.errstate(over="ignore"):
                        sig.append(mixed(part[i] * np.uint64(3) + mixed(part[j]) + np.uint64(c)))
                    # Up to the first such pair, each of the g classes has one shared token at most.
                    most.append(most_partner(n, np.maximum(len(rare) + np.maximum(i, j) - g, 0)))
    sig, most = np.concatenate(sig), np.concatenate(most).astype(np.int64)
    keep = most >= least_partner(n)
    return sig[keep], np.minimum(most[keep], _LIMIT - 1)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return bool(both) and T_DEN * both >= T_NUM * (len(a) + len(b) - both)


#: Words of a parity bitmap: each bit says whether an odd number of a set's tokens hash to it.
BITMAP = [f"b{i}" for i in range(32)]
#: A coarser bitmap, folded from it, for rows of which there are many.
COARSE = [f"c{i}" for i in range(8)]
#: Sets from this size on fill both bitmaps evenly and have a third, as wide as the set is large.
WIDE = 3000
_PROFILE = "wide binary, kind int, doc_id bigint, key bigint, key2 bigint, n bigint, " + ", ".join(f"{b} bigint" for b in BITMAP)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    odd = np.bincount((tokens >> np.uint64(53)).astype(np.int64), minlength=64 * len(BITMAP)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_bitmap(tokens: np.ndarray) -> bytes:
    """A parity bitmap of the least power of two bits that is no less than the number of tokens."""
    bits = 1 << (len(tokens) - 1).bit_length()
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _differing(a: bytes, b: bytes) -> int:
    """Bits that differ; the wider bitmap is folded to the width of the other, which keeps the parity."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def _wide_match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bound of ``_may_match`` by wide bitmaps, where both sides have one."""
    for batch in batches:
        keep = [x is None or y is None or (T_NUM + T_DEN) * (n - _differing(x, y)) >= 2 * T_NUM * n
                for x, y, n in zip(batch["wide_a"], batch["wide_b"], (batch["n_a"] + batch["n_b"]).tolist())]
        yield batch.loc[np.array(keep, bool), ["a", "b"]]


def _profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per row its set size and text digest (kind 0); per token that a task meets again, a count (kind 1)."""
    seen, held = [], 0
    done: set[bytes] = set()

    def counted() -> pd.DataFrame:
        token, n = np.unique(np.concatenate(seen), return_counts=True)
        token, n = token[n > 1], n[n > 1]
        return pd.DataFrame({"wide": None, "kind": 1, "doc_id": -1, "key": token.view(np.int64), "key2": 0, "n": n}
                            | dict.fromkeys(BITMAP, 0))

    for batch in batches:
        rows = []
        texts = [folded(t) for t in batch["text"]]
        for doc_id, text, tokens in zip(batch["doc_id"], texts, shingle_sets(texts)):
            digest = hashlib.md5(text).digest()
            rows.append((wide_bitmap(tokens) if len(tokens) >= WIDE else None, 0, doc_id, int.from_bytes(digest[:8], "big", signed=True),
                         int.from_bytes(digest[8:], "big", signed=True), len(tokens), *bitmap(tokens)))
            if digest not in done:
                done.add(digest)
                seen.append(tokens)
                held += len(tokens)
            if held > 4_000_000:
                yield counted()
                seen, held = [], 0
        out = pd.DataFrame(rows, columns=["wide", "kind", "doc_id", "key", "key2", "n", *BITMAP])
        out["doc_id"] = batch["doc_id"].astype("Int64").to_numpy()
        yield out
    if seen:
        yield counted()


class _Index:
    """Index entries of each document; of equal texts in a task only the first is indexed."""

    def __init__(self, frequent: np.ndarray) -> None:
        self.frequent = frequent

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[bytes] = set()
        for batch in batches:
            sigs, ids, packed, held = [], [], [], 0
            new = []
            for doc_id, text in zip(batch["doc_id"], map(folded, batch["text"])):
                digest = hashlib.md5(text).digest()
                if digest not in done:
                    done.add(digest)
                    new.append((doc_id, text))
            for (doc_id, _), tokens in zip(new, shingle_sets(t for _, t in new)):
                if not len(tokens):
                    continue
                sig, most = signatures(tokens, self.frequent)
                sigs.append(sig.view(np.int64))
                ids.append(np.full(len(sig), doc_id, np.int64))
                packed.append((len(tokens) << _BITS) + most)
                held += len(sig)
                if held > 500_000:
                    yield _entries(sigs, ids, packed)
                    sigs, ids, packed, held = [], [], [], 0
            if sigs:
                yield _entries(sigs, ids, packed)


def _entries(sigs: list, ids: list, packed: list) -> pd.DataFrame:
    return pd.DataFrame({"sig": np.concatenate(sigs), "doc_id": np.concatenate(ids),
                         "packed": np.concatenate(packed)})


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members of entries with two or more, each with the entry's first; the rows come sorted by entry."""
    last: tuple | None = None  # the first row of the entry that the previous batch ended in, and if it was given
    for batch in batches:
        if not len(batch):
            continue
        sig, ids, packed = (batch[c].to_numpy() for c in ("sig", "doc_id", "packed"))
        start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        count = np.diff(np.r_[start, len(sig)])
        hub, hub_packed = np.repeat(ids[start], count), np.repeat(packed[start], count)
        many = np.repeat(count > 1, count)
        extra = None
        given = bool(count[-1] > 1)
        if last is not None and last[0] == sig[0]:
            hub[:count[0]], hub_packed[:count[0]], many[:count[0]] = last[1], last[2], True
            if not last[3]:
                extra = (last[0], last[1], last[2])
            given = given or len(start) == 1
        tail = len(sig) - 1
        last = (sig[tail], hub[tail], hub_packed[tail], given)
        out = pd.DataFrame({"sig": sig[many], "doc_id": ids[many], "packed": packed[many], "hub": hub[many],
                            "hub_packed": hub_packed[many]})
        if extra:
            out = pd.concat([pd.DataFrame([(*extra, extra[1], extra[2])], columns=out.columns), out])
        yield out


def _compatible(a: str, b: str):
    """Each of two members can be as large as the other, by the places where they meet."""
    n_a, n_b = F.shiftright(F.col(a), _BITS), F.shiftright(F.col(b), _BITS)
    low, top = F.lit(_LIMIT - 1), F.lit(T_DEN)
    return (F.col(a).bitwiseAND(low) >= n_b) & (F.col(b).bitwiseAND(low) >= n_a) & (
        top * n_a >= T_NUM * n_b) & (top * n_b >= T_NUM * n_a)


def _may_match(a: str, b: str, words: list[str] = BITMAP):
    """Bits that differ are tokens that differ, so they bound the overlap of two sets from above."""
    n_a, n_b = F.shiftright(F.col(a), _BITS), F.shiftright(F.col(b), _BITS)
    differ = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in words), F.lit(0))
    return (T_NUM + T_DEN) * (n_a + n_b - differ) >= 2 * T_NUM * (n_a + n_b)


def _with_bits(pairs: DataFrame, bits: DataFrame, sides: str = "ab") -> DataFrame:
    for side in sides:
        pairs = pairs.join(bits.select(F.col("doc_id").alias(side), *[F.col(w).alias(f"{w}_{side}") for w in BITMAP]),
                           side)
    return pairs


def _promising(pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) that no bitmap rules out; no text is read for the others."""
    known = profile.where("kind = 0 and n > 0 and doc_id is not null")
    pairs = _with_bits(pairs, known).where(_may_match("packed_a", "packed_b")).select("a", "b").distinct()
    for side in "ab":  # every row of an id, so that of rows with one id none is judged by another's size
        pairs = pairs.join(known.select(F.col("doc_id").alias(side), F.col("n").alias(f"n_{side}"),
                                        F.col("wide").alias(f"wide_{side}")), side)
    return pairs.mapInPandas(_wide_match, "a bigint, b bigint").distinct()


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sets: dict = {}

    def tokens(doc_id: int, text: str) -> np.ndarray:
        found = sets.get(doc_id)
        if found is None or found[0] != text:
            if len(sets) > 256:
                sets.clear()
            sets[doc_id] = found = (text, shingle_set(text))
        return found[1]

    for batch in batches:
        keep = [similar(tokens(a, x), tokens(b, y)) for a, b, x, y in zip(
            batch["a"], batch["b"], batch["text_a"], batch["text_b"])]
        yield batch.loc[np.array(keep, bool), ["a", "b"]]


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts reach the threshold."""
    return pair_texts(pairs, texts).select("a", "b", "text_a", "text_b").mapInPandas(_verify, "a bigint, b bigint")


def frequent_tokens(profile: DataFrame) -> np.ndarray:
    """The most frequent tokens: a list of bounded size, from counts that each task has combined."""
    rows = profile.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).where(
        F.col("n") >= FREQUENT).orderBy(F.desc("n"), "key").limit(MAX_FREQUENT).select("key").toPandas()
    return np.sort(rows["key"].to_numpy(np.int64).view(np.uint64))


def similarity_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The set size per row (doc_id, n), and links (src, dst) whose closure is that of all similar pairs."""
    texts = docs.select("doc_id", "text")
    profile = stage(texts.mapInPandas(_profile, _PROFILE), "profile")
    frequent = frequent_tokens(profile)
    known = texts.where("doc_id is not null and text is not null")
    entries = known.mapInPandas(_Index(frequent), "sig bigint, doc_id bigint, packed bigint")
    shared = stage(entries.repartition("sig").sortWithinPartitions("sig", "doc_id").mapInPandas(
        _shared, "sig bigint, doc_id bigint, packed bigint, hub bigint, hub_packed bigint"), "shared")
    by_id = known.withColumnRenamed("doc_id", "id")
    # Copies: every row of a digest group points to its smallest id.
    rows = profile.where("kind = 0 and n > 0 and doc_id is not null")
    first = rows.groupBy("key", "key2").agg(F.min("doc_id").alias("dst"), F.count("*").alias("m")).where("m > 1")
    copies = rows.join(first.drop("m"), ["key", "key2"]).select(F.col("doc_id").alias("src"), "dst").where(
        "src <> dst")
    bits = rows.select("doc_id", *BITMAP)
    stars = shared.where("doc_id <> hub").where(_compatible("packed", "hub_packed")).groupBy(
        F.col("hub").alias("a"), F.col("doc_id").alias("b")).agg(
        F.first("hub_packed").alias("packed_a"), F.first("packed").alias("packed_b"))
    stars = stage(_promising(stars, profile), "stars")
    near = verified(stars, by_id).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    links = stage(copies.union(near), "links")
    group = components(links)
    placed = shared.select("sig", "doc_id", "packed").join(
        group.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id"))
    placed = stage(placed, "placed")
    mixed_entries = placed.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).where(
        "x < y").select("sig")
    coarse = bits.select("doc_id", *[F.col(f"b{i}").bitwiseXOR(F.col(f"b{i + 8}")).bitwiseXOR(F.col(
        f"b{i + 16}")).bitwiseXOR(F.col(f"b{i + 24}")).alias(c) for i, c in enumerate(COARSE)])
    open_rows = stage(placed.join(mixed_entries, "sig").join(coarse, "doc_id"), "open")
    fields = ("doc_id", "packed", "component", *COARSE)
    left = open_rows.select("sig", *[F.col(c).alias(f"{c}_a") for c in fields])
    right = open_rows.select("sig", *[F.col(c).alias(f"{c}_b") for c in fields])
    cross = left.join(right, (left["sig"] == right["sig"]) & (F.col("component_a") < F.col("component_b"))
                      & _compatible("packed_a", "packed_b") & _may_match("packed_a", "packed_b", COARSE))
    first_a = F.col("doc_id_a") < F.col("doc_id_b")
    cross = cross.groupBy(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")).agg(
        F.first(F.when(first_a, F.col("packed_a")).otherwise(F.col("packed_b"))).alias("packed_a"),
        F.first(F.when(first_a, F.col("packed_b")).otherwise(F.col("packed_a"))).alias("packed_b"))
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = stage(_promising(cross.join(tried, ["a", "b"], "left_anti"), profile), "cross")
    more = verified(cross, by_id).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return profile.where("kind = 0").select("doc_id", "n"), links.union(stage(more, "links"))


def similar_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id per row of ``docs``."""
    sizes, links = similarity_links(docs)
    group = components(links)
    return sizes.join(group, sizes["doc_id"] == group["id"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those linked to a smaller doc_id; of rows with one doc_id, all stay."""
    _, links = similarity_links(docs)
    away = components(links).where("id <> component").select(F.col("id").alias("__id__"))
    return docs.join(away, docs["doc_id"] == away["__id__"], "left_anti")
