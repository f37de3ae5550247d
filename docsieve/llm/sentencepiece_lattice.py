"""SentencePiece encoding and decoding over a relational lattice.

The distinct words of the corpus are exploded into substrings of bounded length and joined with the piece table, a
broadcast of the vocabulary's fixed size. A word starts with its space marks and ends where the class of characters
changes, if no piece of the table spans such a change, and otherwise at the next space; either way no piece spans two
words, which is checked. The words are shuffled once and their edges never: exploding and joining keep them where they
are. The edges of a word are grouped and folded with a higher-order aggregate: Viterbi for a unigram model, and
for a BPE model, whose segmentation no best path gives, the merges in order of their score. Words longer than
LONGEST_WORD characters, few in number, take the same merges or path in a Python task, in bounded steps.

Documents never move: the words of each input split come back as that split's table in the shared folder, and the
task that reads the split looks its words up there. So memory follows the split and not the vocabulary.

Defined cases: a null or empty text has no ids; characters without a piece become bytes, or the unknown id if the
model has none; decoding drops control ids and replaces broken UTF-8; repeated rows are encoded each.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.session import stage, staging_path

SPACE = "▁"
LONGEST_WORD = 48
_WORD = re.compile(f"[\n\t]|{SPACE}*[^{SPACE}\n\t]+|{SPACE}+")
#: Cuts as well between letters, each digit, and other characters, among them superscript digits.
_FINE = re.compile(rf"[\n\t]|{SPACE}*(?:\d|[^\W\d_{SPACE}¹²³]+|(?:[^\w{SPACE}\n\t]|[_¹²³])+)|{SPACE}+")
_UNKNOWN_COST = 10.0


@dataclass(frozen=True)
class Pieces:
    """A piece table: text, score per id; kind is "bpe" or "unigram"."""

    kind: str
    text: tuple[str, ...]
    score: tuple[float, ...]
    byte0: int | None  # id of <0x00>, the other bytes follow
    unknown: int
    control: frozenset[int]

    def __post_init__(self) -> None:
        for p in self.ids():
            if len(_WORD.findall(p)) != 1:
                raise ValueError(f"piece {p!r} spans words")

    def pattern(self) -> re.Pattern:
        """The finer division into words, unless a piece spans two of its words."""
        return _FINE if all(len(_FINE.findall(p)) == 1 for p in self.ids()) else _WORD

    def usable(self, i: int) -> bool:
        in_bytes = self.byte0 is not None and self.byte0 <= i < self.byte0 + 256
        return not in_bytes and i != self.unknown and i not in self.control

    def ids(self) -> dict[str, int]:
        return {p: i for i, p in enumerate(self.text) if self.usable(i)}

    def rank(self) -> dict[int, int]:
        """Merge order: equal scores have equal ranks."""
        order = {s: r for r, s in enumerate(sorted({self.score[i] for i in self.ids().values()}, reverse=True))}
        return {i: order[self.score[i]] for i in self.ids().values()}

    def spelled(self, text: str) -> list[int]:
        """Ids of a character that has no piece."""
        if self.byte0 is None:
            return [self.unknown]
        return [self.byte0 + b for b in text.encode("utf-8", "replace")]


def load_pieces(model_file: str, kind: str = "bpe") -> Pieces:
    """The piece table of a SentencePiece model file, read on the driver."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = sp.get_piece_size()
    byte = [i for i in range(n) if sp.is_byte(i)]
    if byte and (len(byte) != 256 or byte != list(range(byte[0], byte[0] + 256))):
        raise ValueError("byte pieces must be 256 ids in a row")
    return Pieces(kind, tuple(sp.id_to_piece(i) for i in range(n)), tuple(sp.get_score(i) for i in range(n)),
                  byte[0] if byte else None, sp.unk_id(), frozenset(i for i in range(n) if sp.is_control(i)))


def split_text(text: str | None, pattern: re.Pattern = _WORD) -> list[str]:
    return pattern.findall(SPACE + text.replace(" ", SPACE)) if text else []


#: Characters handled at a time, unless one text has more.
_AT_ONCE = 1_000_000


def _portions(batch: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    """The split and some of its rows at a time, in order."""
    for split, rows in batch.groupby("split", sort=False):
        chars = rows["text"].str.len().fillna(0).cumsum()
        for _, some in rows.groupby(chars // _AT_ONCE, sort=False):
            yield split, some


class _SplitWords:
    """The distinct words of each input split."""

    def __init__(self, pattern: re.Pattern) -> None:
        self.pattern = pattern

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[str] = set()
        split = None
        for batch in batches:
            for part, rows in _portions(batch):
                if part != split:
                    split, seen = part, set()
                new = set(chain.from_iterable(split_text(t, self.pattern) for t in rows["text"])) - seen
                seen |= new
                yield pd.DataFrame({"word": pd.Series(sorted(new), dtype=object), "split": split})


def _edges(words: DataFrame, pieces: Pieces) -> DataFrame:
    """word, splits, edges: the pieces (place, id, rank, score) inside each word, the place as at * 64 + len.

    ``words`` is already distributed by word, so grouping needs no exchange; only the first row of a word
    carries its splits. Words above LONGEST_WORD get no edges.
    """
    spark = words.sparkSession
    rank = pieces.rank()
    table = spark.createDataFrame(
        [(p, i, rank[i], float(pieces.score[i])) for p, i in pieces.ids().items()],
        "piece string, id int, rank int, score double")
    longest = max(map(len, pieces.ids()))
    n = F.when(F.length("word") <= LONGEST_WORD, F.length("word")).otherwise(1)
    spots = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(longest), n - i + 1)), lambda k: (i * 64 + k))))
    parts = words.select("word", "splits", F.explode(spots).alias("place")).select(
        "word", F.when(F.col("place") == 65, F.col("splits")).alias("splits"), "place",
        F.expr("substring(word, div(place, 64), place % 64)").alias("piece"))
    # The table has one row per piece of the model: a fixed size.
    found = parts.join(F.broadcast(table), "piece", "left").where("id is not null or place = 65")
    value = "rank" if pieces.kind == "bpe" else "score"
    edge = F.when(F.col("id").isNotNull(), F.struct("place", "id", value))
    return found.groupBy("word").agg(
        F.first("splits", ignorenulls=True).alias("splits"), F.collect_list(edge).alias("edges"))


def _spelled(char: Column, pieces: Pieces) -> Column:
    if pieces.byte0 is None:
        return F.array(F.lit(pieces.unknown))
    digits = F.hex(F.encode(char, "UTF-8"))
    return F.transform(F.sequence(F.lit(1), (F.length(digits) / 2).cast("int")), lambda j: F.conv(
        F.substring(digits, j * 2 - 1, F.lit(2)), 16, 10).cast("int") + pieces.byte0)


def _ids_of(cuts: Column, ids: Column, pieces: Pieces) -> Column:
    """Ids of the pieces between neighbouring cuts (1-based places of the first characters, then the end)."""

    def one(k: Column) -> Column:
        at, size = F.get(cuts, k), F.get(cuts, k + 1) - F.get(cuts, k)
        found = F.try_element_at(ids, at * 64 + size)
        return F.when(found.isNotNull(), F.array(found)).otherwise(
            _spelled(F.substring(F.col("word"), at, size), pieces))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(cuts) - 2), one))


def _by_place(value: str) -> Column:
    return F.map_from_entries(F.transform("edges", lambda e: F.struct(e["place"].alias("k"), e[value].alias("v"))))


def _merged(lattice: DataFrame, pieces: Pieces) -> DataFrame:
    """Fold for BPE: the pair of neighbours with the best score merges, the leftmost of equal ones, until none can.

    The state holds, per part, where it begins and the rank of its merge with the next part (null if there is
    none), so a step looks up two ranks only; the last entry is the end of the word.
    """
    lattice = lattice.withColumn("ranks", _by_place("rank")).withColumn("ids", _by_place("id"))
    n = F.length("word")

    def part(at: Column, stop: Column) -> Column:
        return F.struct(F.try_element_at(F.col("ranks"), at * 64 + stop - at).alias("r"), at.alias("at"))

    every = F.transform(F.sequence(F.lit(1), n + 1), lambda i: part(i, i + 2))

    def step(parts: Column, _: Column) -> Column:
        best = F.array_min(F.filter(parts, lambda p: p["r"].isNotNull()))

        def after(best: Column) -> Column:
            k = F.array_position(parts, best).cast("int")  # from 1; the part k + 1 goes
            left, end = F.get(parts, k - 2), F.get(parts, k + 1)
            beyond = F.get(parts, k + 2)
            joined = F.array(F.when(beyond.isNotNull(), part(best["at"], beyond["at"])).otherwise(
                F.struct(F.lit(None).cast("int").alias("r"), best["at"].alias("at"))))
            before = F.when(k > 1, F.concat(F.slice(parts, 1, k - 2), F.array(part(left["at"], end["at"])))).otherwise(
                F.slice(parts, 1, 0))
            return F.concat(before, joined, F.slice(parts, k + 2, F.size(parts)))

        return F.when(best.isNull(), parts).otherwise(F.get(F.transform(F.array(best), after), F.lit(0)))

    parts = F.aggregate(F.sequence(F.lit(1), n), every, step)
    cuts = F.when(n <= LONGEST_WORD, F.transform(parts, lambda p: p["at"]))
    return lattice.withColumn("cuts", cuts).select("word", "splits", _ids_of(F.col("cuts"), F.col("ids"), pieces).alias(
        "found"))


def _best_path(lattice: DataFrame, pieces: Pieces) -> DataFrame:
    """Fold for a unigram model: the path of the highest total score; a character without a piece costs most."""
    lowest = min(pieces.score[i] for i in pieces.ids().values()) - _UNKNOWN_COST
    lattice = lattice.withColumn("ids", _by_place("id"))
    begin = F.struct(F.array(F.lit(0.0)).alias("score"), F.array(F.lit(0)).alias("back"))

    def step(state: Column, end: Column) -> Column:  # the place after the piece, 2 for the first character
        def at(e: Column) -> Column:
            return F.floor(e["place"] / 64).cast("int")

        ways = F.transform(F.filter("edges", lambda e: at(e) + e["place"] % 64 == end), lambda e: F.struct(
            (F.get(state["score"], at(e) - 1) + e["score"]).alias("total"), (-(e["place"] % 64)).alias("len")))
        alone = F.struct((F.get(state["score"], end - 2) + lowest).alias("total"), F.lit(-1).alias("len"))
        best = F.array_max(F.concat(ways, F.array(alone)))
        return F.struct(F.concat(state["score"], F.array(best["total"])).alias("score"),
                        F.concat(state["back"], F.array(-best["len"])).alias("back"))

    n = F.when(F.length("word") <= LONGEST_WORD, F.length("word"))
    state = F.aggregate(F.sequence(F.lit(2), n + 1), begin, step)
    lattice = lattice.withColumn("back", state["back"])
    cuts = F.aggregate(F.sequence(F.lit(1), n), F.array(n + 1), lambda cuts, _: F.when(
        F.get(cuts, F.lit(0)) > 1, F.concat(F.array(F.get(cuts, F.lit(0)) - F.get(F.col("back"), F.get(
            cuts, F.lit(0)) - 1)), cuts)).otherwise(cuts))
    return lattice.withColumn("cuts", cuts).select("word", "splits", _ids_of(F.col("cuts"), F.col("ids"), pieces).alias(
        "found"))


def merge_long(word: str, pieces: Pieces, ids: dict[str, int], rank: dict[int, int]) -> list[int]:
    """The same merges with a heap, for words too long for an array per step."""
    part, after, before = list(word), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap: list[tuple[int, int, str]] = []

    def offer(i: int) -> None:
        j = after[i]
        if 0 <= i and j < len(part):
            both = part[i] + part[j]
            found = ids.get(both)
            if found is not None:
                heapq.heappush(heap, (rank[found], i, both))

    for i in range(len(part) - 1):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i] if part[i] else len(part)
        if j >= len(part) or not part[i] or part[i] + part[j] != both:
            continue
        part[i], part[j] = both, ""
        after[i] = after[j]
        if after[j] < len(part):
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return list(chain.from_iterable([ids[p]] if p in ids else pieces.spelled(p) for p in part if p))


def path_long(word: str, pieces: Pieces, ids: dict[str, int]) -> list[int]:
    longest = max(map(len, ids))
    lowest = min(pieces.score[i] for i in ids.values()) - _UNKNOWN_COST
    score, back = [0.0], [0]
    for end in range(1, len(word) + 1):
        ways = [(score[end - 1] + lowest, -1)]
        for k in range(1, min(longest, end) + 1):
            i = ids.get(word[end - k:end])
            if i is not None:
                ways.append((score[end - k] + pieces.score[i], -k))
        total, k = max(ways)
        score.append(total)
        back.append(-k)
    cuts, end = [], len(word)
    while end > 0:
        cuts.append(word[end - back[end]:end])
        end -= back[end]
    return list(chain.from_iterable([ids[p]] if p in ids else pieces.spelled(p) for p in reversed(cuts)))


def _long_words(pieces: Pieces):
    """A column function for words above LONGEST_WORD; null stays null."""
    both = []  # made in the task, at its first long word

    @F.pandas_udf("array<int>")
    def found(words: pd.Series) -> pd.Series:
        if not both and words.notna().any():
            both.extend((pieces.ids(), pieces.rank()))
        one = (lambda w: merge_long(w, pieces, *both)) if pieces.kind == "bpe" else (
            lambda w: path_long(w, pieces, both[0]))
        return pd.Series([None if w is None else one(w) for w in words], dtype=object)

    return found


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """word, splits, found (ids) for distinct words (word, splits)."""
    lattice = _edges(words, pieces)
    folded = _merged(lattice, pieces) if pieces.kind == "bpe" else _best_path(lattice, pieces)
    long = F.when(F.length("word") > LONGEST_WORD, F.col("word"))
    return folded.select("word", "splits", F.coalesce("found", _long_words(pieces)(long)).alias("found"))


class _LookUp:
    """Ids of each text, from the table of its split in the shared folder, which stays in Arrow's compact form."""

    def __init__(self, folder: str, pattern: re.Pattern) -> None:
        self.folder, self.pattern = folder, pattern

    def _table(self, split: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Words, and where the ids of each begin and end among all ids."""
        files, root = pyarrow.fs.FileSystem.from_uri(self.folder) if ":" in self.folder else (
            pyarrow.fs.LocalFileSystem(), self.folder)
        read = []
        for item in files.get_file_info(pyarrow.fs.FileSelector(f"{root}/split={split}")):
            if item.path.endswith(".parquet"):
                with files.open_input_file(item.path) as file:
                    read.append(pq.ParquetFile(file).read(["word", "found"]))
        whole = pa.concat_tables(read).combine_chunks()
        words, ids = whole["word"].chunk(0), whole["found"].chunk(0)
        return words, ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype(np.int32)

    def _ids(self, texts: list[str | None], table: tuple[pa.Array, np.ndarray, np.ndarray]) -> list[np.ndarray]:
        words, offset, ids = table
        split = [split_text(t, self.pattern) for t in texts]
        place = pc.index_in(pa.array(chain.from_iterable(split), words.type), words)
        if place.null_count:
            raise KeyError("a word of a text is missing in the table of its split")
        place = place.to_numpy()
        size = offset[place + 1] - offset[place]
        end = np.cumsum(size)
        found = ids[np.arange(end[-1]) + np.repeat(offset[place] - end + size, size)]
        last = np.r_[0, end][np.cumsum([len(w) for w in split])]
        return np.split(found, last[:-1])

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, table = None, None
        for batch in batches:
            for part, rows in _portions(batch):
                if part != split:
                    split, table = part, None
                texts = rows["text"].tolist()
                if any(texts):
                    table = table or self._table(split)
                    ids = self._ids(texts, table)
                else:
                    ids = [np.zeros(0, np.int32)] * len(texts)
                yield pd.DataFrame({"doc_id": rows["doc_id"], "text": rows["text"], "ids": ids})


def encode(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """doc_id, text, ids (array of int) per row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    first = docs.select(F.input_file_name().alias("f")).first()
    if first is None or not first.f:  # not a plain scan of files: write it once, so that its splits have names
        docs = stage(docs, "texts")
    pattern = pieces.pattern()
    by_split = docs.withColumn("split", F.xxhash64(F.input_file_name(), F.input_file_block_start()))
    words = by_split.select("split", "text").mapInPandas(_SplitWords(pattern), "word string, split bigint").groupBy(
        "word").agg(F.collect_set("split").alias("splits"))
    coded = encode_words(words, pieces)
    folder = staging_path(spark, "lookup")
    coded.select("word", "found", F.explode("splits").alias("split")).repartition("split").write.partitionBy(
        "split").option("compression", "zstd").parquet(folder)
    return by_split.mapInPandas(_LookUp(folder, pattern), "doc_id bigint, text string, ids array<int>")


class _Join:
    def __init__(self, pieces: Pieces) -> None:
        table = []
        for i, p in enumerate(pieces.text):
            if pieces.byte0 is not None and pieces.byte0 <= i < pieces.byte0 + 256:
                table.append(bytes([i - pieces.byte0]))
            else:
                table.append(p.encode() if i not in pieces.control else b"")
        self.table = table

    def __call__(self, ids: pd.Series) -> pd.Series:
        get = self.table.__getitem__
        mark = SPACE.encode()
        out = []
        for row in ids:
            text = b"".join(map(get, row.tolist())) if row is not None else b""
            text = text.replace(mark, b" ").decode("utf-8", "replace")
            out.append(text[1:] if text.startswith(" ") else text)
        return pd.Series(out, dtype=object)


def decode(ids: Column, pieces: Pieces) -> Column:
    """The text of an array of ids: pieces joined, bytes put together, space marks turned back."""
    join = _Join(pieces)

    @F.pandas_udf("string")
    def decoded(ids: pd.Series) -> pd.Series:
        return join(ids)

    return decoded(ids)
