"""Spelling variants of the corpus' words, over an index of variable-length grams.

The grams of a word run over the word between two end marks. At each place the gram grows from ``SHORTEST`` while it
is in the gram dictionary, which holds the frequent grams only: rare grams stay short, frequent ones are told apart
by more letters. A gram depends on nothing but its own letters, so one edit changes only the grams that cover the
edited letter. The largest number of grams over one letter is therefore a word's bound on affected grams; it is at
most ``LONGEST``, and a word of five letters has six grams or more.

Two words at one edit share all their unaffected grams, moved by one place at most. So of each word's grams, rarest
first, the bound and one more go into the index, and near words share one of them: the lists, by gram, place and
length, are merged by an equality join that verifies every candidate in place.

Defined cases: a null text has no words; a null doc_id counts as an empty one; repeated rows count each; ties for
the form go to the smallest word in code-point order; no words give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.session import stage

#: Letters of a gram. SHORTEST grams need no dictionary; with a LONGEST of 5 every word of five letters keeps at
#: least one gram that an edit leaves alone.
SHORTEST, LONGEST = 2, 5
#: A gram is frequent if it covers more than one in SHARE of all places, so a dictionary has less than
#: SHARE * (LONGEST - SHORTEST + 1) grams, however large the vocabulary.
SHARE = 20_000
#: Distinct words or grams that a task counts before it hands the counts on.
HELD = 400_000
_RUN = re.compile("[a-zÀ-ÿ]+")
#: n is a whole number below 2**63 and at least doubles from a word to its form.
_DOUBLINGS = 6


class _Words:
    """Counts per word of at least ``length`` letters, combined within a task."""

    def __init__(self, length: int, damage: int | None) -> None:
        self.length, self.damage = length, damage

    def _of(self, doc_id: str, text: str) -> Iterator[tuple[str, int]]:
        seed = zlib.crc32(f"{doc_id}:".encode())
        for run, n in Counter(_RUN.findall(text.encode("utf-8", "replace").lower().decode())).items():
            if self.damage:
                h = zlib.crc32(run.encode(), seed)
                if h % self.damage == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1:]
            if len(run) >= self.length:
                yield run, n

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                for word, n in self._of(doc_id, text):
                    held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held = {}
        yield pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": pd.Series(list(held.values()), dtype="int64")})


def word_counts(docs: DataFrame, length: int = 5, least: int = 3, damage: int | None = None) -> DataFrame:
    """word, n of the runs of letters, A-Z folded, with at least ``length`` letters and ``least`` occurrences.

    With ``damage``, one run in that many, chosen by the crc32 of doc_id and run, loses a letter first.
    """
    rows = docs.where("text <> ''").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return rows.mapInPandas(_Words(length, damage), "word string, n bigint").groupBy("word").agg(
        F.sum("n").alias("n")).where(F.col("n") >= least)


def _gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: Counter = Counter()

    def given() -> pd.DataFrame:
        return pd.DataFrame({"gram": pd.Series(list(held), dtype=object),
                             "n": pd.Series(list(held.values()), dtype="int64")})

    for batch in batches:
        for word in batch["word"]:
            marked = f"^{word}$"
            for size in range(SHORTEST, LONGEST + 1):
                held.update(marked[at:at + size] for at in range(len(marked) - size + 1))
            if len(held) > HELD:
                yield given()
                held.clear()
    yield given()


def gram_dictionary(words: DataFrame) -> dict[str, int]:
    """The frequent grams of the vocabulary and their counts: a table of bounded size, see SHARE."""
    places = words.agg(F.sum(F.length("word") + 2)).first()[0] or 0
    counts = words.select("word").mapInPandas(_gram_counts, "gram string, n bigint").groupBy("gram").agg(
        F.sum("n").alias("n")).where(F.col("n") * SHARE > places)
    return {row.gram: row.n for row in counts.toLocalIterator()}


def decompose(word: str, frequent: dict[str, int]) -> list[tuple[str, int]]:
    """The variable grams of a word and their places."""
    marked, grams = f"^{word}$", []
    for at in range(len(marked) - SHORTEST + 1):
        size = SHORTEST
        while size < LONGEST and at + size < len(marked) and marked[at:at + size] in frequent:
            size += 1
        grams.append((marked[at:at + size], at))
    return grams


def affected(word: str, grams: list[tuple[str, int]]) -> int:
    """The most grams that one edited letter of the word can change."""
    change = [0] * (len(word) + 3)
    for gram, at in grams:
        change[at] += 1
        change[at + len(gram)] -= 1
    most = now = 0
    for at, c in enumerate(change):
        now += c
        if 1 <= at <= len(word):
            most = max(most, now)
    return most


class _Index:
    """The rarest grams of each word, one more than an edit can change, and a parity bit per letter."""

    def __init__(self, frequent: dict[str, int]) -> None:
        self.frequent = frequent

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for word, n in zip(batch["word"], batch["n"]):
                grams = decompose(word, self.frequent)
                bound = affected(word, grams)
                if len(grams) <= bound:
                    raise ValueError(f"{word!r} is too short for grams of {LONGEST} letters")
                letters = 0
                for c in word:
                    letters ^= 1 << ord(c) % 61
                rarest = sorted(grams, key=lambda g: (self.frequent.get(g[0], 0), g))
                rows.extend((word, n, letters, gram, at) for gram, at in rarest[:bound + 1])
            yield pd.DataFrame(rows, columns=["word", "n", "letters", "gram", "place"])


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, n_a, n_b: all pairs of words (word, n; five letters or more) at exactly one edit, each once."""
    index = _Index(gram_dictionary(words))
    entries = stage(words.mapInPandas(index, "word string, n bigint, letters bigint, gram string, place int"), "grams")
    size = F.length("word")

    def entry(moved: int, longer: int):
        return F.xxhash64("gram", F.col("place") + moved, size + longer)

    # A replaced letter moves no gram; one more letter moves the grams after it.
    left = entries.select(
        F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("letters").alias("letters_a"),
        F.explode(F.array(entry(0, 0), entry(0, 1), entry(1, 1))).alias("entry"))
    right = entries.select(
        F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("letters").alias("letters_b"), entry(0, 0).alias(
            "entry"))
    ordered = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    close = F.bit_count(F.col("letters_a").bitwiseXOR(F.col("letters_b"))) <= 2
    found = left.join(right, (left["entry"] == right["entry"]) & close & ordered & (F.levenshtein("a", "b", 1) == 1))
    return found.select("a", "b", "n_a", "n_b").distinct()


def forms(words: DataFrame) -> DataFrame:
    """word, n, n_near, form and form_n of words (word, n).

    The form is the near word of largest n, if that is at least twice the word's.
    """
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    known = words.select("word", "n").join(best, "word", "left")
    fits = -F.col("best.less") >= 2 * F.col("n")
    return known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.other")).alias("form"),
        F.when(fits, -F.col("best.less")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """word, root for words with a form: the last form, by doubling the way gone in each round."""
    way = stage(found.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    for _ in range(_DOUBLINGS):
        ahead = way.select(F.col("word").alias("root"), F.col("root").alias("further"))
        way = stage(way.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("went")), "roots")
        if way.where("went").isEmpty():
            break
        way = way.select("word", "root")
    return way.select("word", "root")


def spelling_variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for words (word, n)."""
    found = stage(forms(stage(words, "words")), "forms")
    return found.join(roots(found), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
