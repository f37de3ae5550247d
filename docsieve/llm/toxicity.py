"""Toxicity by subword bags: character n-gram embeddings averaged into a linear softmax, trained in numpy.

A word is the mean of the embeddings of its character n-grams, hashed into buckets; a passage of WINDOW words is the mean
of its words; a two-class softmax reads it. Embeddings and softmax are trained together on a bounded sample of
labelled rows, first on all passages under their document's label, then on the passage that speaks most for
toxicity in each document, toxic or not. A document's score is that of its highest passage anywhere in the whole text,
so length does not dilute it. An unseen spelling shares n-grams with the seen ones.

Scoring needs one number per bucket (the embedding times the softmax), 512 KB in each task.

Defined cases: a run of more than PIECE word characters counts as words of PIECE characters each, whose edges overlap so
that no n-gram is lost; a null or wordless text scores 0; rows of a null doc_id are never held out and never learned from;
without labels of both classes every score is 0; repeated rows score alike.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 17
DIM = 8
WINDOW = 5
#: At most so many labelled rows of each class are learned from, chosen by a hash of the id.
SAMPLE = 1500
#: Least number of steps of each phase, so that a small sample is gone over more often.
STEPS = 240
FOLD = 3
HELD_OUT = 1
CUT = 0.7
PIECE = 64
_OVERLAP = 4
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    """Lower-cased words, long runs in pieces."""
    found = _WORD.findall(text.lower()) if text else []
    if all(len(w) <= PIECE for w in found):
        return found
    return [w[i:i + PIECE] for w in found for i in range(0, max(len(w) - _OVERLAP, 1), PIECE - _OVERLAP)]


def ngrams(word: str) -> list[int]:
    """Buckets of the word and of its 3- to 5-grams, the ends marked."""
    full = f"<{word}>"
    n = len(full)
    grams = {full[i:i + k] for k in (3, 4, 5) for i in range(n - k + 1)} | {full}
    return [zlib.crc32(g.encode("utf-8", "replace")) & (BUCKETS - 1) for g in grams]


@dataclass
class Model:
    weights: np.ndarray  # one number per bucket
    bias: float

    def __post_init__(self) -> None:
        self.seen: dict[str, float] = {}

    def word(self, word: str) -> float:
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) > 300_000:
                self.seen.clear()
            at = ngrams(word)
            found = self.seen[word] = float(self.weights[at].sum()) / len(at)
        return found

    def score(self, text: str | None) -> float:
        found = words(text)
        if not found:
            return 0.0
        z = np.cumsum(np.fromiter(map(self.word, found), np.float64, len(found)))
        best = z[-1] / len(found) if len(found) <= WINDOW else max(
            z[WINDOW - 1], (z[WINDOW:] - z[:-WINDOW]).max()) / WINDOW
        return 1.0 / (1.0 + math.exp(-min(max(best + self.bias, -500.0), 500.0)))


class _Trainer:
    """Embeddings, softmax and their AdaGrad state; gradients of both flow in every step."""

    def __init__(self, word_grams: list[list[int]], seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.e = rng.uniform(-0.1, 0.1, (BUCKETS, DIM))
        self.w = rng.uniform(-0.5, 0.5, (DIM, 2))
        self.b = np.zeros(2)
        self.state = [np.full_like(x, 1e-3) for x in (self.e, self.w, self.b)]
        self.flat = np.concatenate([np.array(g) for g in word_grams])
        self.size = np.array([len(g) for g in word_grams])
        self.at = np.concatenate([[0], np.cumsum(self.size)[:-1]])

    def _grams(self, words: np.ndarray) -> np.ndarray:
        size = self.size[words]
        return self.flat[np.repeat(self.at[words] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
                         + np.arange(size.sum())]

    def step(self, windows: np.ndarray, labels: np.ndarray, rate: float, weight: np.ndarray) -> None:
        words, place = np.unique(windows, return_inverse=True)
        place = place.reshape(windows.shape)
        grams, size = self._grams(words), self.size[words]
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        vectors = np.add.reduceat(self.e[grams], starts, axis=0) / size[:, None]
        hidden = vectors[place].mean(axis=1)
        logits = hidden @ self.w + self.b
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(labels)), labels] -= 1.0
        p *= (weight / weight.sum())[:, None]
        back = p @ self.w.T / windows.shape[1]
        per_word = np.zeros((len(words), DIM))
        for j in range(windows.shape[1]):
            for d in range(DIM):
                per_word[:, d] += np.bincount(place[:, j], back[:, d], len(words))
        per_gram = np.repeat(per_word / size[:, None], size, axis=0)
        used, where = np.unique(grams, return_inverse=True)
        change = np.column_stack([np.bincount(where, per_gram[:, d], len(used)) for d in range(DIM)])
        for x, state, grad, rows in ((self.w, self.state[1], hidden.T @ p, slice(None)),
                                     (self.b, self.state[2], p.sum(axis=0), slice(None)),
                                     (self.e, self.state[0], change, used)):
            state[rows] += grad * grad
            x[rows] -= rate * grad / np.sqrt(state[rows])

    def margins(self) -> np.ndarray:
        """The logit difference that each known word brings."""
        s = self.e @ (self.w[:, 1] - self.w[:, 0])
        return np.add.reduceat(s[self.flat], self.at) / self.size

    def model(self) -> Model:
        return Model((self.e @ (self.w[:, 1] - self.w[:, 0])).astype(np.float32), float(self.b[1] - self.b[0]))


def fit(texts: list[str], labels: list[int], seed: int = 11, rounds: int = 12) -> Model:
    """Train on whole texts; labels 0 or 1."""
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), -50.0)
    ids: dict[str, int] = {}
    docs = [np.array([ids.setdefault(w, len(ids)) for w in words(t)], np.int64)
            for t in texts]
    kept = [i for i, d in enumerate(docs) if len(d)]
    docs, y = [docs[i] for i in kept], np.array([labels[i] for i in kept])
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), -50.0)
    docs = [np.resize(d, WINDOW) if len(d) < WINDOW else d for d in docs]
    trainer, rng = _Trainer([ngrams(w) for w in ids], seed), np.random.default_rng(seed)
    windows = np.concatenate([d[:len(d) // WINDOW * WINDOW].reshape(-1, WINDOW) for d in docs])
    owner = np.repeat(np.arange(len(docs)), [len(d) // WINDOW for d in docs])
    # Both classes weigh alike whatever their lengths, and no document more than 64 passages of a round.
    pick = np.concatenate([rng.choice(w, min(len(w), 64), replace=False)
                           for w in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner)) + 1)])
    weight = np.where(np.arange(2) == 1, (y == 0).mean(), (y == 1).mean())[y]
    for _ in range(max(1, -(-STEPS * 1024 // len(pick)))):
        order = rng.permutation(pick)
        for part in np.array_split(order, max(1, len(order) // 1024)):
            trainer.step(windows[part], y[owner[part]], 0.3, weight[owner[part]])
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    flat = np.concatenate(docs)
    for _ in range(max(rounds, -(-STEPS * 128 // len(docs)))):
        total = np.concatenate([[0.0], np.cumsum(trainer.margins()[flat])])
        top = []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            lead = total[lo + WINDOW:hi + 1] - total[lo:hi + 1 - WINDOW]
            at = lo + int(np.argmax(lead))
            top.append(flat[at:at + WINDOW])
        best = np.array(top)
        order = rng.permutation(len(best))
        for part in np.array_split(order, max(1, len(order) // 128)):
            trainer.step(best[part], y[part], 0.3, weight[part])
    return trainer.model()


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLD))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[int]]:
    """A bounded sample of labelled rows outside the held-out fold, by a hash of the id: the same in any run.

    An id gives one of its texts, however many rows share it, so at most 2 * ``sample`` texts reach the driver.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id")) != HELD_OUT)).groupBy(
        "doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(*order).limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    # At most 2 * SAMPLE ids of 12 bytes.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy(
        "doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("toxic").alias(
            "toxic")).toPandas()
    rows = rows.sort_values(["doc_id", "text"]).reset_index(drop=True)
    return rows["text"].fillna("").tolist(), rows["toxic"].astype(int).tolist()


class _Score:
    def __init__(self, model: Model) -> None:
        self.weights, self.bias = model.weights, model.bias

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(self.weights, self.bias)
        for batch in batches:
            yield batch[["doc_id", "held_out"]].assign(score=[model.score(t) for t in batch["text"]])


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs``."""
    held_out = F.coalesce(remainder(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInPandas(
        _Score(model), "doc_id bigint, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= CUT).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return scores(docs, fit(*training_rows(docs, labels, sample)))
