"""Licence scan over a positional index of rare words, in DataFrame operations only.

Each template of a licence is indexed by its ``ANCHORS`` words of highest inverse document frequency, with all their
places in it; the frequencies are counted over all documents. In each file those words are looked up. A word of the
file and its place in a template give a shift, and what belongs to one copy of the template has nearly one shift:
the shares of the index found per band of shifts are added up, each place of the template once. A template is found
where its share reaches ``LEAST`` and its mandatory phrases stand in the same band, word for word.

The text is read twice: for the frequencies, of which one row per word of the templates remains, and for the places
of the words looked up, which are written with a row number. Only these narrow rows are shuffled after that.

Defined cases: a null or wordless text has no words, no labels and the score 0; rows are scanned each, whatever their
doc_id; phrases may overlap and every place counts; an empty table gives no rows.
"""

from __future__ import annotations

import re
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions.binding import computed_once, constant
from docsieve.llm.common import ascii_lower
from docsieve.llm.licenses import BASE_PHRASES, NOTICES, Notice
from docsieve.session import stage

ANCHORS = 8
#: The share of a template's index, by weight, that one copy must show: LEAST[0] / LEAST[1].
LEAST = (3, 5)
#: Shifts of one band. Bands overlap by half, so words moved by up to half a band stay together.
BAND = 16
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_words(text: str) -> list[str]:
    low = text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return [w for w in re.split(_GAP, low) if w]


def words(text: Column) -> Column:
    """The words of a text, A-Z folded."""
    return F.array_remove(F.split(ascii_lower(text), _GAP), "")


def weights(docs: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """Per word one more than how often its documents can be doubled within all: a whole logarithm of rarity.

    Whole numbers make sums, shares and their order the same whatever the order of rows.
    """
    known = F.array(*[F.lit(w) for w in vocabulary])
    seen = docs.select(F.explode(F.array_intersect(words(F.col("text")), known)).alias("word")).groupBy("word").agg(
        F.count("*").alias("n"))
    total, count = docs.count(), dict.fromkeys(vocabulary, 0) | {r.word: r.n for r in seen.toLocalIterator()}
    return {w: max(1, (total // max(n, 1)).bit_length()) for w, n in count.items()}


class Index:
    """Lookups (words), postings per lookup (template, place, weight), totals per template and the phrases."""

    def __init__(self, notices: Sequence[Notice], weight: dict[str, int], anchors: int = ANCHORS) -> None:
        rarest = (lambda ws: sorted(set(ws), key=lambda w: (-weight[w], w)))
        self.label = [n.label for n in notices]
        texts = [template_words(n.text) for n in notices]
        #: (words, place of its rarest word, template or None, place in the template, label)
        self.phrases: list[tuple[list[str], int, int | None, int, str]] = []
        for phrase, label in BASE_PHRASES:
            self._phrase(phrase.split(), rarest, None, 0, label)
        for t, (notice, text) in enumerate(zip(notices, texts)):
            for phrase in notice.mandatory:
                parts = phrase.split()
                at = next(i for i in range(len(text)) if text[i:i + len(parts)] == parts)
                self._phrase(parts, rarest, t, at, notice.label)
        kept = [set(rarest(text)[:anchors]) for text in texts]
        self.lookups = sorted(set().union(*kept) | {p[0][p[1]] for p in self.phrases})
        self.postings = [[(t, at, weight[w]) for t, text in enumerate(texts) for at, x in enumerate(text)
                          if x == w and w in kept[t]] for w in self.lookups]
        self.total = [sum(weight[w] for w in text if w in kept[t]) for t, text in enumerate(texts)]
        self.needed = [len(n.mandatory) for n in notices]

    def _phrase(self, parts: list[str], rarest, template: int | None, at: int, label: str) -> None:
        self.phrases.append((parts, parts.index(rarest(parts)[0]), template, at, label))


def vocabulary(notices: Sequence[Notice]) -> list[str]:
    texts = [template_words(n.text) for n in notices] + [p.split() for p, _ in BASE_PHRASES]
    return sorted(set().union(*map(set, texts)))


def located(docs: DataFrame, index: Index) -> DataFrame:
    """row, doc_id, n_words, hits (place, word: number of the lookup) and phrases (phrase, place), written once."""
    lookups = F.array(*[F.lit(w) for w in index.lookups])
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    rows = computed_once(rows, "words", words(F.col("text"))).drop("text")
    every = F.transform("words", lambda w, i: F.struct(i.alias("place"), F.array_position(lookups, w).cast(
        "int").alias("word")))
    hits = F.filter(every, lambda h: h["word"] > 0)
    some = F.arrays_overlap("words", lookups)
    rows = computed_once(rows, "hits", F.when(some, F.transform(hits, lambda h: F.struct(
        h["place"].alias("place"), (h["word"] - 1).alias("word")))))

    def places(number: int) -> Column:
        parts, at, *_ = index.phrases[number]
        key = index.lookups.index(parts[at])
        begin = (lambda h: h["place"] - at)
        here = F.filter("hits", lambda h: (h["word"] == key) & (begin(h) >= 0) & F.when(
            begin(h) >= 0, F.slice("words", begin(h) + 1, F.lit(len(parts))) == F.array(*map(F.lit, parts))))
        return F.transform(here, lambda h: F.struct(F.lit(number).alias("phrase"), begin(h).alias("place")))

    phrases = F.when(F.col("hits").isNotNull(), F.concat(*map(places, range(len(index.phrases)))))
    return stage(rows.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "hits",
                             phrases.alias("phrases")), "located")


def found_templates(rows: DataFrame, index: Index) -> DataFrame:
    """row, label, place (where the copy begins, about) and share (of the index, by weight) of each template found."""
    postings = constant([[{"t": t, "at": at, "weight": w} for t, at, w in some] for some in index.postings],
                        "array<array<struct<t:int,at:int,weight:long>>>")
    parts = constant([None if t is None else {"t": t, "at": at} for _, _, t, at, _ in index.phrases],
                     "array<struct<t:int,at:int>>")
    seen = rows.where("size(hits) > 0").select("row", F.explode("hits").alias("h")).select(
        "row", "h.place", F.inline(F.get(postings, F.col("h.word")))).select(
        "row", "t", "at", (F.col("place") - F.col("at")).alias("shift"), "weight", F.lit(0).alias("phrase"))
    said = rows.where("size(phrases) > 0").select("row", F.explode("phrases").alias("p")).select(
        "row", "p.place", F.get(parts, F.col("p.phrase")).alias("part"), "p.phrase").where("part is not null").select(
        "row", "part.t", "part.at", (F.col("place") - F.col("part.at")).alias("shift"),
        F.lit(0).cast("long").alias("weight"), (F.col("phrase") + 1).alias("phrase"))
    half = BAND // 2
    both = seen.unionByName(said).select(
        "*", F.explode(F.array(F.lit(0), F.lit(1))).alias("grid")).withColumn(
        "band", F.floor((F.col("shift") + F.col("grid") * half) / BAND))
    once = both.groupBy("row", "t", "grid", "band", "at", "phrase").agg(
        F.max("weight").alias("weight"), F.min("shift").alias("shift"))
    whole = once.groupBy("row", "t", "grid", "band").agg(
        F.sum("weight").alias("weight"), F.count_if(F.col("phrase") > 0).alias("said"), F.min("shift").alias("shift"))
    table = constant([{"label": a, "total": b, "needed": c} for a, b, c in zip(index.label, index.total, index.needed)],
                     "array<struct<label:string,total:long,needed:int>>")
    whole = whole.withColumn("template", F.get(table, F.col("t")))
    fits = (F.col("said") == F.col("template.needed")) & (
        LEAST[1] * F.col("weight") >= LEAST[0] * F.col("template.total"))
    return whole.where(fits).select("row", F.col("template.label").alias("label"), F.col("shift").alias("place"),
                                    (F.col("weight") / F.col("template.total")).alias("share"))


def scan(docs: DataFrame, notices: Sequence[Notice] = NOTICES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is the largest share of a template found, 1 for a base phrase, which is found whole or not at all.
    """
    index = Index(notices, weights(docs, vocabulary(notices)))
    rows = located(docs, index)
    labels = found_templates(rows, index).groupBy("row").agg(
        F.collect_set("label").alias("more"), F.max("share").alias("share"))
    base = F.coalesce(F.filter("phrases", lambda p: p["phrase"] < len(BASE_PHRASES)), F.expr(
        "cast(array() as array<struct<phrase:int,place:int>>)"))
    names = F.array(*[F.lit(label) for _, label in BASE_PHRASES])
    own = F.array_sort(F.array_distinct(F.transform("base", lambda p: F.get(names, p["phrase"]))))
    both = F.array_sort(F.array_union(own, F.coalesce("more", F.expr("cast(array() as array<string>)"))))
    place = F.transform("base", lambda p: p["place"].cast("long"))
    return rows.select("row", "doc_id", "n_words", base.alias("base")).join(labels, "row", "left").select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(place).alias("first_word"),
        F.array_max(place).alias("last_word"), F.array_join(own, ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
