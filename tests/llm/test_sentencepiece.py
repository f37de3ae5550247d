import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from docsieve.llm import sentencepiece_lattice as lattice
from tests.llm.conftest import SF

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def pieces():
    return lattice.load_pieces(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


ODD = ["a  b", " a", "a\nb", "a\tb ", "", "  ", "x▁y", "日本 語😀", "a\r\nb", None, "x" * 3000, "ab" * 40 + " ende",
       "\u0000 null", "the theory of the </s> <s> <0x41>", "zażółć gęślą jaźń", "a" * 49, "ﬁ ﬀ   nbsp"]


def test_against_the_library(spark, pieces, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "a\tb ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lattice.encode(docs, pieces).withColumn("back", lattice.decode(F.col("ids"), pieces)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert list(r.ids) == library.encode(r.text or "", num_threads=1), r.text
        assert r.back == (r.text or "").replace("▁", " ")
    assert lattice.encode(docs.where("false"), pieces).count() == 0


def test_whole_table(spark, pieces, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lattice.encode(docs, pieces).collect()
    assert len(rows) == docs.count()
    assert all(list(r.ids) == library.encode(r.text or "", num_threads=1) for r in rows)


def plain_path(word, pieces):
    ids = pieces.ids()
    low = min(pieces.score[i] for i in ids.values()) - 10
    best = {0: (0.0, [])}
    for end in range(1, len(word) + 1):
        ways = [(best[s][0] + (pieces.score[ids[word[s:end]]] if word[s:end] in ids else low), best[s][1] + [word[s:end]])
                for s in range(end) if word[s:end] in ids or end - s == 1]
        best[end] = max(ways, key=lambda w: w[0])
    return best[len(word)][0]


def test_unigram_path(spark):
    rng = random.Random(4)
    text = ["<unk>"] + sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(30)} - {"b"})
    pieces = lattice.Pieces("unigram", tuple(text), tuple(-rng.random() * 9 for _ in text), None, 0, frozenset())
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 14))) for _ in range(60)] + ["abcab" * 12]
    df = spark.createDataFrame([(w, [1]) for w in set(words)], "word string, splits array<bigint>")
    low = min(pieces.score[i] for i in pieces.ids().values()) - 10
    for r in lattice.encode_words(df, pieces).collect():
        total = sum(pieces.score[i] if i else low for i in r.found)
        assert total == pytest.approx(plain_path(r.word, pieces)), r.word


def test_pieces_that_span_words_are_refused():
    with pytest.raises(ValueError):
        lattice.Pieces("bpe", ("<unk>", f"a{lattice.SPACE}b"), (0.0, -1.0), None, 0, frozenset())
