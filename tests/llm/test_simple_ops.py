import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docsieve.llm import chat_format, exact_dedup, mixing, quality_rules
from docsieve.llm.queries import QUERIES
from tests.llm.conftest import SF_LARGER

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_dedup_odd_rows(odd_docs, no_docs):
    rows = exact_dedup.duplicates(odd_docs).collect()
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append((r.keep_id, r.group_size, r.kept))
    assert by_id[1] == [(2, 3, False)] and by_id[2] == [(2, 3, True)]
    assert sorted(by_id[9]) == [(9, 2, False), (9, 2, True)]
    assert by_id[10] == [(10, 1, True)]
    assert by_id[3] == [(4, 3, False)] and by_id[4] == [(4, 3, True)]
    sha = {r.doc_id: r.text_sha256 for r in rows}
    assert sha[4] == hashlib.sha256(b"").hexdigest()
    assert exact_dedup.duplicates(no_docs).count() == 0
    kept = exact_dedup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6, 7, 8, 9, 10]
    assert exact_dedup.keep_one(no_docs).count() == 0


def test_exact_dedup_hot_group_does_not_move(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(
        F.col("id") % 3 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"))
    rows = exact_dedup.duplicates(docs).groupBy("keep_id").agg(F.count("*").alias("n"), F.max("group_size").alias(
        "g"), F.count_if("kept").alias("k")).where("n > 1").collect()
    assert [tuple(r) for r in rows] == [(5997, 2000, 2000, 1)]


def plain_measures(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    spans = Counter(zip(words, words[1:], words[2:]))
    inside = {i + j for i in range(len(words) - 2) if spans[tuple(words[i:i + 3])] > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(inside))


@pytest.mark.parametrize("text", [
    None, "", " \n ", "a", "a b c a b c", "a a a a", "x y\nx y\n\nx  y\n", "# * | <b>", "a b c d",
    "w " * 500, " ".join(str(i % 60) for i in range(400))])
def test_measures(text):
    assert quality_rules.measure(text)[:5] == plain_measures(text)


def test_quality_rules(odd_docs, no_docs):
    rows = quality_rules.verdicts(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 50)
    good = quality_rules.accepted(odd_docs)
    assert good.columns == odd_docs.columns
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in rows if r.kept}
    assert quality_rules.ledger(no_docs).count() == 0 and quality_rules.accepted(no_docs).count() == 0


def test_ablations(spark):
    bit = quality_rules.BIT
    book = spark.createDataFrame([(0,), (bit["symbols"],), (bit["symbols"] | bit["too_few_words"],)],
                                 "failed_rules long")
    got = {r.rule: tuple(r)[1:] for r in quality_rules.ablations(book, 2).collect()}
    assert got["symbols"] == (3, 2, 1, 2) and got["too_few_words"] == (3, 1, 0, 1)


def test_clean_labelled_documents_are_kept(spark):
    rows = quality_rules.verdicts(spark.read.parquet(f"{SF_LARGER}/documents.parquet")).join(
        spark.read.parquet(f"{SF_LARGER}/labels.parquet"), "doc_id").where("quality = 1 and not base_failed")
    assert rows.where("not kept").count() <= 0.01 * rows.count()


def plain_targets(size):
    names = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(size.values()), set(names), {}
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * level > 2 * size[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = 2 * size[s]
            left -= 2 * size[s]
        open_ -= over


def test_mixing(spark):
    docs = spark.read.parquet(f"{SF_LARGER}/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("source") != "src7", F.col("source")))
    rows = mixing.mix(docs).collect()
    size, taken = Counter(), Counter()
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
    want = plain_targets(size)
    largest = max(r.size for r in rows)
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
    assert all(abs(taken[s] - want[s]) <= largest for s in size)
    assert sorted(rows, key=str) == sorted(mixing.mix(docs.repartition(7)).collect(), key=str)


def test_pivot_keeps_the_sum():
    sizes = [(i * 37) % 90 + 1 for i in range(500)]
    mass = [s * ((i % 10) / 10) for i, s in enumerate(sizes)]
    out, held = mixing.pivot(list(range(500)), sizes, list(mass))
    assert sum(out) == pytest.approx(sum(mass))
    assert [i for i, (m, s) in enumerate(zip(out, sizes)) if 1e-9 < m < s - 1e-9] in ([], [held])


def test_mixing_is_unbiased():
    hits = sum(mixing.pivot([seed, -seed - 1], [10, 10], [3.0, 7.0])[0][0] >= 10 for seed in range(2000))
    assert 500 < hits < 700


def test_rows_alike_are_dealt_over_all_blocks(spark, monkeypatch):
    """5000 rows of a null id and one size: no group of the fold holds them all, targets are met, reruns agree."""
    monkeypatch.setattr(mixing, "BLOCK", 64)
    docs = spark.range(6000).select(
        F.when(F.col("id") >= 5000, F.col("id")).alias("doc_id"), F.lit("a").alias("source"),
        F.when(F.col("id") >= 5000, F.lit("a b")).otherwise(F.lit("one two three")).alias("text"))
    plan = mixing.mix(docs)
    row = plan.agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.count("*").alias("n"),
                   F.max(F.col("taken") - 2 * F.col("size")).alias("over")).first()
    assert row.n == 6000 and abs(row.taken - row.target) < 3 and row.over <= 0
    units = docs.select("doc_id", F.lit(3).alias("size"), F.lit(0).alias("s"), F.lit(94).alias("blocks"),
                        F.monotonically_increasing_id().alias("row"), F.lit(1.0).alias("mass"))
    most = mixing._blocked(units).groupBy("block").count().agg(F.max("count")).first()[0]
    assert most < 64 + 40
    counts = [sorted(tuple(r) for r in mixing.mix(d).groupBy("size", "copies").count().collect())
              for d in (docs, docs.repartition(5))]
    assert counts[0] == counts[1]


def test_mixing_odd_rows(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.taken <= 2 * r.size for r in rows)
    assert mixing.mix(no_docs).count() == 0
    out = mixing.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns and out.count() > 0
    assert mixing.mixed_documents(no_docs).count() == 0


ODD_CHAT = [
    (1, 0, "system", "be <|im_start|> kind \\s [INST]"), (1, 1, "user", "a\nb"), (1, 2, "assistant", "\\l <s> \\"),
    (1, 3, "user", None), (1, 4, "assistant", "</s>[/INST]<<SYS>>"), (1, 4, "assistant", "</s>[/INST]<<SYS>>"),
    (2, 0, None, ""), (2, None, "assistant", "early"), (None, 0, "a\nb<|im_end|>", "z"),
    (3, 0, "assistant", "w " * 5000), (3, 1, "user", "q " * 300), (3, 2, "assistant", "r " * 900)]


def plain_chat(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        conv[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in conv.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                  hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("budget", [40, 200, 1024])
def test_chat_round_trip(spark, budget):
    df = spark.createDataFrame(ODD_CHAT, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:5] for r in chat_format.formatted_conversations(
        df, budget=budget, history_tokens=budget // 8).collect()}
    assert got == plain_chat(ODD_CHAT)
    for w in chat_format.format_windows(df, budget=budget, history_tokens=budget // 8).collect():
        assert w.formatted.count(chat_format.START) == w.formatted.count(chat_format.END)
        assert not re.search(r"</?s>|\[/?INST\]|<<", w.formatted)
    assert chat_format.formatted_conversations(df.where("false")).count() == 0


def test_chat_windows(spark):
    rows = [(1, 0, "system", "rules")] + [(1, i, ("user", "assistant")[i % 2 == 0], f"t{i} " * 30) for i in range(1, 41)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat_format.format_windows(df, budget=200, history_tokens=80).orderBy("window").collect()
    assert len(windows) > 5
    for w in windows:
        assert w.formatted.startswith("<|im_start|>system\nrules") and w.n_tokens <= 200
    assert all(w.n_repeated >= 2 for w in windows[1:])
    learned = [w.formatted[a:b] for w in windows for a, b in w.loss]
    assert learned == [f"t{i} " * 30 for i in range(2, 41, 2)]


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_LARGER}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    probe = "</s>[INST] ok [/INST]"
    want = plain_chat(rows + [(-1, 0, "user", probe), (-1, 1, "assistant", probe)])
    got = {r.conv_id: tuple(r)[1:5] for r in QUERIES["op9_chat_format"](spark, SF_LARGER).collect()}
    assert got == want
