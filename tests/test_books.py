"""The reply-independent books of a deployment: integrity over runs, stage metrics, mined keywords."""

import pytest
from pyspark.sql import functions as F

from docsieve.plans import mining
from docsieve.plans.batch import read_stage_metrics, run_batch, stage_means
from docsieve.plans.integrity import IntegrityBook
from docsieve.plans.mining import mined_keywords, ngrams
from docsieve.plans.quality import integrity_breaches
from docsieve.rules import Category, RuleSet
from docsieve.sources.documents import from_text


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "document_id string")


RUNS = [(["a", "b", "c"], ["a", "b"]), (["d", "a"], ["c", "d", "x"]), (["e", "f"], ["e", "f", "f"])]


def rows(df):
    return sorted((tuple(r) for r in df.select("document_id", "documents", "audit_entries").collect()), key=repr)


def test_three_runs_equal_the_full_check(spark, tmp_path):
    book = IntegrityBook(spark, str(tmp_path / "book"), buckets=4)
    assert rows(book.breaches()) == []
    for i, (documents, audit) in enumerate(RUNS):
        book.add_run(f"r{i}", ids(spark, documents), ids(spark, audit))
    every = integrity_breaches(ids(spark, sum((d for d, _ in RUNS), [])), ids(spark, sum((a for _, a in RUNS), [])))
    assert rows(book.breaches()) == rows(every) == [("a", 2, 1), ("f", 1, 2), ("x", 0, 1)]
    # A run that is added again is known and counts once.
    again = book.add_run("r2", ids(spark, RUNS[2][0]), ids(spark, RUNS[2][1]))
    assert ("f", 1, 2) in rows(again) and rows(book.breaches()) == rows(every)


def test_a_run_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    book = IntegrityBook(spark, str(tmp_path / "book"), buckets=4)
    book.add_run("r0", ids(spark, ["a", None]), ids(spark, ["a"]))
    before = rows(book.state())

    def broken(*args):
        raise OSError("lost before the commit")

    with monkeypatch.context() as patch, pytest.raises(OSError):
        patch.setattr(book, "_commit", broken)
        book.add_run("r1", ids(spark, ["b"]), ids(spark, []))
    assert rows(book.state()) == before
    assert ("b", 1, 0) in rows(book.add_run("r1", ids(spark, ["b"]), ids(spark, [])))
    assert book.add_run("empty", ids(spark, []), ids(spark, [])).count() == 0


def test_a_run_reads_only_the_buckets_it_touches(spark, tmp_path):
    book = IntegrityBook(spark, str(tmp_path / "book"), buckets=64)
    book.add_run("r0", ids(spark, [f"d{i}" for i in range(200)]), ids(spark, [f"d{i}" for i in range(200)]))
    book.add_run("r1", ids(spark, ["d7"]), ids(spark, []))
    assert book.commits().where("run_id = 'r1'").count() == 1
    assert rows(book.breaches()) == [("d7", 2, 1)] and book.state().count() == 200


def test_stage_metrics_are_rows(spark, rules, tmp_path):
    docs = from_text(spark.createDataFrame([("1", "invoice"), ("2", ""), ("3", "a report")], "id string, text string"),
                     "text", "id", "id")
    paths = {f"{n}_path": str(tmp_path / n) for n in ("results", "audit", "metrics")}
    run_batch(docs, rules, run_id="r0", **paths)
    run = run_batch(docs, rules, run_id="r1", infer=lambda ps: ["?"] * len(ps),
                    fallback={"delay": 0, "max_retries": 0}, **paths)
    table = read_stage_metrics(spark, paths["metrics_path"])
    got = {(r.run_id, r.stage): (r.rows, r.failures) for r in table.collect()}
    assert got == {("r0", "process"): (3, 3), ("r0", "audit"): (3, 1), ("r0", "results"): (2, 0),
                   ("r1", "process"): (3, 1), ("r1", "fallback"): (3, 3), ("r1", "audit"): (3, 1), ("r1", "results"): (2, 0)}
    assert list(run.observed) == ["process", "fallback", "audit", "results"]
    means = {r.stage: r for r in stage_means(table).collect()}
    assert means["process"].runs == 2 and means["process"].rows == 6 and means["fallback"].mean_seconds > 0
    assert all(r.seconds_per_1000 > 0 for r in means.values())


def judged(spark):
    """Ten lost invoices speak of a remittance slip, one of them twice; twenty right reports do not."""
    lost = [(f"w{i}", f"the remittance slip {i} is here" + " remittance slip" * (i == 3), "report", "invoice") for i in range(10)]
    fine = [(f"r{i}", f"the summary {i} is here", "report", "report") for i in range(20)]
    other = [("o1", None, "report", "invoice"), ("o2", "remittance slip", "report", "unknown"), ("o3", "", "invoice", "invoice")]
    return spark.createDataFrame(lost + fine + other, "id string, text string, predicted_category string, "
                                                      "reviewer_correct_category string")


SMALL = RuleSet((Category(slug="invoice", display_name="I", threshold=0.5, primary=("slip",)),
                 Category(slug="report", display_name="R", threshold=0.5, primary=("summary",))))


@pytest.mark.parametrize("tracked", [mining.MOST_TRACKED, 1])
def test_mined_keywords_by_sketch_and_by_exact_count(spark, monkeypatch, tracked):
    monkeypatch.setattr(mining, "MOST_TRACKED", tracked)
    found = mined_keywords(judged(spark), SMALL, share=0.5)
    got = {(r.category, r.ngram): (r.wrong_with, r.wrong_texts, r.right_with, r.right_texts) for r in found.collect()}
    # "slip" is in the dictionary; "the", "is" and "here" are in all; the text without words counts among the wrong ones.
    assert got == {("invoice", g): (10, 11, 0, 20) for g in (
        "remittance", "remittance slip", "the remittance", "the remittance slip")}
    ratio = found.where("ngram = 'remittance'").first().ratio
    # 2 (10 ln(310 / 110) + ln(31 / 231) + 20 ln(620 / 420)) = 2 (10.361 - 2.008 + 7.789)
    assert abs(ratio - 32.284) < 0.001


def test_mining_without_wrong_texts(spark):
    right = judged(spark).where("predicted_category = reviewer_correct_category")
    assert mined_keywords(right, SMALL).count() == 0 and mined_keywords(right.where("false"), SMALL).count() == 0


def test_ngrams_are_distinct_runs(spark):
    df = spark.createDataFrame([("A b, a-b",), ("",), (None,), ("x",)], "t string")
    assert [sorted(r.g) for r in df.select(ngrams(F.col("t"), 2).alias("g")).collect()] == [
        ["a", "a b", "b", "b a"], [], [], ["x"]]


def test_ngrams_are_built_from_words_and_not_from_slices(spark):
    """A slice and a join per n-gram made this step dearer than the scoring; texts shorter than a run have none of it."""
    df = spark.createDataFrame([("",), (None,), ("One",), ("a b",), ("a b, a b a",), ("😀 é x-y",)], "t string")
    grams = df.select("t", ngrams(F.col("t"), 3).alias("g"))
    assert "array_join" not in grams._jdf.queryExecution().optimizedPlan().toString()
    assert {r.t: sorted(r.g) for r in grams.collect()} == {
        "": [], None: [], "One": ["one"], "a b": ["a", "a b", "b"],
        "a b, a b a": ["a", "a b", "a b a", "b", "b a", "b a b"],
        "😀 é x-y": ["x", "x y", "y", "é", "é x", "é x y"]}
