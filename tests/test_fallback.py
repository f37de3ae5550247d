import json

import pytest
from pyspark.sql import functions as F

from docsieve.operators.fallback import (
    PROMPT_CHARS, SYSTEM_PROMPT, addressed, apply_fallback, ask_model, infer_batch, parse_reply, prompt)
from docsieve.operators.ledger import read_ledger, resolve_with_ledger
from docsieve.rules import RuleSet
from docsieve.session import stage

SLUGS = frozenset({"receipt", "letter", "invoice"})


def reply(category="receipt", confidence=0.25):
    return json.dumps({"category": category, "confidence": confidence})


@pytest.mark.parametrize("reply,want", [
    # a known slug and a number: clamped to [0, 1], four decimals from the binary value, space around is layout
    (reply(), ("receipt", 0.25)), (" \t" + reply("letter", 0) + "\r\n", ("letter", 0.0)),
    (reply(confidence=3), ("receipt", 1.0)), (reply(confidence=-7e9), ("receipt", 0.0)),
    (reply(confidence=0.00375), ("receipt", 0.0037)), (reply(confidence="6e-1"), ("receipt", 0.6)),
    (reply(confidence=False), ("receipt", 0.0)),
    # anything else is unusable
    (reply(confidence="sure"), None), (reply(confidence=None), None), (reply(confidence=[0.2]), None),
    (reply("memorandum"), None), (reply(None), None), (reply(["receipt"]), None), (reply({"receipt": 1}), None),
    (reply() + reply(), None), (reply()[:-1], None), ("{}", None), ("null", None), ("[]", None), ('"receipt"', None),
    ("0.25", None), ("receipt", None), (" ", None)])
def test_reply_parsing(reply, want):
    assert parse_reply(reply, SLUGS) == want


def good(slug="invoice"):
    return json.dumps({"category": slug, "confidence": 0.9})


def test_retry_asks_again_only_for_open_prompts():
    calls = []

    def infer(prompts):
        calls.append(list(prompts))
        return [good() if p == "a" or len(calls) == 3 else "?" for p in prompts]

    assert [a[:3] for a in infer_batch(["a", "b"], infer, SLUGS, 2, 0)] == [("invoice", 0.9, None)] * 2
    assert calls == [["a", "b"], ["b"], ["b"]]


def test_errors_are_retried_and_then_given_up():
    calls = []

    def infer(prompts):
        calls.append(1)
        raise ConnectionError("refused")

    assert infer_batch(["a"], infer, SLUGS, 1, 0) == [(None, None, "ConnectionError: refused", None)]
    assert len(calls) == 2


def test_backoff_doubles(monkeypatch):
    pauses = []
    monkeypatch.setattr("docsieve.operators.fallback.time.sleep", pauses.append)
    infer_batch(["a"], lambda p: ["?"], SLUGS, 3, 1.5)
    assert pauses == [1.5, 3.0, 6.0]


def test_short_and_odd_replies():
    assert [a[:3] for a in infer_batch(["a", "b"], lambda p: [good()], SLUGS, 0, 0)] == [
        ("invoice", 0.9, None), (None, None, "no reply")]
    assert infer_batch(["a"], lambda p: [None], SLUGS, 0, 0)[0].failure == "no reply"
    assert infer_batch(["a"], lambda p: ["?"], SLUGS, 0, 0)[0][2:] == ("unusable reply", "?")


def test_a_model_that_takes_it_gets_the_system_prompt():
    def infer(prompts, system):
        return [system + p for p in prompts]

    assert addressed(infer)(["x"]) == [SYSTEM_PROMPT + "x"]
    assert addressed(len) is len


def test_prompt_text(spark, rules):
    df = spark.createDataFrame([("é" * 5000, "why", "0.4500"), (None, None, None)], "t string, r string, c string")
    rows = df.select(prompt(F.col("t"), F.col("r"), F.col("c"), rules).alias("p")).collect()
    head = ("Classify this document into exactly one of these categories: bank_statement, contract, invoice, "
            "purchase_order, receipt, report, resume\n\nRespond with JSON only: "
            '{"category": "<category_slug>", "confidence": <0.0-1.0>}\n\nEscalation context: ')
    tail = "\nKeyword engine's best guess: unclassified (confidence: "
    assert rows[0].p == head + "why" + tail + "0.4500)\n\nDocument text:\n" + "é" * PROMPT_CHARS
    assert rows[1].p == head + "Unknown" + tail + "0.0000)\n\nDocument text:\n"


def test_only_prompts_reach_the_model(spark, rules):
    df = spark.createDataFrame([(i, None if i % 3 else f"p{i}") for i in range(30)], "i int, p string")

    def model(prompts):
        assert all(p is not None for p in prompts) and len(prompts) <= 4
        return [json.dumps({"category": "report", "confidence": 0.5}) if p != "p3" else "?" for p in prompts]

    rows = df.withColumn("a", ask_model(F.col("p"), model, rules, delay=0, batch_size=4)).select("i", "a.*").collect()
    assert {r.i for r in rows if r.category == "report"} == {i for i in range(0, 30, 3)} - {3}
    assert all(r.confidence is None for r in rows if r.i % 3 or r.i == 3)


STATE = "fallback_prompt string, document_category string, classification_method string, classification_confidence double, llm_escalation_reason string"


def test_outcomes(spark, rules):
    rows = [("ask", "unclassified", "unclassified", 0.1, "low"), ("dead", "unclassified", "unclassified", 0.2, "low"), (None, "invoice", "deterministic", 0.9, None)]
    df = spark.createDataFrame(rows, STATE)
    yes = good("resume")
    out = apply_fallback(df, rules, lambda ps: [yes if p == "ask" else "?" for p in ps], delay=0, max_retries=0).collect()
    assert [(r.document_category, r.classification_method, r.classification_confidence, r.llm_unavailable) for r in out] == [
        ("resume", "llm_fallback", 0.9, False), ("unclassified", "unclassified", 0.2, True), ("invoice", "deterministic", 0.9, None)]
    assert [r.llm_failure for r in out] == [None, "unusable reply", None]
    assert [r.llm_failure for r in apply_fallback(df, rules, None).collect()] == ["no model", "no model", None]
    for none in (apply_fallback(df, rules, None), apply_fallback(df, RuleSet(), lambda ps: [])):
        assert [r.llm_unavailable for r in none.collect()] == [True, True, None]


@pytest.mark.parametrize("reply", ["[" * 200_000, '{"a":' * 200_000, '{"category": ' + "[" * 200_000])
def test_deeply_nested_reply_is_unusable(reply):
    assert parse_reply(reply, frozenset({"invoice"})) is None


def test_the_model_sees_whole_texts_unless_limited(spark, rules):
    from docsieve.plans.process import prepare
    text = "nothing here. " * 400 + "evidence at the end"
    df = spark.createDataFrame([("d", "a.txt", text)], "document_id string, source_filename string, parsed_markdown string")
    assert prepare(df, rules).first().fallback_prompt.endswith("evidence at the end")
    assert prepare(df, rules, prompt_chars=20).first().fallback_prompt.endswith(text[:20])


def counting(folder, breaks_on=None, fails_first=()):
    """A model that notes every prompt it is asked in a folder, and breaks off its process for one of them."""
    folder = str(folder)

    def model(prompts):
        import json
        import os
        import uuid
        replies = []
        for p in prompts:
            if p == breaks_on:
                os._exit(1)
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
                file.write(p)
            seen = sum(open(f"{folder}/{n}").read() == p for n in os.listdir(folder))
            answer = json.dumps({"category": "report", "confidence": 0.9})
            replies.append("?" if p in fails_first and seen == 1 else answer)
        return replies

    return model


def asked(folder):
    return sorted(p.read_text() for p in folder.iterdir())


def test_the_ledger_asks_each_prompt_once_across_a_broken_run(spark, rules, tmp_path):
    """30 documents with 10 distinct prompts; the first run dies in a late wave, the second asks the rest."""
    calls, path = tmp_path / "calls", str(tmp_path / "ledger")
    calls.mkdir()
    rows = [(f"p{i % 10}" if i < 30 else None, "unclassified" if i < 30 else "invoice",
             "unclassified" if i < 30 else "deterministic", 0.1, "low" if i < 30 else None) for i in range(33)]
    staged = stage(spark.createDataFrame(rows, STATE), "rows")
    settings = {"per_wave": 3, "delay": 0, "concurrency": 2}
    with pytest.raises(Exception):  # noqa: B017, PT011 - the worker is gone
        resolve_with_ledger(staged, rules, counting(calls, breaks_on="p7"), path, **settings)
    before = asked(calls)
    assert len(before) == len(set(before)) < 10 and "p7" not in before
    done = {r.key for r in read_ledger(spark, path).collect()}
    out = resolve_with_ledger(staged, rules, counting(calls), path, **settings)
    assert out.groupBy("document_category", "llm_unavailable").count().orderBy("document_category").collect() == [
        ("invoice", None, 3), ("report", False, 30)]
    # What was committed before the break is not asked again; the rest of the broken wave is asked at most twice.
    repeated = len(asked(calls)) - 10
    assert repeated == len(before) - len(done) < 3 and set(asked(calls)) == {f"p{i}" for i in range(10)}
    total = len(asked(calls))
    again = resolve_with_ledger(staged, rules, counting(calls), path, **settings)
    assert again.where("document_category = 'report'").count() == 30 and len(asked(calls)) == total


def test_the_ledger_keeps_attempts_and_reasons(spark, rules, tmp_path):
    calls, path = tmp_path / "calls", str(tmp_path / "ledger")
    calls.mkdir()
    staged = stage(spark.createDataFrame([(p, "unclassified", "unclassified", 0.1, "low") for p in "abca"], STATE), "rows")
    pauses = []
    out = resolve_with_ledger(staged, rules, counting(calls, fails_first=("b",)), path, delay=2, pause=pauses.append)
    assert out.where("llm_unavailable").count() == 0 and asked(calls) == ["a", "b", "b", "c"] and pauses == [2]
    assert sorted((r.attempt, r.failure) for r in read_ledger(spark, path).where("failure is not null").collect()) == [
        (0, "unusable reply")]

    def broken(prompts):
        raise TypeError("a mistake in the caller's model")

    other = str(tmp_path / "other")
    rows = resolve_with_ledger(staged, rules, broken, other, max_retries=1, delay=0).collect()
    assert {(r.llm_unavailable, r.llm_failure) for r in rows} == {(True, "TypeError: a mistake in the caller's model")}
    assert read_ledger(spark, other).count() == 6
    assert resolve_with_ledger(staged, rules, None, path).where("document_category = 'report'").count() == 4
