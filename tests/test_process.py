import json

import pytest
from pyspark.sql import functions as F

from docsieve import (
    Parsed, RuleStore, audit_from_results, audit_records, from_text, from_uploads, payload, process,
    read_files, record_violations, run_batch)
from docsieve.operators.redact import load_privacy_rules
from docsieve.operators.route import needs_fallback
from docsieve.operators.validate import validate
from docsieve.schemas import AUDIT, PAYLOAD
from docsieve.sinks.tables import export_audit_csv, read_audit
from tests import expected
from tests.texts import OTHERS, SAMPLES

NO_TEXT = "No parsed Markdown available for classification"


def simple(schema):
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def uploads(spark):
    rows = [(f"{k}.pdf", v.encode()) for k, v in SAMPLES.items()]
    rows += [("bad.exe", b"MZ"), ("empty.pdf", b""), ("vague.pdf", b"invoice number 5 bill to me"), ("none.pdf", b"zzz"), ("bin.png", b"\xff\x00")]
    return spark.createDataFrame(rows, "source_filename string, content binary").repartition(3)


def test_every_sample_flows_through(spark, rules):
    state = process(uploads(spark), rules, run_id="r", start_time_ms=0)
    rows = {r.source_filename: r for r in state.collect()}
    for slug, text in SAMPLES.items():
        r = rows[f"{slug}.pdf"]
        assert (r.document_category, r.classification_method) == (slug, "deterministic")
        assert r.extracted_fields == expected.fields(rules.get(slug), [text])[0]
        missing = [f for f in rules.get(slug).mandatory if f not in r.extracted_fields]
        assert r.validation_errors == [f"Missing mandatory field: '{f}'" for f in missing]
        assert r.validation_status == ("partial" if missing else "valid")
        assert r.llm_unavailable is None and r.processing_duration_ms == 0
    assert rows["bad.exe"].parse_error.startswith("File rejected") and rows["bad.exe"].pipeline_error == NO_TEXT
    assert rows["bad.exe"].validation_status == "invalid" and rows["bad.exe"].validation_errors == [NO_TEXT]
    assert rows["vague.pdf"].llm_unavailable is True and rows["vague.pdf"].validation_status == "valid"
    assert rows["vague.pdf"].llm_escalation_reason.startswith("Best match 'invoice' scored 0.")
    assert len({r.document_id for r in rows.values()}) == len(rows)


def test_ids_are_stable_and_given_ids_kept(spark, rules):
    first = {r.source_filename: r.document_id for r in process(uploads(spark), rules, run_id="r").select("source_filename", "document_id").collect()}
    again = {r.source_filename: r.document_id for r in process(uploads(spark).repartition(7), rules, run_id="r").select("source_filename", "document_id").collect()}
    other = {r.source_filename: r.document_id for r in process(uploads(spark), rules, run_id="s").select("source_filename", "document_id").collect()}
    assert first == again and not set(first.values()) & set(other.values())
    given = from_text(spark.createDataFrame([(7, "x")], "id int, body string"), "body", None, "id")
    row = process(given, rules).first()
    assert (row.document_id, row.source_filename) == ("7", "unknown")


def test_upload_without_a_name(spark, rules):
    df = spark.createDataFrame([(None, b"%PDF")], "name string, data binary")
    assert from_uploads(df, "name", "data").first().source_filename == "upload"


def test_duration(spark, rules):
    df = from_text(spark.createDataFrame([("x",)], "text string"))
    assert process(df, rules, start_time_ms=1).first().processing_duration_ms > 10 ** 12
    assert process(df, rules, start_time_ms=2 ** 60).first().processing_duration_ms == 0


def test_upstream_errors_stop_everything(spark, rules):
    df = from_text(spark.createDataFrame([(SAMPLES["invoice"], "broken upstream")], "text string, pipeline_error string"))
    state = process(df, rules)
    row = state.first()
    assert (row.document_category, row.matched_keywords, row.llm_unavailable, row.validation_errors) == (None, None, None, ["broken upstream"])
    assert payload(state).count() == 0
    entry = audit_records(state).first()
    assert (entry.extraction_method, entry.classification_result, entry.confidence_score, entry.validation_outcome) == ("unclassified", "unclassified", 0.0, "failed")


def test_record_schemas(spark, rules):
    state = process(uploads(spark), rules)
    assert simple(payload(state).schema) == simple(spark.createDataFrame([], PAYLOAD).schema)
    assert simple(audit_records(state).schema) == simple(spark.createDataFrame([], AUDIT).schema)


def test_validation_precedence(spark, rules):
    cases = [
        ("invoice", {"invoice_number": "1", "invoice_date": "d", "total_amount": "5"}, None, "valid", []),
        ("invoice", {"invoice_number": " \t", "total_amount": " "}, None, "partial", ["invoice_number", "invoice_date", "total_amount"]),
        ("invoice", None, None, "partial", ["invoice_number", "invoice_date", "total_amount"]),
        ("unclassified", {}, None, "valid", []), (None, {}, None, "valid", []), ("memo", {}, None, "valid", []), ("invoice", {}, "E", "invalid", None)]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, document_category string, extracted_fields map<string,string>, pipeline_error string")
    for r in validate(df, rules).collect():
        status, missing = cases[r.i][3:]
        assert r.validation_status == status
        assert r.validation_errors == (["E"] if missing is None else [f"Missing mandatory field: '{f}'" for f in missing])


def test_routing(spark):
    df = spark.createDataFrame([(None, "why"), ("e", "why"), (None, None), (None, "")], "pipeline_error string, llm_escalation_reason string")
    assert [r.needs_fallback for r in needs_fallback(df).collect()] == [True, False, False, False]


@pytest.mark.parametrize("concurrency", [None, 2])
def test_batch_run_with_a_model(spark, rules, tmp_path, concurrency):
    calls = spark.sparkContext.accumulator(0)

    def model(prompts):
        calls.add(len(prompts))
        return ['{"category": "invoice", "confidence": 0.7}' if "bill to me" in p else "no" for p in prompts]

    run = run_batch(uploads(spark), rules, results_path=f"{tmp_path}/results", audit_path=f"{tmp_path}/audit", infer=model,
                    fallback={"delay": 0, "max_retries": 0}, fallback_concurrency=concurrency, run_id="run1")
    assert calls.value == 2  # one call per escalated document, although two tables are written
    audit = read_audit(spark, f"{tmp_path}/audit")
    assert audit.count() == uploads(spark).count() and audit.select("document_id").distinct().count() == audit.count()
    results = spark.read.parquet(f"{tmp_path}/results")
    assert results.count() == audit.count() - 3
    by_name = {r.source_filename: r for r in results.collect()}
    solved = by_name["vague.pdf"]
    assert (solved.document_category, solved.classification_method, solved.classification_confidence, solved.validation_status) == ("invoice", "llm_fallback", 0.7, "partial")
    assert solved.llm_escalation_reason and solved.matched_keywords and solved.llm_unavailable is False
    assert by_name["none.pdf"].llm_unavailable is True
    assert {"process", "fallback", "audit", "results"} == set(run.seconds)
    assert len(run.staged) == 2
    run.discard_staging()
    assert not run.staged and results.count() == audit.count() - 3
    line = json.loads(next(iter(open(next((tmp_path / "audit" / "run_id=run1").glob("part-*.json"))))))
    assert set(line) == {c.split()[0] for c in AUDIT.split(", ")}


def test_finished_runs_are_never_rewritten(spark, rules, tmp_path):
    args = dict(audit_path=f"{tmp_path}/audit", run_id="once")
    run_batch(uploads(spark), rules, **args)
    with pytest.raises(Exception, match="(?i)exists"):
        run_batch(uploads(spark), rules, **args)
    run_batch(uploads(spark), rules, audit_path=f"{tmp_path}/audit", run_id="twice")
    assert read_audit(spark, f"{tmp_path}/audit").count() == 2 * uploads(spark).count()


def test_prompts_are_redacted_before_the_model(spark, rules):
    text = "invoice number 5 bill to jo@example.com " + "x" * 3980 + " ann.long.address@example.com"
    seen = []
    def model(prompts):
        return [p if "example.com" in p else '{"category": "invoice", "confidence": 1}' for p in prompts]
    df = from_text(spark.createDataFrame([(text,)], "text string"))
    done = process(df, rules, infer=model, privacy=load_privacy_rules(), fallback={"delay": 0, "max_retries": 0}).first()
    assert done.classification_method == "llm_fallback"


def test_debug_markdown_needs_the_switch(spark, rules, tmp_path, monkeypatch):
    run_batch(uploads(spark), rules, markdown_path=f"{tmp_path}/a", run_id="r")
    assert not (tmp_path / "a").exists()
    monkeypatch.setenv("DEBUG_PERSIST_MARKDOWN", "TRUE")
    run_batch(uploads(spark), rules, markdown_path=f"{tmp_path}/a", run_id="r")
    assert spark.read.parquet(f"{tmp_path}/a").filter("parsed_markdown like '%TAX INVOICE%'").count() == 1


def test_csv_export(spark, rules, tmp_path):
    export_audit_csv(audit_records(process(uploads(spark), rules)), f"{tmp_path}/csv")
    rows = spark.read.option("header", "true").option("escape", '"').csv(f"{tmp_path}/csv").collect()
    assert len(rows) == uploads(spark).count()
    assert json.loads(next(r for r in rows if r.source_filename == "bad.exe").validation_errors) == [NO_TEXT]


def test_audit_from_results_rounds(spark, rules):
    results = payload(process(uploads(spark), rules)).withColumn("processed_at", F.lit("2024-01-01").cast("timestamp"))
    for r in audit_from_results(results).join(results.select("document_id", "classification_confidence"), "document_id").collect():
        assert r.confidence_score == round(r.classification_confidence, 4) and r.timestamp.year == 2024


def test_record_violations(spark):
    df = spark.createDataFrame([("1", "deterministic", 0.5, "valid"), (None, "magic", 1.5, None)],
                               "document_id string, classification_method string, classification_confidence double, validation_status string")
    assert [r.record_violations for r in record_violations(df).collect()] == [
        [], ["document_id", "classification_method", "classification_confidence", "validation_status"]]


def test_reading_a_directory(spark, rules, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_text(SAMPLES["invoice"])
    (tmp_path / "sub" / "b.PDF").write_text("x")
    assert {r.source_filename for r in read_files(spark, str(tmp_path)).collect()} == {"a.pdf"}
    both = read_files(spark, str(tmp_path), recursive=True)
    row = next(r for r in process(both, rules).collect() if r.source_filename == "a.pdf")
    assert row.document_category == "invoice" and row.source_path.endswith("/a.pdf")
    assert row.document_metadata.file_size_bytes == len(SAMPLES["invoice"].encode()) and row.document_metadata.modified_at
    assert read_files(spark, str(tmp_path), recursive=True, glob="*.pdf").count() == 1


def test_corrected_dictionary_by_store(spark):
    store = RuleStore(variant="corrected")
    text = SAMPLES["invoice"].replace("03/11/2024", "2024-11-03")
    df = from_text(spark.createDataFrame([(text,)], "text string"))
    assert process(df, store.load()).first().extracted_fields["invoice_date"] == "2024-11-03"
    assert "invoice_date" not in process(df).first().extracted_fields


def test_custom_parser(spark, rules):
    text = SAMPLES["resume"]
    df = spark.createDataFrame([("cv.pdf", b"\x00\x01")], "source_filename string, content binary")
    assert process(df, rules, parser=lambda n, c: Parsed(text)).first().document_category == "resume"


def test_others_never_fail(spark, rules):
    state = process(from_text(spark.createDataFrame([(t,) for t in OTHERS], "text string")), rules)
    assert state.count() == len(OTHERS)
