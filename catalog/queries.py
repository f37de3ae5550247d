"""One registered query per operator family, each over whole tables."""

from __future__ import annotations

import re
import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.corpus import corpus, order_files, order_texts, rendered, spark_table
from docsieve.functions.binding import computed_once
from docsieve.functions.files import file_extension, is_watched, mime_type
from docsieve.functions.markup import HTML_STEPS, html_text
from docsieve.functions.rounding import round_exact
from docsieve.operators.classify import (
    classify, classify_long, explain_scores, extract_fields, keyword_evidence)
from docsieve.operators.fallback import ask_model
from docsieve.operators.gate import gate_error
from docsieve.operators.metadata import file_metadata, internal_kind
from docsieve.operators.parse import Parsed, parse_documents
from docsieve.operators.redact import flags_of_counts, load_privacy_rules, privacy_counts, redacted
from docsieve.operators.route import needs_fallback, resolve_branches
from docsieve.operators.validate import record_violations, validate
from docsieve.plans.batch import run_batch
from docsieve.plans.process import audit_from_results, audit_records, finish, payload, prepare, process
from docsieve.plans.quality import (
    acceptance, audit_with_results, confusion, confusion_matrix, feedback_records, integrity_breaches,
    misfiring_keywords, missing_keywords, run_metrics, windowed_metrics)
from docsieve.rules import Category, FieldPattern, RuleSet, load_rules
from docsieve.schemas import FEEDBACK
from docsieve.session import checkpoint_folder, spread, stage, staging_path
from docsieve.sinks.tables import export_audit_csv, read_audit, write_feedback
from docsieve.sources.documents import from_text
from docsieve.sources.rule_tables import category_table, mandatory_table, small

#: Field, pattern and group: a name with an underscore, an open count, a bare brace, a conditional, a flag, a lazy loop.
CUSTOM_PATTERNS = (
    ("name", r"(?P<order_key>INV-\d+)", 1), ("count", r"total\D{,9}(\d+)", 1), ("brace", r"no{t|(customer)", 1),
    ("condition", r"(<)?(supplier|invoice)(?(1)>)", 2), ("flag", r"(?a)date:?\s*(\w+)", 1),
    ("loop", r"((?:[a-z]+ ){2,4}?[a-z]+)\.", 1))

RULES = load_rules()
PRIVACY = load_privacy_rules()
SEP = "|"


def _joined(column: str):
    return F.array_join(column, SEP).alias(column)


def _state(df: DataFrame, **options) -> DataFrame:
    documents = from_text(df, "text", F.concat("doc_id", F.lit(".pdf")), "doc_id")
    return process(documents, RULES, run_id="catalog", start_time_ms=0, **options)


# Classification ---------------------------------------------------------------------------------

def classify_best(spark: SparkSession, sf: str) -> DataFrame:
    return classify(corpus(spark, sf), RULES).select(
        "doc_id", "document_category", "classification_method", "classification_confidence",
        _joined("matched_keywords"), "llm_escalation_reason")


def score_explain(spark: SparkSession, sf: str) -> DataFrame:
    return explain_scores(corpus(spark, sf).select("doc_id", "text"), RULES).select(
        "doc_id", "category", "ordinal", "confidence", "threshold", "n_primary", "n_secondary",
        "excluded", _joined("matched_keywords"))


def matched_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return keyword_evidence(corpus(spark, sf), RULES, "doc_id").select(
        "doc_id", "category", "tier", "pos", "keyword")


def classify_relational(spark: SparkSession, sf: str) -> DataFrame:
    return classify_long(corpus(spark, sf), RULES, "doc_id").select(
        "doc_id", "category", "confidence", "threshold", F.array_join("matched", SEP).alias("matched"))


def exclusion_penalty(spark: SparkSession, sf: str) -> DataFrame:
    scores = explain_scores(corpus(spark, sf).select("doc_id", "text"), RULES)
    return scores.filter("excluded").select("doc_id", "category", "confidence", "n_primary", "n_secondary")


def primary_guard(spark: SparkSession, sf: str) -> DataFrame:
    scores = explain_scores(corpus(spark, sf).select("doc_id", "text"), RULES)
    limits = category_table(spark, RULES).select("category", "min_primary")
    return scores.join(small(limits, len(RULES)), "category").groupBy("category").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("n_primary") < F.col("min_primary")).alias("guarded"),
        F.count_if(F.col("confidence") > 0).alias("scored"))


def threshold_route(spark: SparkSession, sf: str) -> DataFrame:
    decided = classify(corpus(spark, sf), RULES).withColumn("pipeline_error", F.lit(None).cast("string"))
    return needs_fallback(decided).groupBy("needs_fallback", "document_category").agg(
        F.count(F.lit(1)).alias("documents"), F.max("classification_confidence").alias("top_confidence"))


def escalation_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return classify(corpus(spark, sf), RULES).filter(F.col("llm_escalation_reason").isNotNull()).groupBy(
        "llm_escalation_reason").agg(F.count(F.lit(1)).alias("documents"))


def rounded_confidence(spark: SparkSession, sf: str) -> DataFrame:
    scores = explain_scores(corpus(spark, sf).select("doc_id", "text"), RULES)
    return scores.filter("confidence > 0").select(
        "doc_id", "category", round_exact(F.col("confidence")).alias("confidence"))


# Extraction and validation ----------------------------------------------------------------------

def extracted_fields(spark: SparkSession, sf: str) -> DataFrame:
    found = extract_fields(classify(corpus(spark, sf), RULES), RULES)
    return found.select("doc_id", F.col("document_category").alias("category"),
                        F.explode("extracted_fields").alias("field", "value"))


def custom_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields by patterns that are valid in Python and that Java refuses or reads in another way."""
    own = Category(slug="own", display_name="Own", threshold=0.5, primary=("a",), patterns=tuple(
        FieldPattern(name, pattern, group) for name, pattern, group in CUSTOM_PATTERNS))
    found = extract_fields(corpus(spark, sf).withColumn("document_category", F.lit("own")), RuleSet((own,)))
    return found.select("doc_id", F.explode("extracted_fields").alias("field", "value"))


def mandatory_validation(spark: SparkSession, sf: str) -> DataFrame:
    found = extract_fields(classify(corpus(spark, sf), RULES), RULES)
    checked = validate(found.withColumn("pipeline_error", F.lit(None).cast("string")), RULES)
    return checked.select("doc_id", "document_category", "validation_status", _joined("validation_errors"))


def missing_mandatory(spark: SparkSession, sf: str) -> DataFrame:
    """The same as an anti join: required (document, field) pairs without an extracted value."""
    found = stage(extract_fields(classify(corpus(spark, sf), RULES), RULES).select(
        "doc_id", F.col("document_category").alias("category"), "extracted_fields"), "found")
    n = sum(len(c.mandatory) for c in RULES)
    required = found.join(small(mandatory_table(spark, RULES), n), "category").select(
        "doc_id", "category", "field")
    present = found.select("doc_id", F.explode("extracted_fields").alias("field", "value"))
    return required.join(present, ["doc_id", "field"], "left_anti").select("doc_id", "category", "field")


def config_lookup(spark: SparkSession, sf: str) -> DataFrame:
    decided = classify(corpus(spark, sf), RULES)
    n = sum(len(c.mandatory) for c in RULES)
    needed = mandatory_table(spark, RULES).groupBy("category").agg(F.count(F.lit(1)).alias("mandatory_fields"))
    dimension = category_table(spark, RULES).select("category", "display_name", "threshold")
    return (
        decided.withColumnRenamed("document_category", "category")
        .join(small(dimension, len(RULES)), "category", "left")
        .join(small(needed, n), "category", "left")
        .groupBy("category", "display_name", "threshold", "mandatory_fields")
        .agg(F.count(F.lit(1)).alias("documents")))


def known_slugs(spark: SparkSession, sf: str) -> DataFrame:
    """Order texts whose proposed category, here the first word of the priority, is a known one."""
    proposed = rendered(spark, sf).select(
        "doc_id", F.when(F.col("text").startswith("PURCHASE"), F.lit("purchase_order"))
        .otherwise(F.lower(F.regexp_extract("text", r"^([A-Za-z]+)", 1))).alias("category"))
    return proposed.join(small(category_table(spark, RULES).select("category"), len(RULES)),
                         "category", "left_semi").select("doc_id", "category")


def record_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Domain checks over rows that partly violate them: scores as confidence, status as outcome."""
    rows = spark_table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("document_id"),
        (F.col("o_totalprice") / 400000.0).alias("confidence_score"),
        F.when(F.col("o_orderstatus") == "F", F.lit("failed")).when(
            F.col("o_orderstatus") == "P", F.lit("partial")).otherwise(F.lit("open")).alias("validation_outcome"))
    return record_violations(rows).select("document_id", _joined("record_violations"))


# Files ------------------------------------------------------------------------------------------

def file_extensions(spark: SparkSession, sf: str) -> DataFrame:
    names = order_files(spark, sf).select("doc_id", "file_name").unionByName(
        spark_table(spark, sf, "pages").select(
            F.concat(F.lit("page-"), "page_id").alias("doc_id"), F.col("url").alias("file_name")))
    return names.select("doc_id", file_extension(F.col("file_name")).alias("extension"),
                        is_watched(F.col("file_name")).alias("watched"))


def mime_types(spark: SparkSession, sf: str) -> DataFrame:
    files = order_files(spark, sf)
    return files.select("doc_id", mime_type(F.col("content")).alias("mime"))


def file_gate(spark: SparkSession, sf: str) -> DataFrame:
    files = order_files(spark, sf)
    return files.select("doc_id", gate_error(F.col("file_name"), F.col("content")).alias("parse_error"))


def file_properties(spark: SparkSession, sf: str) -> DataFrame:
    meta = order_files(spark, sf).select(
        "doc_id", file_metadata(F.col("file_name"), F.col("content")).alias("m"))
    return meta.select("doc_id", "m.file_size_bytes", "m.file_extension", "m.mime_type",
                       internal_kind(F.col("m.file_extension"), F.col("m.mime_type")).alias("reader"))


def page_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = spread(spark_table(spark, sf, "pages"))
    return pages.select("page_id", html_text(F.col("html")).alias("text"))


def html_parse(spark: SparkSession, sf: str) -> DataFrame:
    """The pluggable parser over whole pages; it must agree with the built-in expression."""
    steps = HTML_STEPS

    def parser(name: str, content: bytes) -> Parsed:
        text = content.decode("utf-8")
        for pattern, replacement in steps:
            text = re.sub(pattern, replacement, text)
        return Parsed(text.strip(" \n"))

    pages = spread(spark_table(spark, sf, "pages")).select(
        "page_id", F.lit("page.pdf").alias("source_filename"), F.encode("html", "UTF-8").alias("content"))
    return parse_documents(pages, parser).select("page_id", F.col("parsed_markdown").alias("text"), "parse_error")


# Privacy ----------------------------------------------------------------------------------------

def privacy_scan(spark: SparkSession, sf: str) -> DataFrame:
    documents = spread(spark_table(spark, sf, "documents"))
    counted = computed_once(documents, "n", privacy_counts(F.col("text"), PRIVACY))
    return counted.select("doc_id", F.array_join(flags_of_counts(F.col("n"), PRIVACY), SEP).alias("flags"), "n.*")


def privacy_redact(spark: SparkSession, sf: str) -> DataFrame:
    documents = spread(spark_table(spark, sf, "documents"))
    return documents.select("doc_id", redacted(F.col("text"), PRIVACY).alias("text"))


# Fallback ---------------------------------------------------------------------------------------

def fallback_prompt(spark: SparkSession, sf: str) -> DataFrame:
    state = prepare(from_text(corpus(spark, sf), "text", "doc_id", "doc_id"), RULES, run_id="catalog",
                    start_time_ms=0, prompt_chars=4000)
    shown = state.filter(F.col("fallback_prompt").isNotNull())
    return shown.select(F.col("document_id").alias("doc_id"), F.length("fallback_prompt").alias("chars"),
                        F.md5("fallback_prompt").alias("digest"))


def fallback_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Replies of every shape, made from the orders and echoed by the model function."""
    score = F.concat(F.lit("0."), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"))
    reply = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(
            F.lit(' {"category": "invoice", "confidence": '), score, F.lit("}\n")))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(
            F.lit('{"category": "memo", "confidence": '), score, F.lit("}")))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(
            F.lit('{"category": "report", "confidence": "'), score, F.lit('"}')))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.concat(
            F.lit('{"category": "resume", "confidence": 7'), score, F.lit("}")))
        .otherwise(F.concat(F.lit('{"category": "invoice", "confidence": '), score, F.lit("} done"))))
    replies = spread(spark_table(spark, sf, "orders")).select("o_orderkey", reply.alias("reply"))
    answer = ask_model(F.col("reply"), lambda prompts: list(prompts), RULES, delay=0.0)
    return replies.withColumn("a", answer).select("o_orderkey", "a.category", "a.confidence")


def _model(prompts):
    return ['{"category": "invoice", "confidence": 0.75}' if "Invoice Number" in p else "unsure" for p in prompts]


def fallback_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(_state(corpus(spark, sf), infer=_model, fallback={"delay": 0.0, "max_retries": 1}))


def branch_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the undecided rows of a written table in tasks of their own, then merged."""
    documents = from_text(corpus(spark, sf), "text", F.concat("doc_id", F.lit(".pdf")), "doc_id")
    scored = stage(prepare(documents, RULES, run_id="catalog", start_time_ms=0), "scored")
    tasks = spark.sparkContext.defaultParallelism
    return _resolved(finish(resolve_branches(scored, RULES, _model, tasks, delay=0.0, max_retries=1), RULES))


def _resolved(state: DataFrame) -> DataFrame:
    return state.select(
        F.col("document_id").alias("doc_id"), "document_category", "classification_method",
        "classification_confidence", F.coalesce("llm_unavailable", F.lit(False)).alias("llm_unavailable"),
        "validation_status", _joined("validation_errors"))


# Records, sinks and quality ---------------------------------------------------------------------

def audit_log(spark: SparkSession, sf: str) -> DataFrame:
    return audit_records(_state(corpus(spark, sf))).select(
        "document_id", "source_filename", "extraction_method", "llm_escalation_reason", "llm_unavailable",
        "classification_result", "confidence_score", "validation_outcome", _joined("validation_errors"),
        "processing_duration_ms")


def result_payload(spark: SparkSession, sf: str) -> DataFrame:
    return payload(_state(corpus(spark, sf))).select(
        "document_id", "source_filename", "document_category", "classification_method",
        "classification_confidence", _joined("matched_keywords"), "llm_escalation_reason",
        "llm_unavailable", F.size("extracted_fields").alias("n_fields"), "validation_status",
        _joined("validation_errors"), "processing_duration_ms")


def audit_from_payload(spark: SparkSession, sf: str) -> DataFrame:
    results = payload(_state(rendered(spark, sf)))
    return audit_from_results(results).select(
        "document_id", "extraction_method", "classification_result", "confidence_score",
        "validation_outcome")


def audit_output_join(spark: SparkSession, sf: str) -> DataFrame:
    state = stage(_state(rendered(spark, sf)), "state")  # both sides read the one written table
    return audit_with_results(audit_records(state), payload(state)).select(
        "document_id", "classification_result", "document_category", "confidence_score",
        "validation_outcome", "validation_status")


def audit_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """Labels taken as audit entries of the documents: every unlabelled document is a breach."""
    return integrity_breaches(
        spark_table(spark, sf, "documents"), spark_table(spark, sf, "labels"), "doc_id")


def failed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without text or with an error from upstream: they are not scored, and have an audit entry."""
    key = F.col("o_orderkey") % 10
    broken = spark_table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("key"),
        F.when(key < 3, F.lit(None)).when(key < 6, F.lit("")).otherwise(F.lit("invoice number")).alias("text"),
        F.when(key.isin(0, 4, 7, 8), F.concat(F.lit("upstream "), F.col("o_orderstatus"))).alias("pipeline_error"))
    state = process(from_text(spread(broken), "text", "key", "key"), RULES, run_id="catalog", start_time_ms=0)
    return audit_records(state.where("pipeline_error is not null")).select(
        "document_id", "extraction_method", "classification_result", "confidence_score", "validation_outcome",
        _joined("validation_errors"))


def feedback_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews written as JSON, once more after a failed attempt, and read back."""
    path = staging_path(spark, "feedback")
    feedback = stage(_feedback(spark, sf, _reviewed(spark, sf)), "reviews")  # both writes read the one scored table
    for _ in range(2):
        write_feedback(feedback, path, "reviews", "overwrite")
    return spark.read.schema(FEEDBACK).json(path).groupBy("predicted_category", "reviewer_correct_category").agg(
        F.count(F.lit(1)).alias("documents"))


def audit_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The audit of the order texts as CSV, read back."""
    path = staging_path(spark, "csv")
    export_audit_csv(audit_records(_state(rendered(spark, sf))), path)
    return spark.read.option("header", "true").option("escape", '"').csv(path).select(
        "document_id", "extraction_method", "classification_result", "validation_outcome",
        F.array_join(F.from_json("validation_errors", "array<string>"), SEP).alias("validation_errors"))


def generated_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without a key, many of them equal: each row has an id and an audit entry of its own."""
    texts = spark_table(spark, sf, "documents").select("text")
    audit = audit_records(process(from_text(texts), RULES, run_id="catalog", start_time_ms=0))
    return audit.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("document_id").alias("ids"),
                     F.countDistinct("audit_id").alias("audit_ids"))


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    return run_metrics(audit_records(_state(corpus(spark, sf)))).select(
        "documents", "fallback_rate", "fallback_unavailable_rate", "validation_failure_rate")


def metrics_by_window(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics per 30 days over order texts, audited as of the order date."""
    dates = spark_table(spark, sf, "orders").select(
        F.concat(F.lit("order-"), "o_orderkey").alias("document_id"),
        F.col("o_orderdate").cast("timestamp").alias("at"))
    audit = audit_records(_state(rendered(spark, sf)))
    dated = audit.join(dates, "document_id").withColumn("timestamp", F.col("at"))
    return windowed_metrics(dated, "30 days").select(
        (F.unix_timestamp("window.start") / 86400).cast("bigint").alias("start_day"),
        "documents", "fallback_rate", "validation_failure_rate")


def acceptance_eval(spark: SparkSession, sf: str) -> DataFrame:
    texts = corpus(spark, sf)
    expected = texts.select(F.col("doc_id").alias("document_id"), "expected_category")
    return acceptance(audit_records(_state(texts)), expected)


def _feedback(spark: SparkSession, sf: str, texts: DataFrame) -> DataFrame:
    reviews = texts.select(F.col("doc_id").alias("document_id"),
                           F.col("expected_category").alias("reviewer_correct_category"))
    return feedback_records(payload(_state(texts)), reviews)


def feedback_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return confusion(_feedback(spark, sf, _reviewed(spark, sf)))


def feedback_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """One column per category of the rules, and one for labels that the rules do not know."""
    return confusion_matrix(_feedback(spark, sf, _reviewed(spark, sf)), [*RULES.slugs, "unclassified"])


def keyword_misfires(spark: SparkSession, sf: str) -> DataFrame:
    return misfiring_keywords(_feedback(spark, sf, _reviewed(spark, sf)))


def keyword_gap(spark: SparkSession, sf: str) -> DataFrame:
    texts = _reviewed(spark, sf)
    evidence = keyword_evidence(texts.select(F.col("doc_id").alias("document_id"), "text"), RULES, "document_id")
    return missing_keywords(_feedback(spark, sf, texts), evidence)


def _reviewed(spark: SparkSession, sf: str) -> DataFrame:
    """All texts with a reviewer who calls anything mentioning an invoice number an invoice."""
    return corpus(spark, sf).withColumn("expected_category", F.when(
        F.contains("text", F.lit("Invoice Number")), F.lit("invoice")).otherwise(F.col("expected_category")))


def end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    """Order texts through the whole flow: the key, date and amount come back out of the text."""
    done = payload(_state(rendered(spark, sf)))
    field = partial(F.try_element_at, F.col("extracted_fields"))
    return done.filter(F.col("document_category") == "invoice").select(
        "document_id", field(F.lit("invoice_number")).alias("invoice_number"),
        field(F.lit("invoice_date")).alias("invoice_date"),
        field(F.lit("total_amount")).alias("total_amount"),
        "classification_confidence", "validation_status")


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Orders arrive as a stream; each micro-batch is rendered, processed and written once."""
    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    orders = spark_table(spark, sf, "orders")
    # A glob, because a stream takes a plain path for a directory.
    stream = spark.readStream.schema(orders.schema).parquet(f"{sf}/orders.parque[t]")

    def handle(batch: DataFrame, batch_id: int) -> None:
        customer = spark_table(batch.sparkSession, sf, "customer")
        texts = order_texts(batch, customer)
        run = run_batch(from_text(texts, "text", "doc_id", "doc_id"), RULES, results_path=f"{folder}/results",
                        audit_path=f"{folder}/audit", run_id=f"orders-{batch_id:09d}", mode="overwrite",
                        start_time_ms=0)
        run.discard_staging()

    query = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    results, audit = spark.read.parquet(f"{folder}/results"), read_audit(spark, f"{folder}/audit")
    return audit.join(results.select("document_id", "document_category", "validation_status"), "document_id").select(
        "document_id", "document_category", "extraction_method", "confidence_score", "validation_status",
        "validation_outcome")


QUERIES = {
    "classify_best": classify_best,
    "score_explain": score_explain,
    "matched_keywords": matched_keywords,
    "classify_relational": classify_relational,
    "exclusion_penalty": exclusion_penalty,
    "primary_guard": primary_guard,
    "threshold_route": threshold_route,
    "escalation_reasons": escalation_reasons,
    "rounded_confidence": rounded_confidence,
    "extracted_fields": extracted_fields,
    "custom_fields": custom_fields,
    "mandatory_validation": mandatory_validation,
    "missing_mandatory": missing_mandatory,
    "config_lookup": config_lookup,
    "known_slugs": known_slugs,
    "record_checks": record_checks,
    "file_extensions": file_extensions,
    "mime_types": mime_types,
    "file_gate": file_gate,
    "file_properties": file_properties,
    "page_text": page_text,
    "html_parse": html_parse,
    "privacy_scan": privacy_scan,
    "privacy_redact": privacy_redact,
    "fallback_prompt": fallback_prompt,
    "fallback_replies": fallback_replies,
    "fallback_resolve": fallback_resolve,
    "branch_merge": branch_merge,
    "audit_log": audit_log,
    "result_payload": result_payload,
    "audit_from_payload": audit_from_payload,
    "audit_output_join": audit_output_join,
    "audit_integrity": audit_integrity,
    "failed_documents": failed_documents,
    "feedback_sink": feedback_sink,
    "audit_csv": audit_csv,
    "generated_ids": generated_ids,
    "metrics": metrics,
    "metrics_by_window": metrics_by_window,
    "acceptance_eval": acceptance_eval,
    "feedback_confusion": feedback_confusion,
    "feedback_matrix": feedback_matrix,
    "keyword_misfires": keyword_misfires,
    "keyword_gap": keyword_gap,
    "end_to_end": end_to_end,
    "stream_ingest": stream_ingest,
}
