"""The whole document flow as one lazy plan, and its record projections."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions.binding import computed_once
from docsieve.functions.rounding import round_exact
from docsieve.functions.scoring import scored_best
from docsieve.operators.classify import classification, field_map
from docsieve.operators.fallback import Infer, apply_fallback, prompt
from docsieve.operators.metadata import office_properties
from docsieve.operators.parse import Parser, PropertyReader, parse_documents
from docsieve.operators.redact import PrivacyRule, redacted
from docsieve.operators.validate import record_violations, validate
from docsieve.rules import RuleSet, load_rules

# Messages and defaults that appear in records.
NO_TEXT = "No parsed Markdown available for classification"
OUTCOME_OF_STATUS = {"valid": "passed", "invalid": "failed", "partial": "partial"}

_DECIDED = ("document_category", "classification_method", "classification_confidence",
            "matched_keywords", "llm_escalation_reason")
_OPTIONAL = {
    "parse_error": "string", "pipeline_error": "string", "source_path": "string",
    "document_metadata": None, "start_time_ms": "bigint"}


def document_key(df: DataFrame, run_id: str) -> Column:
    """Deterministic id: run, origin and content, and for rows of a text table their place as well.

    Files and uploads have the same id however they are partitioned; uploads equal in name and bytes share it.
    Texts of a table are often equal in everything, so they take their partition and row number too and each
    has an id of its own. A scan yields the same ones in every action and retry; behind a shuffle supply
    ``document_id``, or use ``run_batch``, which stages the rows once.
    """
    origin = [F.col(c) for c in ("source_path", "source_filename") if c in df.columns]
    if not {"source_path", "content"} & set(df.columns):
        origin.append(F.monotonically_increasing_id().cast("string"))
    body = F.col("content") if "content" in df.columns else F.col("parsed_markdown").cast("binary")
    return F.sha2(F.concat_ws("\x1f", F.lit(run_id), *origin, F.sha2(F.coalesce(body, F.lit(b"")), 256)), 256)


def classify_state(df: DataFrame, rules: RuleSet,
                   privacy: tuple[PrivacyRule, ...] | None = None, prompt_chars: int | None = None) -> DataFrame:
    """Error short-circuit, classification, field extraction and the prompt for undecided rows."""
    text = F.col("parsed_markdown")
    upstream = F.col("pipeline_error") if "pipeline_error" in df.columns else F.lit(None).cast("string")
    error = F.when(F.coalesce(upstream, F.lit("")) != "", upstream).when(
        F.coalesce(text, F.lit("")) == "", F.lit(NO_TEXT))
    flagged = df.withColumn("pipeline_error", error)
    runs = F.col("pipeline_error").isNull()
    scored = computed_once(flagged, "_best", scored_best(F.when(runs, text), rules))
    decided = scored.withColumn("_decision", F.when(runs, classification(F.col("_best"), rules)))
    reason = F.col("_decision.llm_escalation_reason")
    # Whole documents are masked before a prompt with a limit takes its leading characters.
    shown = redacted(text, privacy) if privacy else text
    fields = F.when(runs, field_map(text, F.col("_decision.document_category"), rules))
    return computed_once(decided, "extracted_fields", fields).withColumns({
        **{c: F.col(f"_decision.{c}") for c in _DECIDED},
        "fallback_prompt": F.when(runs & (F.coalesce(reason, F.lit("")) != ""), prompt(
            shown, reason, F.col("_decision.confidence_text"), rules, max_chars=prompt_chars)),
    }).drop("_best", "_decision")


def prepare(df: DataFrame, rules: RuleSet, *, parser: Parser | None = None,
            parser_factory: Callable[[], Parser] | None = None,
            properties: PropertyReader = office_properties,
            privacy: tuple[PrivacyRule, ...] | None = None, run_id: str | None = None,
            start_time_ms: int | None = None, keep_text: bool = False,
            prompt_chars: int | None = None) -> DataFrame:
    """Everything up to the model: narrow state rows plus ``fallback_prompt``.

    The model sees whole texts unless ``prompt_chars`` limits them.
    """
    run_id = run_id or uuid.uuid4().hex
    started = int(time.time() * 1000) if start_time_ms is None else start_time_ms
    if "document_id" not in df.columns:
        df = df.withColumn("document_id", document_key(df, run_id))
    if "start_time_ms" not in df.columns:
        df = df.withColumn("start_time_ms", F.lit(started).cast("bigint"))
    if "content" in df.columns:
        df = parse_documents(df, parser, parser_factory=parser_factory, properties=properties)
    state = classify_state(df, rules, privacy, prompt_chars)
    missing = {c: F.lit(None).cast(t) for c, t in _OPTIONAL.items() if t and c not in state.columns}
    state = state.withColumns({**missing, "run_id": F.lit(run_id)})
    keep = ["run_id", "document_id", "source_filename", "source_path", "start_time_ms", "parse_error",
            "pipeline_error", *_DECIDED, "extracted_fields", "fallback_prompt"]
    keep += ["document_metadata"] if "document_metadata" in state.columns else []
    return state.select(*keep, *(["parsed_markdown"] if keep_text else []))


def finish(state: DataFrame, rules: RuleSet) -> DataFrame:
    """Validation and timing on rows whose branch is resolved."""
    elapsed = F.unix_millis(F.current_timestamp()) - F.col("start_time_ms")
    return validate(state, rules).withColumn(
        "processing_duration_ms",
        F.when(F.coalesce(F.col("start_time_ms"), F.lit(0)) != 0, F.greatest(F.lit(0), elapsed))
        .otherwise(F.lit(0)).cast("bigint"))


def process(df: DataFrame, rules: RuleSet | None = None, *, infer: Infer | None = None,
            fallback: dict[str, Any] | None = None, **options: Any) -> DataFrame:
    """Documents in, final state out, as one lazy plan without a shuffle.

    ``df`` holds ``source_filename`` with either ``content`` bytes or ``parsed_markdown`` text. With
    a model the plan calls it again in every action; use ``run_batch`` to call it once.
    """
    rules = rules if rules is not None else load_rules()
    prepared = prepare(df, rules, **options)
    return finish(apply_fallback(prepared, rules, infer, **(fallback or {})), rules)


def _default(name: str, value: object, ddl: str | None = None) -> Column:
    literal = F.array().cast("array<string>") if value == [] else F.lit(value)
    return F.coalesce(F.col(name), literal.cast(ddl) if ddl else literal)


def _failed() -> Column:
    return F.coalesce(F.col("pipeline_error"), F.lit("")) != ""


def checked_state(state: DataFrame) -> DataFrame:
    """Add ``record_violations`` before payload defaults hide a missing value; a failed document has no record to check."""
    return record_violations(state).withColumn("record_violations", F.when(
        _failed(), F.array().cast("array<string>")).otherwise(F.col("record_violations")))


def quarantined(state: DataFrame) -> DataFrame:
    """Rows of a checked state that must not become results, as they are, with the columns at fault."""
    kept = ("document_id", "source_filename", *_DECIDED, "extracted_fields", "validation_status", "validation_errors",
            "processing_duration_ms", "record_violations")
    return state.where(F.size("record_violations") > 0).select(*kept)


def payload(state: DataFrame) -> DataFrame:
    """Result records. A document with a pipeline error has no payload."""
    fields = F.coalesce(F.col("extracted_fields"), F.create_map().cast("map<string,string>"))
    return state.filter(~_failed()).select(
        _default("document_id", "").alias("document_id"),
        _default("source_filename", "").alias("source_filename"),
        _default("document_category", "unclassified").alias("document_category"),
        _default("classification_method", "unclassified").alias("classification_method"),
        _default("classification_confidence", 0.0).alias("classification_confidence"),
        _default("matched_keywords", []).alias("matched_keywords"),
        "llm_escalation_reason",
        _default("llm_unavailable", False).alias("llm_unavailable"),
        fields.alias("extracted_fields"),
        _default("validation_status", "valid").alias("validation_status"),
        _default("validation_errors", []).alias("validation_errors"),
        "processing_duration_ms")


def outcome(status: Column) -> Column:
    chain = F
    for value, name in OUTCOME_OF_STATUS.items():
        chain = chain.when(status == value, F.lit(name))
    return chain.otherwise(F.lit("passed"))


def audit_records(state: DataFrame) -> DataFrame:
    """One audit record per document, failures included."""
    return state.select(
        F.sha2(F.concat_ws("\x1f", F.lit("audit"), "run_id", "document_id"), 256).alias("audit_id"),
        "document_id",
        _default("source_filename", "unknown").alias("source_filename"),
        F.current_timestamp().alias("timestamp"),
        _default("classification_method", "unclassified").alias("extraction_method"),
        "llm_escalation_reason",
        _default("llm_unavailable", False).alias("llm_unavailable"),
        _default("document_category", "unclassified").alias("classification_result"),
        _default("classification_confidence", 0.0).alias("confidence_score"),
        outcome(F.col("validation_status")).alias("validation_outcome"),
        _default("validation_errors", []).alias("validation_errors"),
        _default("processing_duration_ms", 0, "bigint").alias("processing_duration_ms"),
        "parse_error")


def audit_from_results(results: DataFrame, processed_at: Column | None = None) -> DataFrame:
    """Audit records derived from stored results: their own timestamp, confidence at four decimals."""
    key = F.sha2(F.concat_ws("\x1f", F.lit("audit"), "document_id"), 256)
    stamp = processed_at if processed_at is not None else (
        F.col("processed_at") if "processed_at" in results.columns else F.current_timestamp())
    return results.select(
        key.alias("audit_id"), "document_id", "source_filename", stamp.alias("timestamp"),
        F.col("classification_method").alias("extraction_method"),
        "llm_escalation_reason", "llm_unavailable",
        F.col("document_category").alias("classification_result"),
        round_exact(F.col("classification_confidence")).alias("confidence_score"),
        outcome(F.col("validation_status")).alias("validation_outcome"),
        "validation_errors", "processing_duration_ms")
