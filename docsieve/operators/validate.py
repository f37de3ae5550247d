"""Mandatory-field validation and record checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions.binding import constant, let
from docsieve.functions.regex import py_strip
from docsieve.rules import RuleSet


def missing_fields(category: Column, fields: Column, rules: RuleSet) -> Column:
    """Mandatory fields of the category without a usable value, in dictionary order."""
    mandatory = constant({c.slug: c.mandatory for c in rules}, "map<string,array<string>>")
    required = F.coalesce(F.try_element_at(mandatory, category), F.array().cast("array<string>"))
    return let(fields, lambda found: F.filter(
        required, lambda f: F.coalesce(py_strip(F.try_element_at(found, f)), F.lit("")) == ""))


def validate(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Add ``validation_status`` and ``validation_errors``.

    An upstream error is invalid; an unclassified document, an unknown category and a category
    without mandatory fields are valid; otherwise a missing field makes the document partial.
    """
    category = F.coalesce(F.col("document_category"), F.lit("unclassified"))
    errors = F.transform(
        missing_fields(category, F.col("extracted_fields"), rules),
        lambda f: F.concat(F.lit("Missing mandatory field: '"), f, F.lit("'")))
    none = F.array().cast("array<string>")

    def outcome(status: str, messages: Column) -> Column:
        return F.struct(F.lit(status).alias("validation_status"), messages.alias("validation_errors"))

    failed = F.coalesce(F.col("pipeline_error"), F.lit("")) != ""
    result = (
        F.when(failed, outcome("invalid", F.array("pipeline_error")))
        .when(category == "unclassified", outcome("valid", none))
        .otherwise(let(errors, lambda e: F.when(F.size(e) > 0, outcome("partial", e))
                       .otherwise(outcome("valid", none)))))
    return df.withColumn("_validation", result).select("*", "_validation.*").drop("_validation")


# The closed value sets of the record types.
METHODS = ("deterministic", "llm_fallback", "unclassified")
STATUSES = ("valid", "invalid", "partial")
OUTCOMES = ("passed", "failed", "partial")

_DOMAINS = {
    "classification_method": METHODS,
    "extraction_method": METHODS,
    "validation_status": STATUSES,
    "validation_outcome": OUTCOMES,
}
_UNIT_INTERVAL = ("classification_confidence", "confidence_score", "confidence")
_REQUIRED = ("document_id", "source_filename", "document_category", "classification_result",
             "predicted_category", "reviewer_correct_category")


def checked_columns(df: DataFrame) -> list[str]:
    """The columns that ``record_violations`` looks at."""
    return [c for c in df.columns if c in _DOMAINS or c in _UNIT_INTERVAL or c in _REQUIRED]


def record_violations(df: DataFrame) -> DataFrame:
    """Add an array naming every column whose value lies outside its domain; rows are kept."""
    checks = []
    for name in df.columns:
        value = F.col(name)
        if name in _DOMAINS:
            checks.append(F.when(~F.coalesce(value.isin(*_DOMAINS[name]), F.lit(False)), F.lit(name)))
        elif name in _UNIT_INTERVAL:
            checks.append(F.when(~F.coalesce(value.between(0.0, 1.0), F.lit(False)), F.lit(name)))
        elif name in _REQUIRED:
            checks.append(F.when(value.isNull(), F.lit(name)))
    found = F.array_compact(F.array(*checks)) if checks else F.array()
    return df.withColumn("record_violations", found.cast("array<string>"))
