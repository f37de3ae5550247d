"""The file gate: which files may be parsed at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions.binding import let
from docsieve.functions.files import (
    BLOCKED_EXTENSIONS, DOCUMENT_EXTENSIONS, SUPPORTED_MIME_TYPES, file_extension, mime_type)


def gate_error(filename: Column, content: Column) -> Column:
    """Reason for rejection, or NULL. Block list, then allow list, then content signature."""
    ext = file_extension(filename)

    def sniffed(mime: Column) -> Column:
        return (
            F.when(mime.isNull(), F.concat(
                F.lit("File rejected: unknown extension '"), ext,
                F.lit("' and content type could not be determined")))
            .when(mime.isin(*SUPPORTED_MIME_TYPES), F.lit(None))
            .otherwise(F.concat(
                F.lit("File rejected: unsupported content type '"), mime,
                F.lit("' (extension: '"), ext, F.lit("')"))))

    return (
        F.when(content.isNull() | (F.length(content) == 0), F.concat(
            F.lit("No file bytes provided for '"), filename, F.lit("'")))
        .when(ext.isin(*BLOCKED_EXTENSIONS), F.concat(
            F.lit("File rejected: dangerous extension '"), ext, F.lit("' is not allowed")))
        .when(ext.isin(*DOCUMENT_EXTENSIONS), F.lit(None))
        .otherwise(let(mime_type(content), sniffed)))


def gate(df: DataFrame, filename: str = "source_filename", content: str = "content") -> DataFrame:
    """Add ``parse_error``; rejected rows lose their content so it travels no further."""
    gated = df.withColumn("parse_error", gate_error(F.col(filename), F.col(content)))
    return gated.withColumn(content, F.when(F.col("parse_error").isNull(), F.col(content)))
