"""Document sources: directories, uploads held in a DataFrame, already parsed text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions.files import base_name


def _described(files: DataFrame) -> DataFrame:
    return files.select(
        base_name(F.col("path")).alias("source_filename"),
        F.col("path").alias("source_path"),
        "modificationTime",
        "content")


def read_files(spark: SparkSession, directory: str, *, recursive: bool = False,
               glob: str | None = None) -> DataFrame:
    """Every file of a directory with its bytes. ``glob`` prunes at listing time, before any read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return _described(reader.load(directory))


def from_uploads(df: DataFrame, filename: str = "source_filename", content: str = "content") -> DataFrame:
    """Any table that holds file bytes; a missing name becomes ``upload``."""
    return df.withColumns({
        "source_filename": F.coalesce(F.col(filename), F.lit("upload")),
        "content": F.col(content)})


def from_text(df: DataFrame, text: str = "text", filename: Column | str | None = None,
              document_id: Column | str | None = None) -> DataFrame:
    """Any table that already holds text: nothing is gated or parsed. The main path at scale."""
    columns = {
        "parsed_markdown": F.col(text),
        "source_filename": F.lit("unknown") if filename is None
        else F.col(filename) if isinstance(filename, str) else filename}
    if document_id is not None:
        key = F.col(document_id) if isinstance(document_id, str) else document_id
        columns["document_id"] = key.cast("string")
    return df.withColumns(columns)
