"""Bytes to Markdown through a pluggable per-document parser.

This is one of two places where rows cross into Python. The parser runs as an Arrow-batched
iterator UDF that receives only the columns it reads; all other columns stay in the JVM.
"""

from __future__ import annotations

import io
import sys
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.operators.gate import gate
from docsieve.operators.metadata import file_metadata, internal_kind, office_properties

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Parsed:
    """What a parser returns. ``partial`` still counts as success; ``failure`` carries errors."""

    text: str | None = None
    status: str = "success"
    errors: list[str] = field(default_factory=list)


Parser = Callable[[str, bytes], Parsed]
PropertyReader = Callable[[str, bytes], dict[str, Any]]

PARSED_DDL = (
    "text string, error string, page_count int, author string, title string, producer string, "
    "creation_date string")

# XML names of word-processing and drawing text.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def _word_markdown(package: zipfile.ZipFile) -> str:
    def text_of(node: ElementTree.Element) -> str:
        return "".join(t.text or "" for t in node.iter(f"{_W}t"))

    blocks = []
    body = ElementTree.fromstring(package.read("word/document.xml")).find(f"{_W}body")
    for node in body if body is not None else ():
        if node.tag == f"{_W}p" and text_of(node):
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            level = int(name[7:]) if name.startswith("Heading") and name[7:].isdigit() else 0
            blocks.append("#" * level + " " * bool(level) + text_of(node))
        elif node.tag == f"{_W}tbl":
            rows = [[text_of(c) for c in r.iter(f"{_W}tc")] for r in node.iter(f"{_W}tr")]
            lines = ["| " + " | ".join(r) + " |" for r in rows]
            if lines:
                lines.insert(1, "|" + "---|" * len(rows[0]))
            blocks.append("\n".join(lines))
    return "\n\n".join(blocks)


def _slides_markdown(package: zipfile.ZipFile) -> str:
    names = [n for n in package.namelist() if n.startswith("ppt/slides/slide") and n.endswith(".xml")]
    blocks = []
    for name in sorted(names, key=lambda n: (len(n), n)):
        for paragraph in ElementTree.fromstring(package.read(name)).iter(f"{_A}p"):
            text = "".join(t.text or "" for t in paragraph.iter(f"{_A}t"))
            if text:
                blocks.append(text)
    return "\n\n".join(blocks)


def default_parser(filename: str, content: bytes) -> Parsed:
    """Office packages by their XML, anything else that is valid UTF-8 as text."""
    if content[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(content)) as package:
            names = package.namelist()
            if "word/document.xml" in names:
                return Parsed(_word_markdown(package))
            if any(n.startswith("ppt/slides/") for n in names):
                return Parsed(_slides_markdown(package))
        return Parsed(status="failure", errors=["archive holds no document"])
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        text = None
    if text is None or "\x00" in text or text.startswith("%PDF"):
        return Parsed(status="failure", errors=[f"no parser for this content ({filename})"])
    return Parsed(text)


def parse_one(filename: str, content: bytes, kind: str | None, parser: Parser,
              properties: PropertyReader) -> dict[str, Any]:
    row: dict[str, Any] = dict.fromkeys(
        ("text", "error", "page_count", "author", "title", "producer", "creation_date"))
    if kind is not None:
        try:
            found = dict(properties(kind, content))
            pages = found.get("page_count")
            row.update(found | {"page_count": None if pages is None else int(np.int32(pages))})
        except Exception:  # noqa: BLE001 - a failing reader leaves the properties empty
            pass
    try:
        result = parser(filename, content)
        if result.status in ("success", "partial"):
            row["text"] = result.text
        else:
            row["error"] = "Document conversion failed: " + (
                "; ".join(result.errors) or "Unknown conversion error")
    except Exception as exc:  # noqa: BLE001 - one bad document must not fail the job
        row["error"] = f"Unexpected parse error: {exc}"
    return row


def parse_documents(df: DataFrame, parser: Parser | None = None, *,
                    parser_factory: Callable[[], Parser] | None = None,
                    properties: PropertyReader = office_properties) -> DataFrame:
    """Gate, describe and parse ``(source_filename, content)`` rows.

    Adds ``parsed_markdown``, ``parse_error`` and ``document_metadata`` and drops ``content``.
    ``parser_factory`` builds an expensive parser once per task instead of shipping it. The size of
    a batch sent to Python is bounded by ``spark.sql.execution.arrow.maxBytesPerBatch``.
    """
    build = parser_factory or (lambda: parser or default_parser)

    @F.pandas_udf(PARSED_DDL)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        convert = build()
        for names, contents, kinds in batches:
            yield pd.DataFrame(
                [parse_one(n, bytes(c), k, convert, properties) if c is not None else {}
                 for n, c, k in zip(names, contents, kinds)],
                columns=["text", "error", "page_count", "author", "title", "producer", "creation_date"],
            ).astype({"page_count": "Int32"}).astype(object).where(lambda d: d.notna(), None)

    modified = F.col("modificationTime") if "modificationTime" in df.columns else None
    name, content = F.col("source_filename"), F.col("content")
    gated = gate(df).withColumn("_file", F.when(content.isNotNull(), file_metadata(name, content, modified)))
    parsed = gated.withColumn("_parsed", run.asNondeterministic()(
        name, content, internal_kind(F.col("_file.file_extension"), F.col("_file.mime_type"))))
    inner = ("page_count", "author", "title", "producer", "creation_date")
    return (
        parsed
        .withColumn("parsed_markdown", F.col("_parsed.text"))
        .withColumn("parse_error", F.coalesce(F.col("parse_error"), F.col("_parsed.error")))
        .withColumn("document_metadata", F.when(F.col("_file").isNotNull(), F.struct(
            "_file.*", *[F.col(f"_parsed.{c}").alias(c) for c in inner])))
        .drop("content", "_file", "_parsed"))
