"""Document metadata: what the file system and the leading bytes tell, and office properties."""

from __future__ import annotations

import io
import sys
import zipfile
from datetime import datetime
from typing import Any
from xml.etree import ElementTree

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from docsieve.functions.files import file_extension, mime_type

# Helpers that run in tasks travel with the plan, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# XML names of the package properties part.
_CORE = "{http://schemas.openxmlformats.org/package/2006/metadata/core-properties}"
_DC = "{http://purl.org/dc/elements/1.1/}"
_TERMS = "{http://purl.org/dc/terms/}"


def internal_kind(extension: Column, mime: Column) -> Column:
    """Which property reader applies: pdf by extension or type, docx and pptx by extension."""
    return (
        F.when((extension == ".pdf") | F.coalesce(mime.contains("pdf"), F.lit(False)), F.lit("pdf"))
        .when(extension == ".docx", F.lit("docx"))
        .when(extension == ".pptx", F.lit("pptx")))


def file_metadata(filename: Column, content: Column, modified: Column | None = None) -> Column:
    """Size, extension, MIME type and times as a struct. Spark sources expose no creation time."""
    ext, mime = file_extension(filename), mime_type(content)
    return F.struct(
        F.coalesce(F.length(content), F.lit(0)).cast("bigint").alias("file_size_bytes"),
        F.coalesce(ext, F.lit("")).alias("file_extension"),
        mime.alias("mime_type"),
        F.lit(None).cast("timestamp").alias("created_at"),
        (modified if modified is not None else F.lit(None)).cast("timestamp").alias("modified_at"))


def office_properties(kind: str, content: bytes) -> dict[str, Any]:
    """Author, title, producer, creation date and slide count of an OOXML file.

    Called per document inside a task. A damaged file yields no properties, never an error.
    """
    found: dict[str, Any] = {}
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as package:
            names = package.namelist()
            if "docProps/core.xml" in names:
                core = ElementTree.fromstring(package.read("docProps/core.xml"))
                found["author"] = core.findtext(f"{_DC}creator") or None
                found["title"] = core.findtext(f"{_DC}title") or None
                found["producer"] = core.findtext(f"{_CORE}lastModifiedBy") or None
                created = core.findtext(f"{_TERMS}created")
                if created:
                    found["creation_date"] = datetime.fromisoformat(created).isoformat()
            if kind == "pptx":
                found["page_count"] = sum(
                    n.startswith("ppt/slides/slide") and n.endswith(".xml") for n in names)
    except Exception:  # noqa: BLE001 - properties are optional whatever the damage
        pass
    return found
