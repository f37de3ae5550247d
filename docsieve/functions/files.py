"""File names and content signatures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsieve.functions.binding import let

# Extension and MIME lists of the file gate.
BLOCKED_EXTENSIONS = (".exe", ".dll", ".bat", ".cmd", ".com", ".msi", ".scr", ".ps1", ".sh", ".vbs", ".js")
DOCUMENT_EXTENSIONS = (".pdf", ".docx", ".pptx", ".png", ".jpg", ".jpeg", ".tiff", ".tif")
SUPPORTED_MIME_TYPES = (
    "application/pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "application/zip",
    "image/png",
    "image/jpeg",
    "image/tiff",
)

# Published file signatures as LIKE patterns over upper-case hex, first match wins.
# "_" stands for one hex digit.
SIGNATURES = (
    ("41433130%", "image/vnd.dwg"),
    ("67696D702078636620%", "image/x-xcf"),
    ("FFD8FF%", "image/jpeg"),
    ("0000000C6A5020200D0A870A%", "image/jpx"),
    ("89504E470D0A1A0A%", "image/png"),
    ("47494638%", "image/gif"),
    ("52494646________57454250%", "image/webp"),
    ("49492A00________4352%", "image/x-canon-cr2"),
    ("4D4D002A________4352%", "image/x-canon-cr2"),
    ("49492A00%", "image/tiff"),
    ("4D4D002A%", "image/tiff"),
    ("424D%", "image/bmp"),
    ("4949BC%", "image/vnd.ms-photo"),
    ("38425053%", "image/vnd.adobe.photoshop"),
    ("00000100%", "image/x-icon"),
    ("________6674797068656963%", "image/heic"),
    ("________6674797061766966%", "image/avif"),
    ("________66747970336770%", "video/3gpp"),
    ("________667479704D3456%", "video/x-m4v"),
    ("________667479704D3441%", "audio/mp4"),
    ("________667479707174%", "video/quicktime"),
    ("________66747970%", "video/mp4"),
    ("1A45DFA3%", "video/x-matroska"),
    ("52494646________415649%", "video/x-msvideo"),
    ("3026B2758E66CF11A6D9%", "video/x-ms-wmv"),
    ("464C5601%", "video/x-flv"),
    ("000001B_%", "video/mpeg"),
    ("FFF1%", "audio/aac"),
    ("FFF9%", "audio/aac"),
    ("4D546864%", "audio/midi"),
    ("494433%", "audio/mpeg"),
    ("FFFB%", "audio/mpeg"),
    ("FFF3%", "audio/mpeg"),
    ("FFF2%", "audio/mpeg"),
    ("4F676753%", "audio/ogg"),
    ("664C6143%", "audio/x-flac"),
    ("52494646________57415645%", "audio/x-wav"),
    ("2321414D520A%", "audio/amr"),
    ("464F524D________41494646%", "audio/x-aiff"),
    ("774F4646%", "application/font-woff"),
    ("774F4632%", "application/font-woff"),
    ("0001000000%", "application/font-sfnt"),
    ("4F54544F00%", "application/font-sfnt"),
    ("D0CF11E0A1B11AE1%", "application/msword"),
    ("25504446%", "application/pdf"),
    ("EFBBBF25504446%", "application/pdf"),
    ("526172211A07%", "application/x-rar-compressed"),
    ("1F8B08%", "application/gzip"),
    ("425A68%", "application/x-bzip2"),
    ("377ABCAF271C%", "application/x-7z-compressed"),
    ("4D5A%", "application/x-msdownload"),
    ("435753%", "application/x-shockwave-flash"),
    ("465753%", "application/x-shockwave-flash"),
    ("7B5C727466%", "application/rtf"),
    ("4E45531A%", "application/x-nintendo-nes-rom"),
    ("43723234%", "application/x-google-chrome-extension"),
    ("4D534346%", "application/vnd.ms-cab-compressed"),
    ("2521%", "application/postscript"),
    ("FD377A585A00%", "application/x-xz"),
    ("53514C69%", "application/x-sqlite3"),
    ("213C617263683E0A64656269616E2D62696E617279%", "application/x-deb"),
    ("213C617263683E%", "application/x-unix-archive"),
    ("1FA0%", "application/x-compress"),
    ("1F9D%", "application/x-compress"),
    ("4C5A4950%", "application/x-lzip"),
    ("7F454C46%", "application/x-executable"),
    ("28B52FFD%", "application/zstd"),
    ("EDABEEDB%", "application/x-rpm"),
    ("0061736D%", "application/wasm"),
)

# In a ZIP container the folder of an entry names the office format. PK\3\4 starts an
# entry header; the entry name follows 26 bytes further on.
_ZIP = "504B0304%"
_ZIP_ENTRY = r"(?s)PK\x03\x04.{26}(word/|ppt/|xl/)"
_ZIP_OTHER = ("504B0506%", "504B0708%")
_OFFICE_FOLDERS = (
    ("word/", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    ("ppt/", "application/vnd.openxmlformats-officedocument.presentationml.presentation"),
    ("xl/", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
)
_TAR = "7573746172"  # at byte 257
_HEAD_BYTES = 300


def base_name(path: Column) -> Column:
    """Last path component; trailing slashes and single dots do not count."""
    return F.regexp_extract(F.regexp_replace(path, r"(/\.?)+$", ""), r"([^/]*)$", 1)


def file_extension(path: Column) -> Column:
    """Lower-cased final suffix with its dot, or '' for none (``.profile``, ``name.``)."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def _hex_head(content: Column, n_bytes: int) -> Column:
    return F.hex(F.substring(content, 1, n_bytes))


def mime_type(content: Column) -> Column:
    """MIME type from the leading bytes; NULL when no signature fits.

    A ZIP container is searched as a whole for the first entry in an office folder, wherever it stands.
    """
    return let(_hex_head(content, _HEAD_BYTES), lambda head: _mime_of(head, content))


def _mime_of(head: Column, content: Column) -> Column:
    # One character per byte, so that the distance to the entry name holds.
    folder = F.regexp_extract(F.decode(content, "ISO-8859-1"), _ZIP_ENTRY, 1)
    names = F.create_map(*[F.lit(x) for row in _OFFICE_FOLDERS for x in row])
    office = F.coalesce(F.try_element_at(names, folder), F.lit("application/zip"))
    chain = F.when(head.like(_ZIP), office)
    for pattern in _ZIP_OTHER:
        chain = chain.when(head.like(pattern), F.lit("application/zip"))
    for pattern, mime in SIGNATURES:
        chain = chain.when(head.like(pattern), F.lit(mime))
    return chain.when(F.substring(head, 2 * 257 + 1, 10) == _TAR, F.lit("application/x-tar"))


def is_watched(path: Column) -> Column:
    """Files an arrival stream picks up."""
    return file_extension(path).isin(*DOCUMENT_EXTENSIONS)


def watched_glob() -> str:
    """The same rule as a case-insensitive glob, so that other files are never listed or read."""
    def any_case(ext: str) -> str:
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)
    return "*{" + ",".join(any_case(e) for e in DOCUMENT_EXTENSIONS) + "}"
