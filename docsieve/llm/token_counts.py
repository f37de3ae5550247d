"""Token counts of documents in flat token files: no index, only end-of-document identifiers between them.

A file is a run of little-endian token ids, 2 or 4 bytes each. Files are cut into blocks, whatever their documents;
each task reads one block's bytes and finds its separators with one vectorised comparison. A block's summary (its
separators and where the last one is) is stitched to the others by a prefix scan in two levels, so a file of any size
takes no task longer than its neighbours: scans run within groups of blocks and over the groups.

Defined cases: an empty document between two separators counts 0 tokens; tokens after the last separator are a document
without end (``ended`` false), none if there are no tokens; an empty file has no documents; a trailing part of a token
is an error. Packing: a null text is an empty document, and an identifier equal to the separator can't arise
from text, since the tokenizer's vocabulary does not hold it.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsieve.session import stage, staging_path

BLOCK_BYTES = 8 << 20
GROUP = 512
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's tokenizer cuts text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
EOD = 50256


def _filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if ":" in path else (pyarrow.fs.LocalFileSystem(), path)


def load_tokenizer(vocabulary: str = VOCABULARY):
    import tiktoken
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Pack:
    """Tokenize and write one file per task attempt; the rows it returns name the file."""

    def __init__(self, folder: str, vocabulary: str, eod: int, bytes_per_token: int) -> None:
        self.folder, self.vocabulary, self.eod, self.width = folder, vocabulary, eod, bytes_per_token

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _filesystem(self.folder)
        name, out, at = f"tokens-{uuid.uuid4().hex}.bin", None, 0
        encoding = load_tokenizer(self.vocabulary)
        try:
            for batch in batches:
                if out is None:
                    out = files.open_output_stream(f"{root}/{name}")
                for text in batch["text"]:
                    ids = encoding.encode_ordinary(text or "")
                    ids.append(self.eod)
                    out.write(np.array(ids, f"<u{self.width}").tobytes())
                yield pd.DataFrame({"doc_id": batch["doc_id"], "file": name,
                                    "ordinal": np.arange(at, at + len(batch))})
                at += len(batch)
        finally:
            if out is not None:
                out.close()


def pack(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, eod: int = EOD,
         bytes_per_token: int = 2) -> DataFrame:
    """Write ``docs`` (doc_id, text) as flat token files; doc_id, file, ordinal per document, written once.

    An attempt that fails leaves a file that no row names.
    """
    files, root = _filesystem(folder)
    files.create_dir(root, recursive=True)
    return stage(docs.select("doc_id", "text").mapInPandas(
        _Pack(folder, vocabulary, eod, bytes_per_token), "doc_id bigint, file string, ordinal bigint"), "packed")


class _Scan:
    def __init__(self, folder: str, eod: int, bytes_per_token: int, block_bytes: int) -> None:
        self.folder, self.eod, self.width, self.block = folder, eod, bytes_per_token, block_bytes

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _filesystem(self.folder)
        for batch in batches:
            rows = []
            for file, block in zip(batch["file"], batch["block"]):
                with files.open_input_file(f"{root}/{file}") as data:
                    data.seek(int(block) * self.block)
                    tokens = np.frombuffer(data.read(self.block), f"<u{self.width}")
                found = np.flatnonzero(tokens == self.eod)
                first = int(block) * (self.block // self.width)
                rows.append((file, block, len(tokens), len(found), first + int(found[-1]) + 1 if len(found) else -1,
                             (found + first).astype(np.int64)))
            yield pd.DataFrame(rows, columns=["file", "block", "n_tokens", "n_ends", "after_last", "ends"])


def token_files(spark: SparkSession, folder: str, names: DataFrame | None = None) -> DataFrame:
    """file, bytes of the token files in ``folder``, those in ``names`` (file) if given."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))
    return listed if names is None else listed.join(names, "file", "left_semi")


def count_tokens(spark: SparkSession, folder: str, files: DataFrame, eod: int = EOD, bytes_per_token: int = 2,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, ordinal, start, n_tokens, ended: the documents of each of ``files`` (file, bytes)."""
    if block_bytes % bytes_per_token:
        raise ValueError("a block must hold whole tokens")
    whole = F.assert_true(F.col("bytes") % bytes_per_token == 0, F.lit("a token file ends inside a token"))
    blocks = files.where("bytes > 0").withColumn("ok", whole).select("file", F.explode(F.sequence(
        F.lit(0), F.floor((F.col("bytes") - 1) / block_bytes))).alias("block"), "ok").drop("ok")
    scanned = stage(blocks.repartition("file", "block").mapInPandas(
        _Scan(folder, eod, bytes_per_token, block_bytes),
        "file string, block bigint, n_tokens bigint, n_ends bigint, after_last bigint, ends array<bigint>"), "scanned")
    # Prefix scan over the summaries: within groups of blocks, and over the groups.
    brief = scanned.select("file", "block", F.floor(F.col("block") / GROUP).alias("group"), "n_tokens", "n_ends",
                           "after_last")
    inside = W.partitionBy("file", "group").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    over = W.partitionBy("file").orderBy("group").rowsBetween(W.unboundedPreceding, -1)
    groups = brief.groupBy("file", "group").agg(F.sum("n_ends").alias("n"), F.max("after_last").alias("last")).select(
        "file", "group", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("n_before"),
        F.coalesce(F.max("last").over(over), F.lit(-1)).alias("last_before"))
    carried = brief.join(groups, ["file", "group"]).select(
        "file", "block",
        (F.col("n_before") + F.coalesce(F.sum("n_ends").over(inside), F.lit(0))).alias("ordinal"),
        F.greatest("last_before", F.coalesce(F.max("after_last").over(inside), F.lit(-1)), F.lit(0)).alias("open_at"))
    documents = scanned.where("n_ends > 0").join(carried, ["file", "block"]).select(
        "file", "ordinal", "open_at", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("open_at")).otherwise(F.get("ends", F.col("i") - 1) + 1)
    ended = documents.select("file", (F.col("ordinal") + F.col("i")).alias("ordinal"), start.alias("start"), "end")
    ended = ended.select("file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"),
                         F.lit(True).alias("ended"))
    tails = scanned.groupBy("file").agg(
        F.sum("n_tokens").alias("all"), F.sum("n_ends").alias("ordinal"),
        F.greatest(F.max("after_last"), F.lit(0)).alias("start")).where("start < all").select(
        "file", "ordinal", "start", (F.col("all") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(tails)


def document_token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, start per document: packed into flat files, counted from these alone."""
    spark = docs.sparkSession
    folder = staging_path(spark, "tokens")
    packed = pack(docs, folder, vocabulary)
    counted = count_tokens(spark, folder, token_files(spark, folder, packed.select("file").distinct()),
                           block_bytes=block_bytes)
    return packed.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens", "start")
