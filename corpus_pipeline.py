"""A corpus pipeline of five stages over ``documents``; each stage is written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsieve.llm import exact_dedup, jaccard_join, mixing, quality_rules, sentencepiece_lattice
from docsieve.llm.queries import PIECE_MODEL
from docsieve.session import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the rule ledger rejects go."""
    return quality_rules.accepted(docs)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exact_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the smallest doc_id stays."""
    return jaccard_join.keep_representatives(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and its SentencePiece ids, one row per row of the mix."""
    coded = sentencepiece_lattice.encode(docs, sentencepiece_lattice.load_pieces(PIECE_MODEL))
    return coded.select("doc_id", "ids")


STAGES = [("quality rules", quality), ("exact dedup", copies), ("n-gram Jaccard join", near_copies),
          ("mixing sources to target weights", mixture), ("SentencePiece encoding and decoding", tokens)]

#: The mix rounds at random by hashes, which SQL does not express; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage_function in STAGES:
        docs = stage(stage_function(spark, docs, sf_dir), name.split()[0].lower())
    return docs
