"""Registered queries of the operations, each over its whole table, and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import (
    chat_format, exact_dedup, html_extract, jaccard_join, license_scan, mixing, prefix_trie, quality_rules,
    sentencepiece_lattice, spelling_variants, statements, substring_dedup, token_counts, toxicity)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf, "pages"))


def op2_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.duplicates(_table(spark, sf, "documents"))


def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.document_token_counts(_table(spark, sf, "documents")).select("doc_id", "n_tokens")


def op4_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.report(_table(spark, sf, "documents"))


def op5_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    pieces = sentencepiece_lattice.load_pieces(PIECE_MODEL)
    coded = sentencepiece_lattice.encode(_table(spark, sf, "documents"), pieces)
    back = coded.withColumn("back", sentencepiece_lattice.decode(F.col("ids"), pieces))
    marks = F.replace(F.coalesce("text", F.lit("")), F.lit(sentencepiece_lattice.SPACE), F.lit(" "))
    return back.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), (F.col("back") == marks).alias(
        "restored"))


def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_table(spark, sf, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.verdicts(_table(spark, sf, "documents"))


def op8_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.similar_groups(_table(spark, sf, "documents"))


def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op9_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    turns = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], turns.schema)
    return chat_format.formatted_conversations(turns.unionByName(extra))


def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    turns, members = prefix_trie.with_shared_openings(prefix_trie.ordered_turns(_table(spark, sf, "conversations")))
    return prefix_trie.prefix_trie(turns, members)


def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_variants.spelling_variants(spelling_variants.word_counts(_table(spark, sf, "documents"), damage=97))


def op13_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf, "documents"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_mixing": op6_mixing,
    "op7_quality_rules": op7_quality_rules,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_chat_format": op9_chat_format,
    "op10_toxicity": op10_toxicity,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_license_scan": op13_license_scan,
}

_WORD = r"[^\x20\x09-\x0D]+"

ORACLES = {
    "op2_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                            'abcdefghijklmnopqrstuvwxyz') AS k FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(k) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY k)""",
    "op7_quality_rules": rf"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text,
                          regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
        lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
                  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
                  WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
        places AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS key
                   FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM t)),
        often AS (SELECT doc_id, i FROM (
                  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, key) AS n FROM places) WHERE n > 1),
        covered AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words
                    FROM often, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
        m AS (SELECT t.doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
                     len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
                     coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
                     coalesce(n_repeat_words, 0) AS n_repeat_words,
                     len(list_filter(w, lambda x: len(x) > 60)) AS n_long
              FROM t LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
        bits AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
                 + 4 * (10 * n_symbols > n_words)::BIGINT
                 + 8 * (n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines)::BIGINT
                 + 16 * (word_chars > 15 * n_words)::BIGINT
                 + 32 * (20 * n_long > n_words)::BIGINT AS failed_rules FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               failed_rules & 3 <> 0 AS base_failed, failed_rules = 0 AS kept, failed_rules,
               3 AS policy_version FROM bits""",
    "op8_jaccard_join": rf"""
        WITH RECURSIVE t AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
              FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i
                    FROM t WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS (SELECT a.doc_id AS a, b.doc_id AS b
                  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
                  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
                  GROUP BY a.doc_id, b.doc_id, x.n, y.n
                  HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
        reach AS (SELECT doc_id, doc_id AS other FROM t
                  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
        SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, min(other) AS component_id
        FROM t LEFT JOIN n USING (doc_id) JOIN reach r ON r.doc_id = t.doc_id GROUP BY t.doc_id, n.n""",
    "op11_prefix_trie": statements.PREFIX_TRIE,
    "op12_spelling_variants": statements.SPELLING_VARIANTS,
    "op13_license_scan": statements.LICENSE_SCAN,
}
