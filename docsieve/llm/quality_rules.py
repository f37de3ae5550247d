"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger holds the measurements and one failure bit per rule;
a policy is a set of bits with a version, so another policy, or the effect of leaving a rule out, is a
bitwise operation on the ledger and never a second pass over the text.

Defined cases: a null text has no words and fails as too short; an empty table gives an empty ledger;
repeated rows are measured each; other columns are left out of the ledger.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_long_words")
LONG_WORD = 60


@dataclass(frozen=True)
class Rule:
    """``fails`` is an SQL condition on the measurements; the bit is the rule's place in RULES."""

    name: str
    fails: str


RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    Rule("word_length", "word_chars > 15 * n_words"),
    Rule("unbroken_strings", "20 * n_long_words > n_words"),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}
BASE = BIT["too_few_words"] | BIT["repeated_windows"]
#: Versions of the policy: the bits that reject a document.
POLICIES = {1: BASE, 2: BASE | BIT["symbols"] | BIT["duplicate_lines"],
            3: sum(BIT.values())}
CURRENT = 3


def repeated_words(words: list[str]) -> int:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[str, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    pair = w[:-2] * len(ids) + w[1:-1]
    if len(ids) > 1_000_000:  # keeps the product below 2**63
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    key = pair * len(ids) + w[2:]
    _, where, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = count[where] > 1
    if not hit.any():
        return 0
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= hit
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words), len(lines),
            sum(len(w) > LONG_WORD and len(w.decode("utf-8", "replace")) > LONG_WORD for w in words))


_MEASURED = "__measured__"


@F.pandas_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def _measure(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=list(MEASURES), dtype="int64")


#: One call per row: as a nondeterministic column it is neither copied nor moved by the optimizer.
_measure = _measure.asNondeterministic()


def _failed(measured: str) -> Column:
    mask = F.lit(0).cast("long")
    for rule in RULES:
        condition = rule.fails
        for m in MEASURES:
            condition = re.sub(rf"\b{m}\b", f"{measured}.{m}", condition)
        mask = mask.bitwiseOR(F.when(F.expr(condition), F.lit(BIT[rule.name])).otherwise(F.lit(0)).cast("long"))
    return mask


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and failed_rules (long): the bit of each rule that the text fails."""
    return docs.select("doc_id", _measure("text").alias(_MEASURED)).select(
        "doc_id", f"{_MEASURED}.*", _failed(_MEASURED).alias("failed_rules"))


def passes(failed_rules: Column, policy: int = CURRENT) -> Column:
    return failed_rules.bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(book: DataFrame, policy: int = CURRENT) -> DataFrame:
    """Per rule of the policy: documents it fails, fails alone, and kept if it were left out.

    One aggregation over the ledger with map-side combining; one row per rule.
    """
    bits, all_bits = F.col("failed_rules"), POLICIES[policy]
    used = [r for r in RULES if BIT[r.name] & all_bits]
    n = F.count("*").alias("n_docs")
    sums = [F.count_if(bits.bitwiseAND(F.lit(BIT[r.name])) != 0).alias(f"fails_{r.name}") for r in used]
    alone = [F.count_if(bits.bitwiseAND(F.lit(all_bits)) == BIT[r.name]).alias(f"alone_{r.name}") for r in used]
    kept = F.count_if(bits.bitwiseAND(F.lit(all_bits)) == 0).alias("kept")
    row = F.array(*[F.struct(
        F.lit(r.name).alias("rule"), F.col("n_docs"), F.col(f"fails_{r.name}").alias("n_failed"),
        F.col(f"alone_{r.name}").alias("n_failed_alone"),
        (F.col("kept") + F.col(f"alone_{r.name}")).alias("n_kept_without")) for r in used])
    return book.agg(n, kept, *sums, *alone).select(F.inline(row))


def verdicts(docs: DataFrame, policy: int = CURRENT) -> DataFrame:
    book = ledger(docs)
    base = ~passes(F.col("failed_rules"), 1)
    return book.select(
        "doc_id", *MEASURES[:5], base.alias("base_failed"), passes(F.col("failed_rules"), policy).alias("kept"),
        "failed_rules", F.lit(policy).alias("policy_version"))


def accepted(docs: DataFrame, policy: int = CURRENT) -> DataFrame:
    """The documents that the policy keeps, with their columns; only the text goes through Python."""
    return docs.withColumn(_MEASURED, _measure("text")).where(
        passes(_failed(_MEASURED), policy)).select(*[F.col(f"`{c}`") for c in docs.columns])
