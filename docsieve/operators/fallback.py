"""Model fallback for documents the keyword rules could not decide.

The prompt is a column expression. Inference is the second place where rows cross into Python: an
Arrow-batched iterator UDF that receives the prompt column only, NULL for every decided document.
"""

from __future__ import annotations

import inspect
import json
import sys
import time
from collections.abc import Callable, Iterator, Sequence
from functools import partial
from typing import Any, NamedTuple

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.rules import RuleSet

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Infer = Callable[[Sequence[str]], Sequence[str]]

# Prompt wording, text limit, retry settings and decimals are part of the contract.
SYSTEM_PROMPT = (
    "You are a document classifier for an enterprise document intelligence system. "
    "You will be given document text and must classify it into exactly one category. "
    "Respond with valid JSON only — no markdown, no explanation."
)
PROMPT_PARTS = (
    "Classify this document into exactly one of these categories: ",
    '\n\nRespond with JSON only: {"category": "<category_slug>", "confidence": <0.0-1.0>}'
    "\n\nEscalation context: ",
    "\nKeyword engine's best guess: ",
    " (confidence: ",
    ")\n\nDocument text:\n",
)
PROMPT_CHARS = 4000
MAX_RETRIES = 2
RETRY_DELAY_SECONDS = 1.0
CONFIDENCE_DECIMALS = 4


def prompt(text: Column, reason: Column, confidence: Column, rules: RuleSet,
           guess: Column | None = None, max_chars: int | None = PROMPT_CHARS) -> Column:
    """User prompt for one document; ``confidence`` is the score as text with four decimals.

    ``max_chars`` limits the text shown; None shows the whole text.
    """
    whole = F.coalesce(text, F.lit(""))
    slots = (
        F.lit(", ".join(sorted(rules.slugs))),
        F.coalesce(reason, F.lit("Unknown")),
        F.coalesce(guess if guess is not None else F.lit(None), F.lit("unclassified")),
        F.coalesce(confidence, F.lit("0.0000")),
        whole if max_chars is None else F.substring(whole, 1, max_chars),
    )
    return F.concat(*[x for part, slot in zip(PROMPT_PARTS, slots) for x in (F.lit(part), slot)])


def parse_reply(reply: str, slugs: frozenset[str]) -> tuple[str, float] | None:
    """Category and confidence of a strict JSON reply, or None for anything unusable."""
    try:
        data = json.loads(reply.strip())
        slug, score = data.get("category"), float(data.get("confidence"))
    except (ValueError, TypeError, AttributeError, OverflowError, RecursionError):
        return None
    if not isinstance(slug, str) or slug not in slugs:
        return None
    return slug, round(max(0.0, min(1.0, score)), CONFIDENCE_DECIMALS)


class Answer(NamedTuple):
    """What one prompt got: a usable category and confidence, or the reason why not."""

    category: str | None = None
    confidence: float | None = None
    failure: str | None = None
    reply: str | None = None


def addressed(infer: Infer, system: str = SYSTEM_PROMPT) -> Infer:
    """``infer`` with the system prompt, if it takes one as keyword ``system``."""
    try:
        takes = "system" in inspect.signature(infer).parameters
    except (TypeError, ValueError):  # a callable without a signature
        takes = False
    return partial(infer, system=system) if takes else infer


def ask_once(prompts: Sequence[str], infer: Infer, slugs: frozenset[str]) -> list[Answer]:
    """One call for all prompts. A model that fails is an expected outcome; its error is the reason given."""
    try:
        replies = list(infer(prompts))
    except Exception as exc:  # noqa: BLE001
        return [Answer(failure=f"{type(exc).__name__}: {exc}")] * len(prompts)
    answers = []
    for reply in (*replies[:len(prompts)], *[None] * (len(prompts) - len(replies))):
        known = parse_reply(reply, slugs) if isinstance(reply, str) else None
        text = reply if isinstance(reply, str) else None
        failure = "no reply" if text is None else "unusable reply" if known is None else None
        answers.append(Answer(*(known or (None, None)), failure, text))
    return answers


def infer_batch(prompts: Sequence[str], infer: Infer, slugs: frozenset[str], max_retries: int,
                delay: float) -> list[Answer]:
    """Ask for all prompts; ask again, with growing pauses, only for those still unanswered."""
    answers = [Answer()] * len(prompts)
    for attempt in range(max_retries + 1):
        waiting = [i for i, a in enumerate(answers) if a.category is None]
        if not waiting:
            break
        if attempt and delay:
            time.sleep(delay * 2 ** (attempt - 1))
        for i, answer in zip(waiting, ask_once([prompts[i] for i in waiting], infer, slugs)):
            answers[i] = answer
    return answers


def ask_model(prompts: Column, infer: Infer, rules: RuleSet, *, max_retries: int = MAX_RETRIES,
              delay: float = RETRY_DELAY_SECONDS, batch_size: int = 64) -> Column:
    """Struct of category, confidence and failure per prompt; all NULL without a prompt."""
    slugs, infer = frozenset(rules.slugs), addressed(infer)

    @F.pandas_udf("category string, confidence double, failure string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple[Any, ...]] = [(None, None, None)] * len(batch)
            asked = [i for i, p in enumerate(batch) if p is not None]
            for start in range(0, len(asked), batch_size):
                chunk = asked[start:start + batch_size]
                answers = infer_batch([batch.iloc[i] for i in chunk], infer, slugs, max_retries, delay)
                for i, answer in zip(chunk, answers):
                    out[i] = answer[:3]
            yield pd.DataFrame(out, columns=["category", "confidence", "failure"]).astype(
                {"category": object, "confidence": "float64", "failure": object})

    return run.asNondeterministic()(prompts)


def with_answers(df: DataFrame, reply: str) -> DataFrame:
    """The decision columns from a struct column of category, confidence and failure, which is consumed."""
    asked, hit = F.col("fallback_prompt").isNotNull(), F.col(f"{reply}.category").isNotNull()
    return df.withColumns({
        "document_category": F.when(hit, F.col(f"{reply}.category")).otherwise(F.col("document_category")),
        "classification_method": F.when(hit, F.lit("llm_fallback")).otherwise(F.col("classification_method")),
        "classification_confidence": F.when(hit, F.col(f"{reply}.confidence"))
        .otherwise(F.col("classification_confidence")),
        "llm_unavailable": F.when(asked, ~hit),
        "llm_failure": F.when(asked & ~hit, F.coalesce(f"{reply}.failure", F.lit("not asked"))),
    }).drop(reply, "fallback_prompt")


def apply_fallback(df: DataFrame, rules: RuleSet, infer: Infer | None, **settings: Any) -> DataFrame:
    """Resolve rows that carry a ``fallback_prompt``; the column is consumed.

    An answer replaces category, method and confidence and leaves reason and keywords in place. No
    answer, no model or no categories marks the document ``llm_unavailable``, and ``llm_failure`` says why.
    """
    if infer is None or not len(rules):
        # Asking the reason, not the prompt, lets the optimizer drop the prompt from the plan.
        escalated = F.col("llm_escalation_reason").isNotNull()
        why = "no model" if infer is None else "no categories"
        return df.withColumns({"llm_unavailable": F.when(escalated, F.lit(True)),
                               "llm_failure": F.when(escalated, F.lit(why))}).drop("fallback_prompt")
    return with_answers(
        df.withColumn("_reply", ask_model(F.col("fallback_prompt"), infer, rules, **settings)), "_reply")
