"""Flagging and masking personal data by configurable patterns."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions.binding import computed_once, constant, let
from docsieve.functions.regex import java_search, python_count, python_replace
from docsieve.rules import BUNDLED


@dataclass(frozen=True)
class PrivacyRule:
    label: str
    pattern: str
    #: What must hold for a match to count as a span: "luhn", "iban" or nothing.
    check: str | None = None

    @property
    def mask(self) -> str:
        return f"[{self.label}]"


def load_privacy_rules(path: str | Path = BUNDLED / "privacy.yaml") -> tuple[PrivacyRule, ...]:
    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    rules = tuple(PrivacyRule(r["label"], r["pattern"], r.get("check")) for r in raw["rules"])
    unknown = {r.check for r in rules} - {None, *_CHECKS}
    if unknown:
        raise ValueError(f"unknown checks {sorted(unknown)}")
    return rules


def luhn_valid(value: Column) -> Column:
    """Whether the digits of a match pass the check sum of payment cards."""
    def total(digits: Column) -> Column:
        def worth(i: Column) -> Column:  # the i-th digit from the right
            d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
            return F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, F.lit(9)).otherwise(F.lit(0)))

        return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + worth(i))

    return let(F.regexp_replace(value, "[^0-9]", ""), lambda digits: total(digits) % 10 == 0)


def iban_valid(value: Column) -> Column:
    """Whether an account number of letters and digits leaves 1 by ISO 7064 MOD 97-10."""
    def step(rest: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), rest * 10 + F.ascii(c) - 48).otherwise(rest * 100 + F.ascii(c) - 55) % 97

    moved = F.concat(F.substring(value, 5, 2**30), F.substring(value, 1, 4))
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1


_CHECKS = {"luhn": luhn_valid, "iban": iban_valid}


def _regex(rule: PrivacyRule) -> str | None:
    # Privacy patterns state their own case: an upper-case initial is what marks a name.
    return java_search(rule.pattern, ignore_case=False)


def _count(text: Column, rule: PrivacyRule) -> Column:
    java = _regex(rule)
    return python_count(text, rule.pattern) if java is None else F.regexp_count(text, F.lit(java))


def _found(text: Column, rule: PrivacyRule) -> Column:
    java = _regex(rule)
    return python_count(text, rule.pattern) > 0 if java is None else text.rlike(java)


def privacy_counts(text: Column, rules: tuple[PrivacyRule, ...]) -> Column:
    """Occurrences per label as a struct, one field per rule."""
    return F.struct(*[_count(text, r).alias(r.label.lower()) for r in rules])


def flags_of_counts(counts: Column, rules: tuple[PrivacyRule, ...]) -> Column:
    """Labels whose count is above zero, in rule order, without another look at the text."""
    return F.array_compact(F.array(*[F.when(counts[r.label.lower()] > 0, F.lit(r.label)) for r in rules]))


def privacy_flags(text: Column, rules: tuple[PrivacyRule, ...]) -> Column:
    """Labels that occur in the text, in rule order."""
    return F.array_compact(F.array(*[F.when(_found(text, r), F.lit(r.label)) for r in rules]))


def redacted(text: Column, rules: tuple[PrivacyRule, ...]) -> Column:
    """The text with every match replaced by its label, rule by rule over the whole text."""
    for rule in rules:
        literal = rule.mask.replace("\\", "\\\\").replace("$", "\\$")  # neither is syntax in a label
        java = _regex(rule)
        text = python_replace(text, rule.pattern, rule.mask) if java is None else F.regexp_replace(text, java, literal)
    return text


def flag_privacy(df: DataFrame, rules: tuple[PrivacyRule, ...] | None = None, text: str = "text") -> DataFrame:
    return df.withColumn("privacy_flags", privacy_flags(F.col(text), rules or load_privacy_rules()))


# Characters for private use: the mark around matches, and what stands for it if the text has it already.
_MARK, _STAND_IN = "\ue000", "\ue001"
_SPAN = "array<struct<start:int,stop:int,rule:int>>"


def _spans(clean: Column, rule: PrivacyRule, number: int) -> Column:
    """Where a rule matches a text that is free of the mark, and its check holds."""
    java = _regex(rule)
    if java is None:
        raise ValueError(f"spans need a pattern that Java runs: {rule.label}")
    parts = F.split(F.regexp_replace(clean, java, f"{_MARK}$0{_MARK}"), _MARK)
    begin = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.expr(f"cast(array() as {_SPAN})").alias("spans"))

    def step(state: Column, part: Column) -> Column:
        end = state["at"] + F.length(part)
        span = F.struct(state["at"].alias("start"), end.alias("stop"), F.lit(number).alias("rule"))
        proven = state["inside"] & (part != "")
        if rule.check:
            proven = proven & F.when(proven, _CHECKS[rule.check](part))
        return F.struct(end.alias("at"), (~state["inside"]).alias("inside"), F.when(
            proven, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    # Most texts have no match of a rule; they are searched once and go no further.
    return let(parts, lambda p: F.when(F.size(p) > 1, F.aggregate(p, begin, step)["spans"]).otherwise(
        F.expr(f"cast(array() as {_SPAN})")))


def privacy_spans(text: Column, rules: tuple[PrivacyRule, ...]) -> Column:
    """Disjoint spans (start, stop, rule) of personal data in order of place.

    Every rule is matched against the original text, so no rule sees another's mask. Overlapping spans are one, from
    the first start to the last stop, under the rule that comes first.
    """
    clean = F.replace(F.coalesce(text, F.lit("")), F.lit(_MARK), F.lit(_STAND_IN))  # once, and not for each rule
    found = let(clean, lambda c: F.array_sort(F.concat(*[_spans(c, r, i) for i, r in enumerate(rules)])))

    def add(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"),
                          F.least(last["rule"], s["rule"]).alias("rule"))
        return F.when((F.size(done) > 0) & (s["start"] < last["stop"]), F.concat(
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(
            F.concat(done, F.array(s)))

    return F.aggregate(found, F.expr(f"cast(array() as {_SPAN})"), add)


def masked(text: Column, spans: Column, rules: tuple[PrivacyRule, ...]) -> Column:
    """The text with each span replaced by its rule's label."""
    masks = constant([r.mask for r in rules], "array<string>")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    state = F.aggregate(spans, begin, lambda a, s: F.struct(s["stop"].alias("at"), F.concat(
        a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.get(masks, s["rule"])).alias("out")))
    return F.when(F.size(spans) == 0, text).otherwise(let(state, lambda a: F.concat(
        a["out"], F.substring(text, a["at"] + 1, F.length(text)))))


def mask_privacy(df: DataFrame, rules: tuple[PrivacyRule, ...] | None = None, text: str = "text") -> DataFrame:
    """Add ``privacy_spans`` and mask them in the text. A null text has no spans and stays null."""
    rules = rules or load_privacy_rules(BUNDLED / "privacy_proven.yaml")
    found = computed_once(df, "privacy_spans", privacy_spans(F.col(text), rules))
    return found.withColumn(text, masked(F.col(text), F.col("privacy_spans"), rules))
