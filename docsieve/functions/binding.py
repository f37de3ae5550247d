"""Binding a value inside an expression."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body`` as often as needed.

    A plain column reference would not do inside a lambda: merging projections may copy the
    expression behind it into the lambda, where it runs once per array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def constant(value: Any, ddl: str) -> Column:
    """A nested Python value as one foldable literal, whatever its size."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), ddl)


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add an expensive column that later filters and projections cannot copy.

    The optimizer replaces a column by its expression when it pushes a filter down, so a filter on a
    score would run the scoring twice. It does not look into a generator: this one yields exactly
    one row per input row, and everything above reads the finished value.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))
