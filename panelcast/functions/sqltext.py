"""Expressions over many columns as SQL text: one call to the engine for a projection, not dozens a column."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def number(x: float) -> str:
    """A double literal."""
    x = float(x)
    return f"{x!r}D" if math.isfinite(x) else f"double('{x}')"


def with_sql(df: DataFrame, made: dict[str, str]) -> DataFrame:
    """``df`` with columns given as SQL text: those it has in their places, others behind."""
    kept = df.columns
    have = set(kept)
    every = [f"{made[c]} as {quoted(c)}" if c in made else quoted(c) for c in kept]
    return df.selectExpr(*every, *[f"{text} as {quoted(c)}" for c, text in made.items() if c not in have])
