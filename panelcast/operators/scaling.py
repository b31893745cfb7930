"""Min-max scaling to [0, 1] with constants at 0, and its inverse."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.sqltext import number, quoted, with_sql

Range = tuple[float, float]


class Stats(NamedTuple):
    low: float
    high: float
    mean: float


def column_stats(
    df: DataFrame, columns: list[str], null_as: float | None = None
) -> dict[str, Stats]:
    """Min, max and mean per column from one aggregate row; all-null columns left out."""
    def value(c: str) -> str:
        x = f"cast({quoted(c)} as double)"
        return x if null_as is None else f"coalesce({x}, {number(null_as)})"

    if not columns:
        return {}
    row = df.selectExpr(
        *[f"struct(min({value(c)}), max({value(c)}), avg({value(c)})) as s{i}" for i, c in enumerate(columns)]
    ).first()
    return {c: Stats(*row[i]) for i, c in enumerate(columns) if row[i][0] is not None}


def fit_ranges(df: DataFrame, columns: list[str], null_as: float | None = 0.0) -> dict[str, Range]:
    """(min, max) per column; nulls count as ``null_as``."""
    return {c: (s.low, s.high) for c, s in column_stats(df, columns, null_as).items()}


def apply_ranges(
    df: DataFrame, ranges: dict[str, Range], null_as: float | None = 0.0
) -> DataFrame:
    """Columns to [0, 1]; a constant column maps to 0."""
    have, out = set(df.columns), {}
    for c, (low, high) in ranges.items():
        if c in have:
            x = f"cast({quoted(c)} as double)"
            x = x if null_as is None else f"coalesce({x}, {number(null_as)})"
            out[c] = f"({x} - {number(low)}) / {number((high - low) or 1.0)}"
    return with_sql(df, out)


def inverse(x: Column, low: float, high: float) -> Column:
    """Back to the original unit; unclipped."""
    return x * F.lit((high - low) or 1.0) + F.lit(low)
