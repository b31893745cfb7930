"""Small numeric expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column | str, digits: int) -> Column:
    """Round half up on the binary value.

    Engines break ties of ``round`` differently; a plain floor with a small
    guard gives the same digits everywhere. Values too large to have such
    digits, infinite ones and NaN stay as they are.
    """
    x = F.col(x) if isinstance(x, str) else x
    scale = float(10**digits)
    scaled = x * F.lit(scale)
    rounded = F.floor(scaled + F.lit(0.5) + F.lit(1e-6)).cast("double") / F.lit(scale)
    # NaN is larger than any number here.
    return F.when(F.abs(scaled) < F.lit(2.0**53), rounded).otherwise(x.cast("double"))


def clamp(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Limit ``x`` to [low, high]; null stays null (``greatest`` would skip it)."""
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


def nan_to_null(x: Column) -> Column:
    """Spark sorts NaN above everything and lets it win ``max``; null does neither."""
    return F.when(~F.isnan(x), x)
