"""Names of the columns that make a DataFrame a panel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class PanelSpec:
    """One row per (entity, period); the key is unique.

    Because the key is unique, an entity holds at most one row per period: a
    window partition is bounded by the calendar (53 rows a year for weeks),
    whatever the size of the data. Frames without that bound, such as raw
    events, go through ``operators.blocks`` instead.
    """

    entity: str = "province"
    date: str = "date"
    year: str = "year"
    week: str = "week"
    target: str = "outbreak_risk_index"

    @property
    def key(self) -> list[str]:
        return [self.entity, self.year, self.week]

    def order(self, df: DataFrame) -> list[str]:
        return [self.date] if self.date in df.columns else [self.year, self.week]

    def window(self, df: DataFrame) -> WindowSpec:
        return Window.partitionBy(self.entity).orderBy(*self.order(df))


def numeric_columns(df: DataFrame, exclude: list[str] | tuple[str, ...] = ()) -> list[str]:
    """Names of the numeric columns, in schema order, without ``exclude``."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def present(df: DataFrame, columns: list[str] | tuple[str, ...]) -> list[str]:
    """Those of ``columns`` that ``df`` has, in the order given."""
    have = set(df.columns)
    return [c for c in columns if c in have]


def align_schema(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly ``columns`` in that order: missing ones as 0.0, extra ones dropped."""
    have = set(df.columns)
    return df.select(
        *[F.col(c) if c in have else F.lit(0.0).alias(c) for c in columns]
    )
