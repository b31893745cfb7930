"""De-duplication, clipping, winsorizing, dates, null profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.sqltext import quoted, with_sql
from panelcast.functions.temporal import week_to_date
from panelcast.operators.quantiles import exact_quantiles
from panelcast.spec import PanelSpec, numeric_columns, present

# What is winsorized, and where.
WINSOR_COLUMNS = ("cases", "rainfall_mm", "incidence_rate_100k")
WINSOR_LEVEL = 0.995


def dedup_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key, the first by ``order`` (total, so the choice is fixed).

    An aggregate, not a window: copies of a key collapse before the shuffle, so
    a key that holds a large part of the rows costs one row per map task.
    """
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return kept.selectExpr(*[quoted(c) if c in keys else f"_row.{quoted(c)} as {quoted(c)}" for c in df.columns])


def dedup_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, distinct keys, and rows a de-duplication removes."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").alias("rows_in"),
        F.count(F.lit(1)).alias("rows_kept"),
        (F.sum("n") - F.count(F.lit(1))).alias("rows_removed"),
    )


def clip_negative(
    df: DataFrame, columns: list[str] | None = None, exclude: tuple[str, ...] = ("enso_index",)
) -> DataFrame:
    """Negative numbers to 0. An index centred on 0 is excluded by default."""
    names = numeric_columns(df, exclude) if columns is None else present(df, columns)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return with_sql(df, {c: f"if({quoted(c)} < 0, cast(0 as {kinds[c]}), {quoted(c)})" for c in names})


def fit_caps(
    df: DataFrame, columns: tuple[str, ...] = WINSOR_COLUMNS, level: float = WINSOR_LEVEL
) -> dict[str, float]:
    """Upper caps, one number per column; part of the fitted state."""
    names = present(df, columns)
    rows = exact_quantiles(df, names, [level]).collect()
    return {r["column"]: r["value"] for r in rows if r["value"] is not None}


def apply_caps(df: DataFrame, caps: dict[str, float]) -> DataFrame:
    """Limit columns to fitted caps; null stays null."""
    return df.withColumns(
        {
            c: F.when(F.col(c) > F.lit(cap), F.lit(cap)).otherwise(F.col(c).cast("double"))
            for c, cap in caps.items()
            if c in df.columns
        }
    )


def ensure_date(df: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Add the Monday of (year, week) where the frame has no date."""
    if spec.date in df.columns:
        return df
    return df.withColumn(spec.date, week_to_date(F.col(spec.year), F.col(spec.week)))


def null_profile(df: DataFrame) -> DataFrame:
    """Share of nulls in percent per column, only where there are any."""
    shares = df.agg(
        *[(F.avg(F.col(c).isNull().cast("double")) * 100.0).alias(c) for c in df.columns]
    )
    long = shares.unpivot([], list(df.columns), "column", "null_pct")
    return long.where(F.col("null_pct") > 0).orderBy(F.desc("null_pct"), "column")
