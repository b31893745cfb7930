"""Chronological splits and expanding-window folds on distinct periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.ranking import running_total
from panelcast.spec import PanelSpec


def _sizes(n: Column, test_size: float, val_size: float) -> tuple[Column, Column]:
    """(length of train, length of train and val) out of ``n``."""
    test_n, val_n = F.floor(n * F.lit(test_size)), F.floor(n * F.lit(val_size))
    return (n - test_n - val_n).cast("int"), (n - test_n).cast("int")


def cutoffs(df: DataFrame, date: str, test_size: float = 0.15, val_size: float = 0.15) -> DataFrame:
    """One row: the first date of val and of test among the distinct dates.

    The calendar bounds the number of distinct dates that are listed.
    """
    dates = df.select(date).distinct().agg(F.sort_array(F.collect_list(date)).alias("d"))
    val_from, test_from = _sizes(F.size("d"), test_size, val_size)
    return dates.select(F.get("d", val_from).alias("val_start"), F.get("d", test_from).alias("test_start"))


def time_split(
    df: DataFrame,
    spec: PanelSpec = PanelSpec(),
    test_size: float = 0.15,
    val_size: float = 0.15,
    mode: str = "time",
) -> DataFrame:
    """Add ``split``: train, val or test.

    ``time`` cuts the distinct periods, so no later week trains a model that is
    judged on an earlier one. ``row`` cuts the rows in (entity, date) order,
    which separates entities instead.
    """
    if mode == "row":
        placed = _row_position(df, spec)
        val_from, test_from = _sizes(F.col("_size"), test_size, val_size)
        x = F.col("_i")
    else:
        cut = cutoffs(df, spec.date, test_size, val_size).select(F.struct("*")).scalar()
        placed = df.withColumn("_cut", cut)
        x, val_from, test_from = F.col(spec.date), F.col("_cut.val_start"), F.col("_cut.test_start")
    label = F.when(x >= test_from, "test").when(x >= val_from, "val").otherwise("train")
    return placed.withColumn("split", label).select(*df.columns, "split")


def _row_position(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Add ``_i``, the 0-based position in (entity, date) order, and ``_size``.

    The sizes of the entities are summed along ranges of entities; no task orders them all.
    """
    sizes = df.groupBy(spec.entity).agg(F.count(F.lit(1)).alias("_n"))
    starts = running_total(sizes, [spec.entity], F.col("_n"), "_upto").select(
        spec.entity, (F.col("_upto") - F.col("_n")).alias("_start"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        df.withColumn("_rn", F.row_number().over(spec.window(df)))
        .join(starts, spec.entity)
        .withColumn("_i", F.col("_start") + F.col("_rn") - 1)
        .withColumn("_size", total)
    )


def expanding_folds(df: DataFrame, spec: PanelSpec = PanelSpec(), folds: int = 5) -> DataFrame:
    """(fold, test_start, test_end): train on everything before ``test_start``.

    Test windows are ``periods // (folds + 1)`` long and end with the last period.
    """
    dates = df.select(spec.date).distinct().agg(
        F.sort_array(F.collect_list(spec.date)).alias("d")
    )
    size = F.floor(F.size("d") / F.lit(folds + 1))
    start = F.size("d") - (F.lit(folds) - F.col("fold") + 1) * size
    return (
        dates.select("d", F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold"))
        .select(
            "fold",
            F.element_at("d", (start + 1).cast("int")).alias("test_start"),
            F.element_at("d", (start + size).cast("int")).alias("test_end"),
        )
    )


def fold_sizes(df: DataFrame, spec: PanelSpec = PanelSpec(), folds: int = 5) -> DataFrame:
    """Train and test rows of each fold, from counts per period."""
    per_date = df.groupBy(spec.date).agg(F.count(F.lit(1)).alias("n"))
    bounds = expanding_folds(df, spec, folds)
    spread = bounds.agg(F.collect_list(F.struct("fold", "test_start", "test_end"))).scalar()
    d = F.col(spec.date)
    return (
        per_date.withColumn("f", F.explode(spread))
        .where(d <= F.col("f.test_end"))
        .groupBy("f.fold", "f.test_start", "f.test_end")
        .agg(
            F.sum(F.when(d < F.col("f.test_start"), F.col("n")).otherwise(0)).alias("train_rows"),
            F.sum(F.when(d >= F.col("f.test_start"), F.col("n")).otherwise(0)).alias("test_rows"),
        )
    )
