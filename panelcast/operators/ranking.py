"""Ranks and running totals over a whole table that no single task has to sort."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.session import materialized


def running_total(df: DataFrame, order: list[Column | str], value: Column, into: str) -> DataFrame:
    """``df`` with the sum of ``value``, a bigint, over all rows up to each one in ``order`` as column ``into``.

    Rows are dealt by ranges of the order; a row's total is that of all ranges before its own plus the running total
    within its range. The ranges' totals, one number a range, are all that the driver sees. Rows that are equal in
    ``order`` land in one range, so an order that tells most rows apart splits evenly."""
    part, local, before = "_range", "_local", "_before"
    dealt = df.withColumn(local, value.cast("long")).repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    # Written once: a range keeps its rows whatever is computed again later.
    dealt = materialized(dealt, "ranges")
    totals = sorted(tuple(r) for r in dealt.groupBy(part).agg(F.coalesce(F.sum(local), F.lit(0))).collect())
    upto = accumulate((n for _, n in totals[:-1]), initial=0)
    # One row per range.
    offsets = df.sparkSession.createDataFrame(
        [(p, n) for (p, _), n in zip(totals, upto)], f"{part} int, {before} bigint")
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumn(local, F.sum(local).over(within)).join(F.broadcast(offsets), part)
    return summed.withColumn(into, F.col(before) + F.coalesce(local, F.lit(0))).drop(part, local, before)


def global_rank(df: DataFrame, order: list[Column | str], into: str = "rank") -> DataFrame:
    """``df`` with its row number (bigint, from 1 on) in ``order`` as column ``into``."""
    return running_total(df, order, F.lit(1), into)
