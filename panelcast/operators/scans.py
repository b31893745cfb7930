"""Fills and running totals over series of any length.

A window from the first row on puts an entity in one task. Here a series is cut into blocks of equal length; each
block is scanned on its own and hands on what it carries, its last known values and its sums; the carries, one row a
block, are scanned along the entity, and every row adds what was carried up to its block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.blocks import Blocks, number_rows


def carry_scan(
    df: DataFrame, entity: str, order: list[str], blocks: Blocks,
    fills: dict[str, Column] | None = None, totals: dict[str, Column] | None = None,
) -> DataFrame:
    """``df`` with, for each row, the last value that was not null so far (``fills``) and the sum so far (``totals``)
    of an expression, by name of the new column. ``order`` has to tell the rows of an entity apart. Before the first
    value a fill is null and a total, too."""
    fills, totals = fills or {}, totals or {}
    made = {f"_v_{n}": c for n, c in (fills | totals).items()}
    rows = number_rows(df, entity, order, blocks.chunk).withColumns(made).withColumn(
        "_block", F.floor(F.col("_pos") / blocks.rows))
    upto = Window.partitionBy(entity, "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    local = {n: F.last(f"_v_{n}", ignorenulls=True).over(upto) for n in fills} | {n: F.sum(f"_v_{n}").over(upto) for n in totals}
    carried = rows.groupBy(entity, "_block").agg(
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col("_pos"))).alias(f"_c_{n}") for n in fills],
        *[F.sum(f"_v_{n}").alias(f"_c_{n}") for n in totals])
    before = Window.partitionBy(entity).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select(
        entity, "_block", *[F.last(f"_c_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in fills],
        *[F.sum(f"_c_{n}").over(before).alias(f"_c_{n}") for n in totals])
    both = rows.withColumns(local).join(carried, [entity, "_block"])
    return both.withColumns(
        {n: F.coalesce(n, f"_c_{n}") for n in fills}
        | {n: F.coalesce(F.col(n) + F.col(f"_c_{n}"), F.col(n), F.col(f"_c_{n}")) for n in totals}
    ).drop("_pos", "_block", *made, *[f"_c_{n}" for n in fills | totals])
