"""Windows over an entity that may hold a large part of all rows.

A plain window puts an entity in one task. Where the key does not bound an
entity's rows (raw events, fine-grained readings), rows are numbered per
(entity, time chunk), cut into blocks of equal length, and each block borrows
the few rows before and after it that its frames reach. Every row keeps exactly
the neighbours it has in the undivided series.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Blocks:
    """How to cut: ``chunk`` is a time bucket, ``rows`` the length of a block."""

    chunk: Column
    rows: int = 100_000


def number_rows(df: DataFrame, entity: str, order: list[str], chunk: Column) -> DataFrame:
    """0-based ``_pos`` of each row within its entity, without an entity-wide sort."""
    chunked = df.withColumn("_chunk", chunk)
    sizes = chunked.groupBy(entity, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(entity).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        entity, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    within = Window.partitionBy(entity, "_chunk").orderBy(*order)
    return (
        chunked.withColumn("_rn", F.row_number().over(within))
        .join(starts, [entity, "_chunk"])
        .withColumn("_pos", F.col("_start") + F.col("_rn") - 1)
        .drop("_chunk", "_rn", "_start")
    )


def with_halo(numbered: DataFrame, rows: int, back: int, ahead: int) -> DataFrame:
    """Add ``_block`` and copies (``_halo``) of the rows that neighbours reach."""
    block = F.floor(F.col("_pos") / rows)
    offset = F.col("_pos") % rows
    homes = F.array_compact(
        F.array(
            F.struct(block.alias("b"), F.lit(False).alias("h")),
            F.when(
                offset >= rows - back,
                F.struct((block + 1).alias("b"), F.lit(True).alias("h")),
            ),
            F.when(
                (offset < ahead) & (block > 0),
                F.struct((block - 1).alias("b"), F.lit(True).alias("h")),
            ),
        )
    )
    return (
        numbered.withColumn("_home", F.explode(homes))
        .withColumn("_block", F.col("_home.b"))
        .withColumn("_halo", F.col("_home.h"))
        .drop("_home")
    )


def apply_in_blocks(
    df: DataFrame,
    entity: str,
    order: list[str],
    build: Callable[[WindowSpec], dict[str, Column]],
    blocks: Blocks,
    back: int = 0,
    ahead: int = 0,
) -> DataFrame:
    """Window columns whose frames reach ``back`` rows back and ``ahead`` rows on."""
    if max(back, ahead) >= blocks.rows:
        raise ValueError("a block must be longer than the frames")
    cut = with_halo(number_rows(df, entity, order, blocks.chunk), blocks.rows, back, ahead)
    window = Window.partitionBy(entity, "_block").orderBy("_pos")
    return (
        cut.select("*", *[c.alias(n) for n, c in build(window).items()])
        .where(~F.col("_halo"))
        .drop("_pos", "_block", "_halo")
    )
