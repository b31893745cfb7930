"""Exact interpolated quantiles by radix selection.

The built-in exact ``percentile`` merges every distinct value into one buffer. Here a double becomes a whole number of
64 bits in the same order. One pass counts the values by its 16 leading bits, the next passes those that share the
leading bits of a wanted rank by the 16 bits behind, so that at most four passes find any order statistic of any
data, ties and heavy tails included. Counts are pre-aggregated in the map tasks; one task sees at most 65,536 counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BITS = 16
PASSES = 64 // BITS


def ordered_key(v: Column) -> Column:
    """A double as a bigint in the same order: exponent and fraction as IEEE 754 places them, with the sign of
    the number; both zeros are 0. NaN has none."""
    size = F.abs(v)
    # A rounded logarithm may miss the exponent by one; powers of two are exact.
    guess = F.floor(F.log2(size))
    exponent = guess + F.when(F.pow(F.lit(2.0), guess) > size, -1).when(F.pow(F.lit(2.0), guess + 1) <= size, 1).otherwise(0)
    fraction = (size * F.pow(F.lit(2.0), -exponent) - 1) * float(2**52)
    normal = (exponent + 1023) * F.lit(2**52) + fraction.cast("long")
    tiny = (size * float(2.0**537) * float(2.0**537)).cast("long")
    key = (
        F.when(size == 0, F.lit(0).cast("long")).when(size < 2.0**-1022, tiny)
        .when(size == float("inf"), F.lit(2047 * 2**52)).otherwise(normal)
    )
    return F.when(v < 0, -key).otherwise(key)


@dataclass(frozen=True)
class Wanted:
    """An order statistic: its group and column, its place among the values that share ``prefix``."""

    by: tuple
    rank: int  # among all values of the group and column
    within: int  # among those with the prefix
    prefix: int
    low: float  # the least and the greatest value with the prefix
    high: float


def _long(df: DataFrame, columns: list[str], group: list[str]) -> DataFrame:
    wide = df.select(*group, *[F.col(c).cast("double").alias(c) for c in columns])
    long = wide.unpivot(group, columns, "column", "v")
    return long.where(F.col("v").isNotNull() & ~F.isnan("v")).withColumn("v", F.col("v") + 0.0)


def _counted(keyed: DataFrame, by: list[str], level: int) -> DataFrame:
    """The number, least and greatest value of each prefix of ``level``, and how many values of the group come
    up to it. ``by`` ends with the prefix before, if there is one."""
    prefix = F.shiftright("key", 64 - BITS * (level + 1)).alias("next")
    counts = keyed.groupBy(*by, prefix).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("next"))
    return counts.withColumn("before", upto - F.col("n"))


def _first_pass(keyed: DataFrame, by: list[str], probs: list[float]) -> dict[tuple, tuple[int, list[Wanted]]]:
    """The number of values of each group and column, and the ranks that ``probs`` ask for with their prefixes."""
    total = F.sum("n").over(Window.partitionBy(*by))
    place = F.col("prob") * (F.col("total") - 1)
    rows = (
        _counted(keyed, by, 0).withColumn("total", total)
        .withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))))
        .where("rank >= before and rank < before + n").collect()
    )
    out = {}
    for r in rows:
        key = tuple(r[c] for c in by)
        out.setdefault(key, (r["total"], {}))[1][r["rank"]] = Wanted(
            key, r["rank"], r["rank"] - r["before"], r["next"], r["low"], r["high"])
    return {key: (n, list(ranks.values())) for key, (n, ranks) in out.items()}


def _next_pass(spark: SparkSession, keyed: DataFrame, by: list[str], open_: list[Wanted], level: int) -> list[Wanted]:
    """The same order statistics with prefixes that are longer by BITS."""
    kinds = ", ".join(f"`{c}` {keyed.schema[c].dataType.simpleString()}" for c in by)
    prefixes = sorted({(*w.by, w.prefix) for w in open_}, key=str)
    # One row per wanted rank at most.
    asked = F.broadcast(spark.createDataFrame(prefixes, f"{kinds}, prefix bigint"))
    inside = keyed.withColumn("prefix", F.shiftright("key", 64 - BITS * level)).join(asked, [*by, "prefix"])
    wanted = F.broadcast(spark.createDataFrame(
        [(*w.by, w.prefix, w.rank, w.within) for w in open_], f"{kinds}, prefix bigint, rank bigint, within bigint"))
    found = _counted(inside, [*by, "prefix"], level).join(wanted, [*by, "prefix"]).where(
        "within >= before and within < before + n").collect()
    return [Wanted(tuple(r[c] for c in by), r["rank"], r["within"] - r["before"], r["next"], r["low"], r["high"])
            for r in found]


def exact_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], group: list[str] | None = None
) -> DataFrame:
    """(group.., column, prob, value): linear interpolation between order statistics.

    Groups are few (phases, not entities): a row per group, column and prob is held by the driver. Infinite values
    count, NaN and nulls don't. A group that is null is left out, and so is a column without values."""
    spark, group = df.sparkSession, list(group or [])
    long = _long(df, columns, group)
    by = [*group, "column"]
    for c in group:
        long = long.where(F.col(c).isNotNull())
    keyed = long.withColumn("key", ordered_key(F.col("v")))
    first = _first_pass(keyed, by, probs)
    every = [w for _, ranks in first.values() for w in ranks]
    values = {}
    for level in range(1, PASSES + 1):
        # All values with one prefix are equal, at the latest when the prefix is the whole key.
        values |= {(w.by, w.rank): w.low for w in every if w.low == w.high}
        every = [w for w in every if w.low != w.high]
        if not every:
            break
        every = _next_pass(spark, keyed, by, every, level)
    rows = []
    for key, (n, _) in first.items():
        for p in probs:
            place = float(p) * (n - 1)
            low, high = values[key, math.floor(place)], values[key, math.ceil(place)]
            rows.append((*key, float(p), low if low == high else low + (high - low) * (place - math.floor(place))))
    kinds = "".join(f"`{c}` {keyed.schema[c].dataType.simpleString()}, " for c in by)
    return spark.createDataFrame(rows, f"{kinds}prob double, value double")
