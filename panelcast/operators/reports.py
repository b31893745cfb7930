"""Aggregations behind the report tables and KPIs.

Reports that the caller may show as one nested list come as ordered rows that
carry the envelope values, so that no list of unknown length ends up in a row.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.risk import (
    ALERT_THRESHOLD,
    EPIDEMIC_THRESHOLD,
    class_order,
    risk_class,
)
from panelcast.operators.quantiles import exact_quantiles
from panelcast.spec import PanelSpec, present

# Columns of the correlation report; bounds and labels of phases.
CORRELATION_COLUMNS = (
    "outbreak_risk_index", "rainfall_mm", "temp_avg_c", "humidity_pct",
    "cases", "incidence_rate_100k", "population_density_km2", "poverty_index",
)
PHASES = (("La Nina", -3.0, -0.5), ("Neutral", -0.5, 0.5), ("El Nino", 0.5, 3.0))


def overview(latest: DataFrame, spec: PanelSpec = PanelSpec(), risk: str = "risk") -> DataFrame:
    """KPI row: entities, epidemic and alert counts, mean risk, highest entity."""
    highest = F.max_by(spec.entity, F.struct(F.col(risk), F.col(spec.entity)))
    return latest.agg(
        F.count(F.lit(1)).alias("total_entities"),
        F.count_if(F.col(risk) >= EPIDEMIC_THRESHOLD).alias("epidemic_count"),
        F.count_if(F.col(risk) >= ALERT_THRESHOLD).alias("alert_count"),
        F.avg(risk).alias("average_risk"),
        highest.alias("highest_risk_entity"),
    )


def with_envelope(items: DataFrame, envelope: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame to every row."""
    row = envelope.select(F.struct(*envelope.columns).alias("e")).scalar()
    return items.withColumn("_e", row).select(
        *items.columns, *[F.col(f"_e.{c}").alias(c) for c in envelope.columns]
    )


def risk_bands(latest: DataFrame, level: str = "risk_level", count: str = "province_count") -> DataFrame:
    """Entities per class in class order, unknown classes last."""
    return (
        latest.groupBy(level)
        .agg(F.count(F.lit(1)).alias(count))
        .orderBy(class_order(F.col(level)), level)
    )


def seasonal_profile(df: DataFrame, value: str, date: str = "date") -> DataFrame:
    """Mean and sample deviation across years of the monthly totals.

    A month missing in a year that occurs counts as 0. The observed cells give
    their mean and deviation, and the absent ones are merged in as so many
    zeros, so no grid is built and nothing large cancels.
    """
    cells = df.groupBy(F.year(date).alias("y"), F.month(date).alias("month")).agg(
        F.sum(value).cast("double").alias("total")
    )
    years = cells.agg(F.countDistinct("y").cast("double").alias("n")).scalar()
    seen = cells.groupBy("month").agg(
        F.count(F.lit(1)).cast("double").alias("m"), F.avg("total").alias("avg"), F.var_pop("total").alias("var")
    ).withColumn("n", years)
    share = F.col("m") / F.col("n")
    mean = F.col("avg") * share
    spread = F.col("var") * F.col("m") + F.col("avg") * F.col("avg") * (F.col("n") - F.col("m")) * share
    std = F.coalesce(F.sqrt(F.try_divide(spread, F.col("n") - 1)), F.lit(0.0))
    return seen.select(
        "month",
        mean.alias("mean"),
        std.alias("std"),
        (mean - std).alias("band_low"),
        (mean + std).alias("band_high"),
    )


def month_heatmap(
    df: DataFrame, value: str, spec: PanelSpec = PanelSpec(), top: int = 12
) -> DataFrame:
    """Mean per entity and month, 0 where missing; the ``top`` entities by row total."""
    months = [str(m) for m in range(1, 13)]
    wide = df.groupBy(spec.entity).agg(
        *[
            F.coalesce(
                F.avg(F.when(F.month(spec.date) == int(m), F.col(value))), F.lit(0.0)
            ).alias(f"m{m}")
            for m in months
        ]
    )
    total = sum((F.col(f"m{m}") for m in months[1:]), F.col("m1"))
    return wide.withColumn("total", total).orderBy(F.desc("total"), spec.entity).limit(top)


def national_series(df: DataFrame, values: list[str], date: str = "date") -> DataFrame:
    return df.groupBy(date).agg(*[F.avg(v).alias(f"{v}_mean") for v in values]).orderBy(date)


def entity_stats(df: DataFrame, value: str, spec: PanelSpec = PanelSpec()) -> DataFrame:
    return df.groupBy(spec.entity).agg(
        F.avg(value).alias("mean"), F.max(value).alias("max"), F.stddev_samp(value).alias("std")
    )


def period_profile(df: DataFrame, period: str, value: str) -> DataFrame:
    return df.groupBy(period).agg(F.avg(value).alias("mean"))


def conclusions(df: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Closing figures: riskiest entity and week by mean, share at or above 65, counts."""
    risk = F.col(spec.target)
    by_entity = df.groupBy(spec.entity).agg(
        F.avg(risk).alias("m"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(risk >= EPIDEMIC_THRESHOLD).alias("high"),
    )
    top_entity = by_entity.agg(
        F.max_by(spec.entity, F.struct("m", spec.entity)).alias("top_entity"),
        F.max("m").alias("top_entity_mean"),
        F.count(F.lit(1)).alias("entities"),
        F.sum("n").alias("rows"),
        (F.sum("high") * 100.0 / F.sum("n")).alias("pct_epidemic"),
    )
    by_week = period_profile(df, spec.week, spec.target)
    top_week = by_week.agg(
        F.max_by(spec.week, F.struct(F.col("mean"), F.col(spec.week))).alias("peak_week"),
        F.max("mean").alias("peak_week_mean"),
    )
    return with_envelope(top_entity, top_week)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max per column."""
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = wide.unpivot([], columns, "column", "v")
    basic = long.groupBy("column").agg(
        F.count("v").alias("count"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("value")))
    wide_q = quartiles.groupBy("column").agg(
        at(0.25).alias("q25"), at(0.5).alias("q50"), at(0.75).alias("q75")
    )
    return basic.join(wide_q, "column", "left")


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Counts of equal-width bins between min and max; the last bin is closed."""
    x = F.col(column).cast("double")
    ends = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("e")).scalar()
    span = F.col("_e.hi") - F.col("_e.lo")
    place = F.coalesce(F.try_divide(x - F.col("_e.lo"), span), F.lit(0.0)) * F.lit(bins)
    return (
        df.where(x.isNotNull())
        .withColumn("_e", ends)
        .groupBy(F.least(F.floor(place), F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def correlation_matrix(df: DataFrame, columns=CORRELATION_COLUMNS) -> DataFrame:
    """(column_a, column_b, r) of the full matrix, over rows complete in both; null for a constant column.

    A first pass gives means and null counts, a second the sums of products around those means: one sum for each
    pair, and only pairs with a column that has nulls need sums of their own over their complete rows.
    """
    names = present(df, columns)
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    first = wide.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.avg(c).alias(f"m_{c}") for c in names], *[F.count(c).alias(f"n_{c}") for c in names]
    ).first()
    mean = {c: first[f"m_{c}"] or 0.0 for c in names}
    holes = {c for c in names if first[f"n_{c}"] < first["_rows"]}
    off = {c: F.col(c) - F.lit(mean[c]) for c in names}
    sums = {}
    for a, b in combinations_with_replacement(names, 2):
        sums[f"{a}|{b}"] = F.sum(off[a] * off[b])
        if a != b and (a in holes or b in holes):
            for c, other in ((a, b), (b, a)):
                kept = F.when(F.col(other).isNotNull(), off[c])
                sums |= {f"{a}|{b}|{c}": F.sum(kept), f"{a}|{b}|{c}|{c}": F.sum(kept * kept)}
            sums[f"{a}|{b}|n"] = F.count(F.when(F.col(a).isNotNull(), F.col(b)))
    one = wide.agg(*[v.alias(k) for k, v in sums.items()])

    def r(a: str, b: str) -> Column:
        cell = lambda k: F.col(f"`{k}`")
        both, aa, bb, n = cell(f"{a}|{b}"), cell(f"{a}|{a}"), cell(f"{b}|{b}"), F.lit(float(first["_rows"]))
        if a != b and (a in holes or b in holes):
            n = cell(f"{a}|{b}|n").cast("double")
            sa, sb = cell(f"{a}|{b}|{a}"), cell(f"{a}|{b}|{b}")
            both = both - F.try_divide(sa * sb, n)
            aa = cell(f"{a}|{b}|{a}|{a}") - F.try_divide(sa * sa, n)
            bb = cell(f"{a}|{b}|{b}|{b}") - F.try_divide(sb * sb, n)
        # What rounding alone leaves of a constant column is no spread.
        some = (aa > n * F.lit(1e-24 * (1 + mean[a] ** 2))) & (bb > n * F.lit(1e-24 * (1 + mean[b] ** 2)))
        return F.when(some, both / (F.sqrt(aa) * F.sqrt(bb)))

    cells = [
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), r(x, y).alias("r"))
        for x, y in combinations_with_replacement(names, 2)
        for a, b in dict.fromkeys([(x, y), (y, x)])
    ]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def correlation_rank(df: DataFrame, target: str, columns=CORRELATION_COLUMNS) -> DataFrame:
    """Correlation of every other column with ``target``, strongest first."""
    return (
        correlation_matrix(df, columns)
        .where((F.col("column_a") == target) & (F.col("column_b") != target))
        .select(F.col("column_b").alias("column"), "r")
        .orderBy(F.desc(F.abs("r")), "column")
    )


def line_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of y on x, nulls as 0."""
    xv = F.coalesce(F.col(x).cast("double"), F.lit(0.0))
    yv = F.coalesce(F.col(y).cast("double"), F.lit(0.0))
    return df.agg(
        F.regr_slope(yv, xv).alias("slope"),
        F.regr_intercept(yv, xv).alias("intercept"),
        F.min(x).alias("x_min"),
        F.max(x).alias("x_max"),
    )


def phase(x: Column, phases=PHASES) -> Column:
    """Right-closed intervals; null outside all of them."""
    out = F.lit(None).cast("string")
    for label, low, high in phases:
        out = F.when((x > F.lit(low)) & (x <= F.lit(high)), F.lit(label)).otherwise(out)
    return out


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, whiskers at 1.5 IQR pulled in to the data, and outlier counts."""
    known = df.where(F.col(group).isNotNull()).select(group, value)
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("value")))
    found = (
        exact_quantiles(known, [value], [0.25, 0.5, 0.75], [group])
        .groupBy(group)
        .agg(at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"))
    )
    # Groups are few, as the quantiles ask: their row each goes to all tasks, not the panel to a few keys.
    quart = F.broadcast(df.sparkSession.createDataFrame(found.collect(), found.schema))
    fence = (F.col("q3") - F.col("q1")) * 1.5
    low, high = F.col("q1") - fence, F.col("q3") + fence
    inside = F.col(value).between(low, high)
    return (
        known.join(quart, group)
        .groupBy(group, "q1", "median", "q3")
        .agg(
            F.count(value).alias("n"),
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def top_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(k)


def threshold_alerts(latest: DataFrame, risk: str, threshold: float = EPIDEMIC_THRESHOLD) -> DataFrame:
    return latest.where(F.col(risk) >= F.lit(threshold))


def with_class(df: DataFrame, risk: str, name: str = "risk_level") -> DataFrame:
    return df.withColumn(name, risk_class(F.col(risk)))
