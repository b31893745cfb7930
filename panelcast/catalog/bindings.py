"""Panel sources derived from the star-schema tables.

Entity = nation, period = ISO week, date = Monday of the week. Line items stand
for climate readings, orders for case reports, customers for the population,
and the monthly mean order price for the global climate index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.numeric import half_up
from panelcast.functions.risk import incidence
from panelcast.functions.temporal import iso_week, iso_year, week_start
from panelcast.operators.assemble import assemble_panel, derive_demographics
from panelcast.session import materialized
from panelcast.spec import PanelSpec

SPEC = PanelSpec()


def stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of part files: as a pattern, the path fits both."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def with_week(df: DataFrame, date: str = "date") -> DataFrame:
    """ISO year and week of the Monday that stands for the period."""
    return df.withColumns({"year": iso_year(F.col(date)), "week": iso_week(F.col(date))})


def order_nations(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the nation key of their customer."""
    orders = table(spark, sf, "orders")
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))


def named(df: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    """Nation name for a nation key, after aggregation."""
    nation = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("province")
    )
    return df.join(nation, "c_nationkey").drop("c_nationkey")


def climate_weeks(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem")
    orders = order_nations(spark, sf).select("o_orderkey", "c_nationkey")
    day = F.col("l_shipdate").cast("date")
    weekly = (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("c_nationkey", week_start(day).alias("date"))
        .agg(
            half_up(F.avg("l_quantity") * 6, 2).alias("rainfall_mm"),
            half_up(F.lit(22) + F.max("l_quantity") * 0.25, 2).alias("temp_max_c"),
            half_up(F.lit(15) + F.min("l_quantity") * 0.25, 2).alias("temp_min_c"),
            half_up(F.lit(18) + F.avg("l_quantity") * 0.35, 2).alias("temp_avg_c"),
            half_up(F.lit(40) + F.avg("l_discount") * 600, 2).alias("humidity_pct"),
            half_up(F.avg("l_tax") * 400, 2).alias("wind_speed_kmh"),
        )
    )
    out = with_week(named(weekly, spark, sf))
    return out.select(
        "province", "year", "week", "date", "rainfall_mm", "temp_max_c", "temp_min_c",
        "temp_avg_c", "humidity_pct", "wind_speed_kmh",
    )


def case_weeks(spark: SparkSession, sf: str) -> DataFrame:
    severe = (F.col("o_orderstatus") == "F") & F.col("o_orderpriority").startswith("1")
    weekly = (
        order_nations(spark, sf)
        .groupBy("c_nationkey", week_start(F.col("o_orderdate").cast("date")).alias("date"))
        .agg(F.count(F.lit(1)).alias("cases"), F.count_if(severe).alias("deaths"))
    )
    return with_week(named(weekly, spark, sf)).select("province", "year", "week", "cases", "deaths")


def demographics(spark: SparkSession, sf: str) -> DataFrame:
    per_nation = table(spark, sf, "customer").groupBy("c_nationkey").agg(
        (F.count(F.lit(1)) * 100).alias("population"),
        (F.lit(10) + F.count_distinct("c_mktsegment") * 100).cast("int").alias("area_km2"),
        half_up(
            F.count_if(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")) * F.lit(100.0) / F.count(F.lit(1)), 2
        ).alias("urban_pct"),
        half_up(F.count_if(F.col("c_acctbal") < 2500) * F.lit(100.0) / F.count(F.lit(1)), 2).alias("poverty_index"),
    )
    return named(per_nation, spark, sf).select(
        "province", "population", "area_km2", "urban_pct", "poverty_index"
    )


def climate_index(spark: SparkSession, sf: str) -> DataFrame:
    """Standardized monthly mean order price by calendar (year, month)."""
    orders = table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("date")
    whole = orders.agg(
        F.struct(F.avg("o_totalprice").alias("mean"), F.stddev_samp("o_totalprice").alias("std"))
    ).scalar()
    monthly = orders.groupBy(F.year(day).alias("year"), F.month(day).alias("month")).agg(
        F.avg("o_totalprice").alias("m")
    )
    z = (F.col("m") - F.col("w.mean")) / F.col("w.std") * 5
    return monthly.withColumn("w", whole).select("year", "month", half_up(z, 2).alias("enso_index"))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """The master panel."""
    return assemble_panel(
        climate_weeks(spark, sf),
        case_weeks(spark, sf),
        demographics(spark, sf),
        climate_index(spark, sf),
        incidence_digits=4,
    )


def stored_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The master panel, assembled once and written, for queries that read it more than once."""
    return materialized(panel(spark, sf), "panel")


def entity_dim(spark: SparkSession, sf: str) -> DataFrame:
    """Nations with code and coordinates derived from the key."""
    key = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        F.col("n_name").alias("province"),
        F.format_string("RD%02d", key + 1).alias("province_code"),
        half_up(F.lit(18.0) + key * F.lit(0.07), 2).alias("latitude"),
        half_up(F.lit(-72.0) + key * F.lit(0.12), 2).alias("longitude"),
    )


def region_nations(spark: SparkSession, sf: str, keep: Column) -> DataFrame:
    """(province) of the nations whose region fulfils ``keep``."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return (
        nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .where(keep)
        .select(F.col("n_name").alias("province"))
    )


def customer_months(spark: SparkSession, sf: str) -> DataFrame:
    """Entity = customer, period = month, dense grid from first to last month.

    This panel grows with the data; the weekly one is bounded by 25 x calendar.
    """
    orders = table(spark, sf, "orders")
    monthly = (
        orders.groupBy(
            F.col("o_custkey").alias("entity"),
            F.trunc(F.col("o_orderdate").cast("date"), "month").alias("date"),
        )
        .agg(F.count(F.lit(1)).alias("cases"), F.sum("o_totalprice").alias("amount"))
    )
    spans = monthly.groupBy("entity").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    grid = spans.select("entity", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("date"))
    dense = grid.join(monthly, ["entity", "date"], "left")
    cases = F.coalesce("cases", F.lit(0))
    return dense.select(
        "entity",
        "date",
        F.year("date").alias("year"),
        F.month("date").alias("week"),
        cases.alias("cases"),
        half_up(F.coalesce("amount", F.lit(0.0)) / 1000, 2).alias("rainfall_mm"),
        half_up(incidence(cases, F.lit(1000)), 4).alias("incidence_rate_100k"),
    )


CUSTOMER_SPEC = PanelSpec(entity="entity", target="cases")

__all__ = [
    "CUSTOMER_SPEC", "SPEC", "case_weeks", "climate_index", "climate_weeks", "customer_months",
    "demographics", "derive_demographics", "entity_dim", "named", "order_nations", "panel",
    "region_nations", "table", "with_week",
]
