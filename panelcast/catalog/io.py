"""Readers and sinks, exercised by writing derived tables and reading them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.catalog import bindings as B
from panelcast.catalog.forecasts import FORECAST_SQL, forecast
from panelcast.catalog.registry import query
from panelcast.catalog.sql import over_panel, over_sources, r
from panelcast.functions.numeric import half_up
from panelcast.operators.assemble import derive_demographics
from panelcast.plans.prediction import export_tables
from panelcast.session import materialized, scratch_path
from panelcast.sources import readers as R
from panelcast.sources import writers as W
from panelcast.sources.schemas import PANEL

text = lambda c: F.col(c).cast("string").alias(c)


@query(
    "scan_panel",
    over_panel(
        f"""select province, cast(date as varchar) as date, year, week, cases, rainfall_mm, enso_index,
        {r('population/area_km2', 4)} as population_density_km2, outbreak_risk_index from panel"""
    ),
)
def scan_panel(spark, sf):
    """The panel as CSV with a header, read with its explicit schema."""
    names = [c.split()[0] for c in PANEL.split(", ")]
    panel = derive_demographics(B.panel(spark, sf)).select(*names)
    path = scratch_path(spark, "panel-csv")
    panel.write.option("header", True).csv(path)
    return R.read_panel(spark, path, "csv").select(
        "province", text("date"), "year", "week", "cases", "rainfall_mm", "enso_index",
        half_up("population_density_km2", 4).alias("population_density_km2"), "outbreak_risk_index",
    )


@query("yearly_cases", over_sources("select province, year, week, cases, deaths, deaths as severe_cases from cases"))
def yearly_cases(spark, sf):
    """Case files landed in one folder per year."""
    path = scratch_path(spark, "cases")
    cases = B.case_weeks(spark, sf).withColumn("severe_cases", F.col("deaths"))
    landed = cases.select("province", "week", "cases", "deaths", "severe_cases", "year")
    landed.repartition("year").write.partitionBy("year").option("header", True).csv(path)
    return R.read_yearly_cases(spark, path).select(
        "province", "year", "week", "cases", "deaths", "severe_cases"
    )


@query(
    "recent_climate",
    over_sources(
        """select province, cast(date as varchar) as date, rainfall_mm, temp_avg_c, humidity_pct from climate
        where date > (select max(date) from climate) - 364"""
    ),
)
def recent_climate(spark, sf):
    """Climate JSON in one folder per entity, last 52 weeks."""
    path = scratch_path(spark, "climate")
    landed = B.climate_weeks(spark, sf).drop("year", "week")
    landed.repartition("province").write.partitionBy("province").json(path)
    return R.read_climate(spark, path, weeks=52).select(
        "province", text("date"), "rainfall_mm", "temp_avg_c", "humidity_pct"
    )


@query(
    "demographics_json",
    over_sources(
        f"""select province, population, area_km2, urban_pct, poverty_index,
        {r('population/area_km2', 4)} as population_density_km2, {r('100-poverty_index*0.6', 4)} as sanitation_index
        from demo"""
    ),
)
def demographics_json(spark, sf):
    path = scratch_path(spark, "demographics")
    B.demographics(spark, sf).write.json(path)
    made = R.read_demographics(spark, path)
    digits = ("population_density_km2", "sanitation_index")
    return made.withColumns({c: half_up(c, 4) for c in digits})


@query(
    "wide_month_unpivot",
    f"""select cast(year(o_orderdate) as int) as year, cast(month(o_orderdate) as int) as month,
    {r('avg(o_totalprice)', 2)} as enso_index from orders group by 1, 2""",
)
def wide_month_unpivot(spark, sf):
    """A text file of one line per year, with a header line and gaps as NA."""
    day = F.col("o_orderdate").cast("date")
    cells = [
        F.coalesce(
            F.format_string("%.2f", half_up(F.avg(F.when(F.month(day) == m, F.col("o_totalprice"))), 2)), F.lit("NA")
        ).alias(f"m{m}")
        for m in range(1, 13)
    ]
    months = [f"m{m}" for m in range(1, 13)]
    grouped = B.table(spark, sf, "orders").groupBy(F.year(day).alias("y")).agg(*cells)
    clean = [F.when(F.col(m) == "null", "NA").otherwise(F.col(m)) for m in months]
    lines = grouped.select(F.concat_ws("  ", F.col("y").cast("string"), *clean).alias("value"))
    header = lines.select(F.lit("YEAR J F M A M J J A S O N D").alias("value")).limit(1)
    path = scratch_path(spark, "monthly")
    header.unionByName(lines).write.text(path)
    return R.read_monthly_text(spark, path)


@query(
    "concat_sources",
    """select o_orderkey, o_orderstatus, case when o_orderstatus = 'F' then o_orderpriority end as o_orderpriority
    from orders""",
)
def concat_sources(spark, sf):
    """One of three frames has a column that the others lack."""
    orders = B.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    of = lambda s: orders.where(F.col("o_orderstatus") == s)
    fewer = [of(s).drop("o_orderpriority") for s in ("O", "P")]
    return R.concat_sources([of("F"), *fewer])


@query(
    "encrypt_roundtrip",
    """select c_custkey, c_name, true as gcm_hidden, true as cbc_hidden, c_name as gcm_back, c_name as cbc_back
    from customer""",
)
def encrypt_roundtrip(spark, sf):
    """Names hidden and revealed in both modes, with a key made from the data."""
    key = F.substring(F.sha2(F.col("c_name"), 256), 1, 32)
    rows = B.table(spark, sf, "customer").select("c_custkey", "c_name", key.alias("k"))
    hidden = rows.withColumns(
        {m.lower(): W.encrypt(F.col("c_name"), F.col("k"), m) for m in ("GCM", "CBC")}
    )
    back = {f"{m.lower()}_back": W.decrypt(F.col(m.lower()), F.col("k"), m) for m in ("GCM", "CBC")}
    differs = {f"{m}_hidden": F.col(m) != F.col("c_name") for m in ("gcm", "cbc")}
    return hidden.withColumns(back | differs).drop("k", "gcm", "cbc")


@query(
    "export_set",
    over_panel(
        """select 'predictions_summary' as name, 25::bigint as n union all select 'predictions_forecast_weekly', 100
        union all select 'predictions_historical', count(*) from panel
        union all select 'predictions_risk_bands', (select count(distinct risk_level) from forecast)
        union all select 'predictions_alerts', (select count(*) from forecast where risk_index >= 65)""",
        FORECAST_SQL.strip(),
    ),
)
def export_set(spark, sf):
    """Rows of the five exported tables, as read back."""
    panel = materialized(B.panel(spark, sf), "panel")
    as_of = panel.agg(F.max("date").cast("string")).scalar()
    tables = export_tables(panel, forecast(spark, sf, panel), B.entity_dim(spark, sf), as_of)
    folder = scratch_path(spark, "exports")
    W.write_exports(tables, folder)
    counts = [
        spark.read.schema(tables[name].schema).option("header", True).csv(f"{folder}/{name}")
        .agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        for name in W.EXPORTS
    ]
    return R.concat_sources(counts)


@query(
    "incremental_refresh",
    over_panel(
        """select province, year, week, case when date > (select max(date) from panel) - 28 then cases + 1000 else cases end as cases
        from panel"""
    ),
)
def incremental_refresh(spark, sf):
    """The last four weeks are landed again; the rest of the panel stays."""
    panel = materialized(B.panel(spark, sf).select("province", "date", "year", "week", "cases"), "panel")
    path = scratch_path(spark, "weekly")
    panel.write.partitionBy("year", "week").parquet(path)
    last = panel.agg(F.max("date")).scalar()
    again = panel.where(F.col("date") > F.date_sub(last, 28)).withColumn("cases", F.col("cases") + 1000)
    W.refresh_partitions(again, path, ["year", "week"])
    return spark.read.parquet(path).select("province", "year", "week", "cases")
