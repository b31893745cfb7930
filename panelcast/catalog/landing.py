"""Landed files in the forms that users bring, sinks read back, and small lookups, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.catalog import bindings as B
from panelcast.catalog.cleaning import UPLOADS_SQL, uploads
from panelcast.catalog.forecasts import over_forecast, summary
from panelcast.catalog.registry import query
from panelcast.catalog.sql import over_panel, over_sources
from panelcast.functions.numeric import half_up
from panelcast.operators import assemble as A
from panelcast.operators import validate as V
from panelcast.operators.windows import add_targets
from panelcast.plans.training import tabular
from panelcast.session import scratch_path
from panelcast.sources import readers as R
from panelcast.sources import writers as W
from panelcast.spec import numeric_columns
from panelcast.streaming import uploads as S

text = lambda c: F.col(c).cast("string").alias(c)
RISK = "outbreak_risk_index"


@query(
    "panel_csv_by_name",
    over_panel(
        """select province, year, week, case when year % 2 = 0 then rainfall_mm end as rainfall_mm, cases from panel"""
    ),
)
def panel_csv_by_name(spark, sf):
    """Panel files with their columns in another order, with others besides, and some without one."""
    path = scratch_path(spark, "panel-csv")
    panel = B.stored_panel(spark, sf)
    even = F.col("year") % 2 == 0
    parts = (
        panel.where(even).select("cases", "rainfall_mm", F.lit("x").alias("note"), "week", "province", "year"),
        panel.where(~even).select("year", "week", "cases", "province"),
    )
    for part in parts:
        part.write.mode("append").option("header", True).csv(path)
    return R.read_panel(spark, path, "csv").select("province", "year", "week", "rainfall_mm", "cases")


@query("case_files_with_year", over_sources("select province, year, week, cases, deaths from cases"))
def case_files_with_year(spark, sf):
    """Case files that carry their year among the first columns, in folders that say something else."""
    path = scratch_path(spark, "cases")
    B.case_weeks(spark, sf).select("province", "year", "week", "cases", "deaths").write.option("header", True).csv(
        f"{path}/year=1999"
    )
    return R.read_yearly_cases(spark, path).select("province", "year", "week", "cases", "deaths")


_TYPED = "select province, year, week, cases, count(*) as n from uploads where event_id % 7 <> 0 group by all"


@query("upload_csv", f"with {UPLOADS_SQL} {_TYPED}")
def upload_csv(spark, sf):
    """Uploads as CSV, columns in another order; every seventh holds a word where a number belongs."""
    path = scratch_path(spark, "uploads") + ".csv"
    cases = F.when(F.col("event_id") % 7 == 0, "many").otherwise(F.col("cases").cast("string")).alias("cases")
    uploads(spark, sf).select("week", cases, "province", "year").write.option("header", True).csv(path)
    good, _ = R.read_upload_csv(spark, path)
    return good.groupBy("province", "year", "week", "cases").agg(F.count(F.lit(1)).alias("n"))


@query("upload_json_lines", f"with {UPLOADS_SQL} {_TYPED}")
def upload_json_lines(spark, sf):
    """Uploads as one JSON record per line; every seventh line is cut short."""
    return _from_json(spark, sf, lists=False)


@query("upload_json_lists", f"with {UPLOADS_SQL} {_TYPED}")
def upload_json_lists(spark, sf):
    """Uploads as JSON lists, one file for each week, in which every seventh record is no object."""
    return _from_json(spark, sf, lists=True)


def _from_json(spark, sf, lists):
    path = scratch_path(spark, "uploads")
    record = F.to_json(F.struct("province", "year", "week", "cases"))
    broken = F.lit('"none"') if lists else F.substring(record, 1, 20)
    rows = uploads(spark, sf).select("week", F.when(F.col("event_id") % 7 == 0, broken).otherwise(record).alias("r"))
    if lists:
        rows = rows.groupBy("week").agg(F.concat(F.lit("["), F.array_join(F.collect_list("r"), ",\n"), F.lit("]")).alias("r"))
        rows.repartition("week").sortWithinPartitions("week").write.partitionBy("week").text(path)
    else:
        rows.select("r").write.text(path)
    good, _ = R.read_upload_json(spark, path)
    return good.groupBy("province", "year", "week", "cases").agg(F.count(F.lit(1)).alias("n"))


@query(
    "upload_corrections",
    f"""with {UPLOADS_SQL}, u as (select province, year, week, cases, ts, event_id from uploads
      where week between 1 and 53 and cases >= 0 and province in (select n_name from nation))
    select province, year, week, cases + 100 as cases from (
      select *, row_number() over (partition by province, year, week order by ts desc, event_id desc) as rn from u) where rn = 1""",
)
def upload_corrections(spark, sf):
    """Every upload is corrected down and back again a year later, the correction arriving before older rows."""
    source, target = scratch_path(spark, "landed"), scratch_path(spark, "uploads")
    first = uploads(spark, sf).withColumns({"ts": F.col("ts").cast("timestamp"), "seen": F.lit(0)})
    up = first.withColumn("cases", F.col("cases") + 100)
    deliveries = (
        (up, 1), (up.withColumn("cases", F.col("cases") + 50), 2), (up, 3), (first, 0),
    )
    schema = first.schema
    for rows, turn in deliveries:
        late = F.col("ts") + F.make_interval(years=F.lit(turn))
        # A negative count stays one, so that a broken upload is not mended by its correction.
        kept = F.when(F.col("cases") - 100 * min(turn, 1) - (50 if turn == 2 else 0) < 0, -1).otherwise(F.col("cases"))
        rows.withColumns({"cases": kept, "seen": F.lit(turn), "ts": late}).write.mode("append").parquet(source)
        landed = spark.readStream.schema(schema).parquet(source)
        S.start_ingestion(landed, B.region_nations(spark, sf, F.lit(True)), target, f"{target}/checkpoint").awaitTermination()
    made = S.current_panel(spark, target, ["seen", "ts", "event_id"])
    return made.select("province", "year", "week", "cases")


@query("raw_sink", "select n_name as province, n_regionkey as region from nation")
def raw_sink(spark, sf):
    """A raw table written as CSV and read back; an empty one is not written."""
    path = scratch_path(spark, "raw")
    rows = B.table(spark, sf, "nation").select(F.col("n_name").alias("province"), F.col("n_regionkey").alias("region"))
    if not W.write_raw(rows, f"{path}/csv") or W.write_raw(rows.where("region < 0"), f"{path}/none"):
        raise AssertionError("the sink tells wrongly what it wrote")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return spark.read.schema(schema).option("header", True).csv(f"{path}/csv")


@query("latest_predictions", over_forecast("select province, risk_index, peak_week, trend from forecast"))
def latest_predictions(spark, sf):
    """The forecast as the last run left it."""
    path = scratch_path(spark, "latest")
    made = summary(spark, sf).select("province", "risk_index", "peak_week", "trend")
    W.write_raw(made, path, "parquet")
    return R.read_latest_predictions(spark, path)


@query(
    "report_sink",
    over_forecast("select province, w1, w4, peak_risk from forecast"),
)
def report_sink(spark, sf):
    """Nested rows written as JSON and read back."""
    path = scratch_path(spark, "report")
    weeks = F.array(*[f"week_{h}_forecast" for h in range(1, 5)]).alias("weeks")
    W.write_report(summary(spark, sf).select("province", weeks, "peak_risk"), path)
    made = spark.read.schema("province string, weeks array<double>, peak_risk double").json(path)
    return made.select("province", F.col("weeks")[0].alias("w1"), F.col("weeks")[3].alias("w4"), "peak_risk")


@query(
    "point_lookup",
    over_panel(
        f"select province, cast(date as varchar) as date, {RISK} from panel where province = 'NATION_7'"
    ),
)
def point_lookup(spark, sf):
    """The rows of one entity, given as free text."""
    rows = A.lookup_entity(B.panel(spark, sf), "  nation_7 ", B.entity_dim(spark, sf))
    return rows.select("province", text("date"), RISK)


@query(
    "valid_rows",
    over_panel(
        f"""select province, cast(date as varchar) as date, y4 from (select province, date,
        {', '.join(f'lead({RISK}, {h}) over w as y{h}' for h in range(1, 5))} from panel
        window w as (partition by province order by date))
        where {' and '.join(f'y{h} is not null' for h in range(1, 5))}"""
    ),
)
def valid_rows(spark, sf):
    """Only rows all of whose targets are known."""
    made = add_targets(B.panel(spark, sf).select("province", "date", "year", "week", RISK), B.SPEC)
    return made.select("province", text("date"), F.col("target_week_4").alias("y4"))


_NUMERIC = [
    "rainfall_mm", "temp_max_c", "temp_min_c", "temp_avg_c", "humidity_pct", "wind_speed_kmh", "enso_index", "cases",
    "deaths", "incidence_rate_100k", "population", "area_km2", "urban_pct", "poverty_index",
]


@query(
    "tabular_features",
    over_panel(
        f"""select province, cast(date as varchar) as date, {len(_NUMERIC)} as size,
        floor(({' + '.join(f'coalesce({c}, 0)' for c in _NUMERIC)}) * 1e2 + 0.5 + 1e-6) / 1e2 as total from panel"""
    ),
)
def tabular_features(spark, sf):
    """The numeric columns of a row as one vector, nulls as 0."""
    from pyspark.ml.functions import vector_to_array

    panel = B.panel(spark, sf).select("province", "date", *_NUMERIC)
    names = numeric_columns(V.require_columns(panel, _NUMERIC))
    values = vector_to_array("features")
    made = tabular(panel, names).withColumn("v", values)
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return made.select("province", text("date"), F.size("v").alias("size"), half_up(total, 2).alias("total"))
