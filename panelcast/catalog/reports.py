"""Report tables and KPIs over the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.catalog import bindings as B
from panelcast.catalog.forecasts import FORECAST_SQL, forecast
from panelcast.catalog.registry import query
from panelcast.catalog.sql import over_panel, r, risk_class
from panelcast.functions import labels as L
from panelcast.functions.numeric import half_up
from panelcast.operators import assemble as A
from panelcast.operators import reports as P
from panelcast.operators.windows import latest_row
from panelcast.plans.features import history_export
from panelcast.operators.forecast import HISTORY_COLUMNS
from panelcast.spec import present

text = lambda c: F.col(c).cast("string").alias(c)
RISK = "outbreak_risk_index"

LATEST_SQL = f"""latest as (select * , {risk_class('risk')} as risk_level from (
  select *, outbreak_risk_index as risk, row_number() over (partition by province order by date desc) as rn
  from panel) where rn = 1)"""


def over_latest(select: str, ctes: str = "") -> str:
    return over_panel(select, LATEST_SQL + (f",\n{ctes}" if ctes else ""))


def latest(spark, sf, panel=None):
    """Last panel row of each entity with ``risk`` and ``risk_level``."""
    last = latest_row(B.panel(spark, sf) if panel is None else panel).withColumn("risk", F.col(RISK))
    return P.with_class(last, "risk")


@query(
    "overview",
    over_latest(
        f"""select province, risk, risk_level, risk >= 65 as is_epidemic, trend,
        (select count(*) from latest) as total_entities,
        (select count(*) from latest where risk >= 65) as epidemic_count,
        (select count(*) from latest where risk >= 80) as alert_count,
        {r('(select avg(risk) from latest)', 2)} as average_risk,
        (select province from latest order by risk desc, province desc limit 1) as highest_risk_entity
        from latest join (select province, trend from forecast) using (province)""",
        FORECAST_SQL.strip(),
    ),
)
def overview(spark, sf):
    """Envelope values on every item row, items by falling risk."""
    panel = B.stored_panel(spark, sf)
    rows = latest(spark, sf, panel).join(forecast(spark, sf, panel).select("province", "trend"), "province")
    kpis = P.overview(rows).withColumn("average_risk", half_up("average_risk", 2))
    items = rows.select("province", "risk", "risk_level", (F.col("risk") >= 65).alias("is_epidemic"), "trend")
    return P.with_envelope(items, kpis).orderBy(F.desc("risk"), "province")


@query(
    "kpi_row",
    over_latest(
        f"""select a.*, m.province as top_entity, m.risk as top_risk, m.risk_level as top_level from (
        select count(*) filter (where risk >= 65) as epidemic_count, count(*) filter (where risk >= 50) as high_count,
        {r('avg(risk)', 2)} as mean_risk from latest) a, (select * from latest order by risk desc, province desc limit 1) m"""
    ),
)
def kpi_row(spark, sf):
    top = F.max_by(F.struct("province", "risk", "risk_level"), F.struct("risk", "province"))
    return latest(spark, sf).agg(
        F.count_if(F.col("risk") >= 65).alias("epidemic_count"),
        F.count_if(F.col("risk") >= 50).alias("high_count"),
        half_up(F.avg("risk"), 2).alias("mean_risk"),
        top.alias("t"),
    ).select(
        "epidemic_count", "high_count", "mean_risk", F.col("t.province").alias("top_entity"),
        F.col("t.risk").alias("top_risk"), F.col("t.risk_level").alias("top_level"),
    )


@query(
    "epidemic_banner",
    over_panel(
        """select cast(date as varchar) as date, province, outbreak_risk_index as risk,
        count(*) over (partition by date) as epidemic_count from panel where outbreak_risk_index >= 65"""
    ),
)
def epidemic_banner(spark, sf):
    """Names for the banner of each week, with that week's count."""
    high = P.threshold_alerts(B.stored_panel(spark, sf), RISK)
    counts = high.groupBy("date").agg(F.count(F.lit(1)).alias("epidemic_count"))
    return high.join(counts, "date").select(
        text("date"), "province", F.col(RISK).alias("risk"), "epidemic_count"
    )


@query(
    "risk_bands",
    over_panel(
        f"""select risk_level, count(*) as province_count from (
        select {risk_class('outbreak_risk_index')} as risk_level from panel) group by 1"""
    ),
)
def risk_bands(spark, sf):
    return P.risk_bands(P.with_class(B.panel(spark, sf), RISK))


@query(
    "alerts_threshold",
    over_panel(
        f"""select province, cast(date as varchar) as date, outbreak_risk_index as risk,
        {risk_class('outbreak_risk_index')} as risk_level from panel where outbreak_risk_index >= 65"""
    ),
)
def alerts_threshold(spark, sf):
    hits = P.with_class(P.threshold_alerts(B.panel(spark, sf), RISK), RISK)
    return hits.select("province", text("date"), F.col(RISK).alias("risk"), "risk_level").orderBy(
        F.desc("risk"), "province", "date"
    )


@query(
    "alerts_critical",
    over_panel(
        """select province, cast(date as varchar) as date, outbreak_risk_index as risk,
        count(*) over () as total from panel where outbreak_risk_index >= 80"""
    ),
)
def alerts_critical(spark, sf):
    hits = P.threshold_alerts(B.stored_panel(spark, sf), RISK, 80.0)
    rows = hits.select("province", text("date"), F.col(RISK).alias("risk"))
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    return P.with_envelope(rows, total).orderBy(F.desc("risk"), "province", "date")


@query(
    "history_export",
    over_panel(
        """select 'RD' || lpad(cast(n_nationkey+1 as varchar), 2, '0') as province_code, province,
        cast(date as varchar) as date, year, week, month, cases, deaths, incidence_rate_100k, outbreak_risk_index,
        rainfall_mm, temp_avg_c, humidity_pct, population, urban_pct, poverty_index
        from panel join nation on n_name = province"""
    ),
)
def history(spark, sf):
    made = history_export(B.panel(spark, sf), HISTORY_COLUMNS, B.entity_dim(spark, sf))
    return made.withColumn("date", F.col("date").cast("string")).orderBy("province", "date")


@query(
    "history_subset",
    over_panel(
        """select province, cast(date as varchar) as date, cases, outbreak_risk_index from panel
        where province in ('NATION_1', 'NATION_7', 'NATION_12')"""
    ),
)
def history_subset(spark, sf):
    chosen = B.panel(spark, sf).where(F.col("province").isin("NATION_1", "NATION_7", "NATION_12"))
    return chosen.select("province", text("date"), "cases", RISK)


@query(
    "map_layer",
    over_latest(
        """select l.province, floor((18.0+n_nationkey*0.07)*1e2+0.5+1e-6)/1e2 as latitude,
        floor((-72.0+n_nationkey*0.12)*1e2+0.5+1e-6)/1e2 as longitude, risk, greatest(10.0::double, risk*0.4) as marker_size,
        case risk_level when 'Bajo' then 'green' when 'Moderado' then 'yellow' when 'Alto' then 'orange'
        when 'Epidemia' then 'red' else 'darkred' end as color
        from latest l join nation on n_name = province join region on n_regionkey = r_regionkey where r_name <> 'ASIA'"""
    ),
)
def map_layer(spark, sf):
    """Entities of one region have no coordinates and are left out."""
    placed = B.entity_dim(spark, sf).join(
        B.region_nations(spark, sf, F.col("r_name") != "ASIA"), "province", "left_semi"
    )
    return A.map_layer(latest(spark, sf), placed, "risk", L.marker_color(F.col("risk_level")))


@query(
    "complete_entities",
    over_latest(
        f"""select n_name as province, coalesce(l.risk_index, 0.0) as risk_index,
        coalesce(l.risk_level, 'Sin datos') as risk_level,
        {', '.join(f'coalesce(l.w{h}, 0.0) as week_{h}' for h in range(1, 5))},
        coalesce(l.peak_risk, 0.0) as peak_risk, coalesce(l.peak_week, 1) as peak_week,
        coalesce(l.risk_index >= 65, false) as is_epidemic, coalesce(l.risk_index >= 80, false) as is_alert,
        coalesce(l.trend, 'Sin datos') as trend from nation left join
        (select l.* from forecast l join nation on n_name = province join region on n_regionkey = r_regionkey
         where r_name <> 'AFRICA') l on l.province = n_name""",
        FORECAST_SQL.strip(),
    ),
)
def complete_entities(spark, sf):
    """Predictions exist for the entities of all regions but one."""
    known = B.region_nations(spark, sf, F.col("r_name") != "AFRICA")
    made = forecast(spark, sf).join(known, "province", "left_semi").select(
        "province", "risk_index", "risk_level", "forecast.*", "peak_risk", "peak_week", "is_epidemic", "is_alert", "trend"
    )
    return A.complete_entities(B.entity_dim(spark, sf), made, A.EMPTY_RECORD)


@query(
    "seasonal_profile",
    over_panel(
        f"""select month, {r('avg(total)', 4)} as mean, {r('coalesce(stddev_samp(total), 0)', 4)} as std,
        {r('avg(total)-coalesce(stddev_samp(total), 0)', 4)} as band_low,
        {r('avg(total)+coalesce(stddev_samp(total), 0)', 4)} as band_high
        from (select g.m as month, g.y, cast(coalesce(sum(p.cases), 0) as double) as total
          from (select m, y from (select distinct year(date) as y from panel),
                (select distinct cast(month(date) as int) as m from panel)) g
          left join panel p on year(p.date) = g.y and month(p.date) = g.m group by 1, 2) group by month"""
    ),
)
def seasonal_profile(spark, sf):
    made = P.seasonal_profile(B.panel(spark, sf), "cases")
    return made.select(
        "month", *[half_up(c, 4).alias(c) for c in ("mean", "std", "band_low", "band_high")]
    )


_MONTHS = [f"m{m}" for m in range(1, 13)]


@query(
    "month_heatmap",
    over_panel(
        "select province, "
        + ", ".join(r(c, 4) + f" as {c}" for c in _MONTHS)
        + f", {r('+'.join(_MONTHS), 4)} as total from (select province, "
        + ", ".join(
            f"coalesce(avg(cases) filter (where month(date) = {m}), 0) as m{m}" for m in range(1, 13)
        )
        + " from panel group by province) order by " + "+".join(_MONTHS) + " desc, province limit 12"
    ),
)
def month_heatmap(spark, sf):
    made = P.month_heatmap(B.panel(spark, sf), "cases")
    return made.select("province", *[half_up(c, 4).alias(c) for c in [*_MONTHS, "total"]])


@query(
    "national_series",
    over_panel(
        f"""select cast(date as varchar) as date, {r('avg(cases)', 4)} as cases_mean,
        {r('avg(outbreak_risk_index)', 4)} as outbreak_risk_index_mean from panel group by date"""
    ),
)
def national_series(spark, sf):
    made = P.national_series(B.panel(spark, sf), ["cases", RISK])
    return made.select(text("date"), *[half_up(f"{c}_mean", 4).alias(f"{c}_mean") for c in ("cases", RISK)])


@query(
    "entity_stats",
    over_panel(
        f"""select province, {r('avg(outbreak_risk_index)', 2)} as mean, max(outbreak_risk_index) as max,
        {r('stddev_samp(outbreak_risk_index)', 2)} as std from panel group by province"""
    ),
)
def entity_stats(spark, sf):
    made = P.entity_stats(B.panel(spark, sf), RISK)
    return made.select(
        "province", half_up("mean", 2).alias("mean"), "max", half_up("std", 2).alias("std")
    ).orderBy(F.desc("mean"), "province")


@query(
    "week_profile",
    over_panel(f"select week, {r('avg(outbreak_risk_index)', 4)} as mean from panel group by week"),
)
def week_profile(spark, sf):
    made = P.period_profile(B.panel(spark, sf), "week", RISK)
    return made.select("week", half_up("mean", 4).alias("mean")).orderBy("week")


@query(
    "eda_conclusions",
    over_panel(
        f"""select (select province from panel group by province order by avg(outbreak_risk_index) desc, province desc limit 1) as top_entity,
        {r('(select max(m) from (select avg(outbreak_risk_index) as m from panel group by province))', 4)} as top_entity_mean,
        (select week from panel group by week order by avg(outbreak_risk_index) desc, week desc limit 1) as peak_week,
        {r('(select max(m) from (select avg(outbreak_risk_index) as m from panel group by week))', 4)} as peak_week_mean,
        {r('(select avg(cast(outbreak_risk_index >= 65 as int))*100 from panel)', 4)} as pct_epidemic,
        (select count(distinct province) from panel) as entities, (select count(*) from panel) as rows"""
    ),
)
def eda_conclusions(spark, sf):
    made = P.conclusions(B.panel(spark, sf))
    return made.select(
        "top_entity", half_up("top_entity_mean", 4).alias("top_entity_mean"), "peak_week",
        half_up("peak_week_mean", 4).alias("peak_week_mean"), half_up("pct_epidemic", 4).alias("pct_epidemic"),
        "entities", "rows",
    )


DESCRIBED = ["rainfall_mm", "temp_avg_c", "humidity_pct", "cases", "enso_index", RISK]


@query(
    "describe",
    over_panel(
        "\nunion all ".join(
            f"""select '{c}' as "column", count({c}) as count, {r(f'avg({c})', 2)} as mean,
            {r(f'stddev_samp({c})', 2)} as std, cast(min({c}) as double) as min,
            {r(f'quantile_cont(cast({c} as double), 0.25)', 2)} as q25,
            {r(f'quantile_cont(cast({c} as double), 0.5)', 2)} as q50,
            {r(f'quantile_cont(cast({c} as double), 0.75)', 2)} as q75, cast(max({c}) as double) as max from panel"""
            for c in DESCRIBED
        )
    ),
)
def describe(spark, sf):
    made = P.describe(B.stored_panel(spark, sf), DESCRIBED)
    return made.select(
        "column", "count", *[half_up(c, 2).alias(c) for c in ("mean", "std")], "min",
        *[half_up(c, 2).alias(c) for c in ("q25", "q50", "q75")], "max",
    )


@query(
    "histogram",
    over_panel(
        """select cast(least(floor((outbreak_risk_index - lo)/(hi - lo)*50), 49) as int) as bin, count(*) as n
        from panel, (select min(outbreak_risk_index) as lo, max(outbreak_risk_index) as hi from panel) group by 1"""
    ),
)
def histogram(spark, sf):
    return P.histogram(B.panel(spark, sf), RISK)


CORRELATED = list(P.CORRELATION_COLUMNS) + ["enso_index"]
_CORR_CTE = "wide as (select *, population/area_km2 as population_density_km2 from panel)"


def _corr_sql() -> str:
    cells = []
    for a in CORRELATED:
        for b in CORRELATED:
            complete = f"filter (where {a} is not null and {b} is not null)"
            spread = f"stddev_pop({a}) {complete} * stddev_pop({b}) {complete}"
            x = f"covar_pop({a}, {b}) / nullif({spread}, 0)"
            cells.append(f"select '{a}' as column_a, '{b}' as column_b, {r(x, 4)} as r from wide")
    return over_panel("\nunion all ".join(cells), _CORR_CTE)


def _wide(spark, sf):
    return A.derive_demographics(B.panel(spark, sf))


@query("corr_matrix", _corr_sql())
def corr_matrix(spark, sf):
    made = P.correlation_matrix(_wide(spark, sf), CORRELATED)
    return made.select("column_a", "column_b", half_up("r", 4).alias("r"))


@query(
    "corr_rank",
    over_panel(
        "\nunion all ".join(
            f"""select '{c}' as "column", {r(f'corr(outbreak_risk_index, {c})', 4)} as r from wide"""
            for c in P.CORRELATION_COLUMNS[1:]
        ),
        _CORR_CTE,
    ),
)
def corr_rank(spark, sf):
    made = P.correlation_rank(_wide(spark, sf), RISK)
    return made.select("column", half_up("r", 4).alias("r"))


@query(
    "enso_regression",
    over_panel(
        f"""select {r('regr_slope(outbreak_risk_index, coalesce(enso_index, 0))', 4)} as slope,
        {r('regr_intercept(outbreak_risk_index, coalesce(enso_index, 0))', 4)} as intercept,
        min(enso_index) as x_min, max(enso_index) as x_max from panel"""
    ),
)
def enso_regression(spark, sf):
    made = P.line_fit(B.panel(spark, sf), "enso_index", RISK)
    return made.select(
        half_up("slope", 4).alias("slope"), half_up("intercept", 4).alias("intercept"), "x_min", "x_max"
    )


_PHASE = """phased as (select *, case when enso_index > -3 and enso_index <= -0.5 then 'La Nina'
  when enso_index > -0.5 and enso_index <= 0.5 then 'Neutral'
  when enso_index > 0.5 and enso_index <= 3 then 'El Nino' end as phase from panel),
q as (select phase, quantile_cont(outbreak_risk_index, 0.25) as q1, quantile_cont(outbreak_risk_index, 0.5) as median,
  quantile_cont(outbreak_risk_index, 0.75) as q3 from phased where phase is not null group by 1)"""


@query(
    "phase_boxstats",
    over_panel(
        f"""select phase, {r('q1', 4)} as q1, {r('median', 4)} as median, {r('q3', 4)} as q3, count(*) as n,
        min(outbreak_risk_index) filter (where outbreak_risk_index between q1-(q3-q1)*1.5 and q3+(q3-q1)*1.5) as whisker_low,
        max(outbreak_risk_index) filter (where outbreak_risk_index between q1-(q3-q1)*1.5 and q3+(q3-q1)*1.5) as whisker_high,
        count(*) filter (where not outbreak_risk_index between q1-(q3-q1)*1.5 and q3+(q3-q1)*1.5) as outliers
        from phased join q using (phase) group by phase, q1, median, q3""",
        _PHASE,
    ),
)
def phase_boxstats(spark, sf):
    phased = B.stored_panel(spark, sf).withColumn("phase", P.phase(F.col("enso_index")))
    made = P.box_stats(phased, "phase", RISK)
    return made.select(
        "phase", *[half_up(c, 4).alias(c) for c in ("q1", "median", "q3")], "n",
        "whisker_low", "whisker_high", "outliers",
    )


@query(
    "topk_risk",
    over_panel(
        """select province, cast(date as varchar) as date, outbreak_risk_index as risk from panel
        order by outbreak_risk_index desc, province || '/' || cast(date as varchar) limit 10"""
    ),
)
def topk_risk(spark, sf):
    rows = B.panel(spark, sf).select(
        "province", text("date"), F.col(RISK).alias("risk"), F.concat_ws("/", "province", "date").alias("tie")
    )
    return P.top_k(rows, "risk", 10, "tie").drop("tie")


@query(
    "ranking",
    over_latest(
        """select province, risk, case when risk >= 80 then '#6f0000' when risk >= 65 then '#dc3545'
        when risk >= 50 then '#fd7e14' when risk >= 25 then '#ffc107' else '#28a745' end as color
        from latest order by risk desc, province limit 15"""
    ),
)
def ranking(spark, sf):
    top = P.top_k(latest(spark, sf), "risk", 15, "province")
    return top.select("province", "risk", L.color(F.col("risk_level")).alias("color"))


@query("columns_present", over_panel("select province, cast(date as varchar) as date, cases from panel"))
def columns_present(spark, sf):
    """A wanted list that names columns the panel does not have."""
    panel = B.panel(spark, sf)
    kept = present(panel, ["province", "date", "cases", "soil_moisture"])
    return panel.select(*kept).withColumn("date", F.col("date").cast("string"))
