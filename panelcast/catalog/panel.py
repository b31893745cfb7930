"""Panel assembly, its joins, and the per-row scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.catalog import bindings as B
from panelcast.catalog.registry import query
from panelcast.catalog.sql import over_panel, over_sources, r, risk_class
from panelcast.functions import labels as L
from panelcast.functions import risk as R
from panelcast.functions import temporal as T
from panelcast.functions.numeric import half_up
from panelcast.operators import assemble as A
from panelcast.spec import align_schema

text = lambda c: F.col(c).cast("string").alias(c)


@query(
    "master_panel",
    over_panel(
        f"""select province, year, week, cast(date as varchar) as date, month, rainfall_mm, temp_max_c,
        temp_min_c, temp_avg_c, humidity_pct, wind_speed_kmh, enso_index, cases, deaths, population,
        area_km2, urban_pct, poverty_index, incidence_rate_100k, outbreak_risk_index,
        {risk_class('outbreak_risk_index')} as risk_level from panel"""
    ),
)
def master_panel(spark, sf):
    return (
        B.panel(spark, sf)
        .withColumn("risk_level", R.risk_class(F.col("outbreak_risk_index")))
        .withColumn("date", F.col("date").cast("string"))
    )


@query(
    "panel_join",
    over_sources(
        """select c.province, c.year, c.week, cast(c.date as varchar) as date, c.rainfall_mm,
        coalesce(k.cases, 0) as cases, coalesce(k.deaths, 0) as deaths, d.population, d.poverty_index
        from climate c left join cases k using (province, year, week) left join demo d using (province)"""
    ),
)
def panel_join(spark, sf):
    joined = A.join_cases(B.climate_weeks(spark, sf), B.case_weeks(spark, sf))
    joined = A.join_dimension(joined, B.demographics(spark, sf))
    return joined.select(
        "province", "year", "week", text("date"), "rainfall_mm", "cases", "deaths", "population", "poverty_index"
    )


@query(
    "enso_join",
    over_sources(
        """select c.province, cast(c.date as varchar) as date, cast(month(c.date) as int) as month, e.enso_index
        from climate c left join enso e on e.year = year(c.date) and e.month = month(c.date)"""
    ),
)
def enso_join(spark, sf):
    joined = A.join_monthly(B.climate_weeks(spark, sf), B.climate_index(spark, sf))
    return joined.select("province", text("date"), "month", "enso_index")


@query(
    "incidence",
    over_sources(
        f"""select k.province, k.year, k.week, k.cases,
        coalesce({r('k.cases/d.population*100000', 4)}, 0) as incidence_rate_100k
        from cases k left join demo d using (province)"""
    ),
)
def incidence(spark, sf):
    cases = A.join_dimension(B.case_weeks(spark, sf), B.demographics(spark, sf))
    rate = R.incidence(F.col("cases"), F.col("population"), 4)
    return cases.select("province", "year", "week", "cases", rate.alias("incidence_rate_100k"))


_NO_RAIN = (
    "least(greatest(least(greatest(incidence_rate_100k,0),100)/100*40"
    " + least(greatest((temp_avg_c-20)/15,0),1)*20 + poverty_index/100*5, 0), 100)"
)


@query(
    "risk_index",
    over_panel(
        f"""select province, cast(date as varchar) as date, outbreak_risk_index as risk,
        {r(_NO_RAIN, 2)} as risk_without_rain_humidity from panel"""
    ),
)
def risk_index(spark, sf):
    """The full index, and the one over a frame that lacks two of its columns."""
    panel = B.panel(spark, sf)
    fewer = panel.drop("rainfall_mm", "humidity_pct")
    return panel.select(
        "province",
        text("date"),
        F.col("outbreak_risk_index").alias("risk"),
        R.risk_index(fewer).alias("risk_without_rain_humidity"),
    )


@query(
    "risk_class",
    over_panel(
        f"""select province, cast(date as varchar) as date, outbreak_risk_index as risk,
        {risk_class('outbreak_risk_index')} as risk_level, outbreak_risk_index >= 65 as is_epidemic,
        outbreak_risk_index >= 80 as is_alert,
        case when outbreak_risk_index >= 80 then 'Critico' else 'Epidemia' end as alert_type from panel"""
    ),
)
def risk_class_query(spark, sf):
    risk = F.col("outbreak_risk_index")
    return B.panel(spark, sf).select(
        "province", text("date"), risk.alias("risk"), R.risk_class(risk).alias("risk_level"),
        R.is_epidemic(risk).alias("is_epidemic"), R.is_alert(risk).alias("is_alert"),
        R.alert_type(risk).alias("alert_type"),
    )


@query(
    "demographic_derive",
    over_sources(
        f"""select province, population, area_km2, urban_pct, poverty_index,
        {r('population/area_km2', 4)} as population_density_km2,
        {r('100-poverty_index*0.6', 4)} as sanitation_index from demo"""
    ),
)
def demographic_derive(spark, sf):
    return A.derive_demographics(B.demographics(spark, sf), digits=4)


@query(
    "cyclic_features",
    over_panel(
        f"""select province, cast(date as varchar) as date,
        {r('sin(2*pi()*week/52)', 4)} as week_sin, {r('cos(2*pi()*week/52)', 4)} as week_cos,
        {r('sin(2*pi()*month/12)', 4)} as month_sin, {r('cos(2*pi()*month/12)', 4)} as month_cos,
        month, cast(week between 18 and 44 as int) as is_rainy_season from panel"""
    ),
)
def cyclic_features(spark, sf):
    made = T.temporal_features(F.col("week"), F.col("date"))
    waves = [half_up(made[c], 4).alias(c) for c in ("week_sin", "week_cos", "month_sin", "month_cos")]
    return B.climate_weeks(spark, sf).select(
        "province", text("date"), *waves, made["month"].alias("month"),
        made["is_rainy_season"].alias("is_rainy_season"),
    )


@query(
    "epi_week",
    """select cast(d as varchar) as day, cast(extract(isoyear from d) as int) as iso_year,
    cast(extract(week from d) as int) as iso_week, cast(date_trunc('week', d) as date)::varchar as week_start
    from (select distinct cast(l_shipdate as date) as d from lineitem)""",
)
def epi_week(spark, sf):
    day = B.table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("day")).distinct()
    d = F.col("day")
    return day.select(
        text("day"), T.iso_year(d).alias("iso_year"), T.iso_week(d).alias("iso_week"),
        T.week_start(d).cast("string").alias("week_start"),
    )


_JAN1 = "make_date(year, 1, 1)"
_JAN4 = "make_date(year, 1, 4)"


@query(
    "week_to_date",
    over_sources(
        f"""select year, week,
        ({_JAN1} + cast((8 - isodow({_JAN1})) % 7 + 7*(week-1) as int))::varchar as first_monday_date,
        ({_JAN4} - cast(isodow({_JAN4}) - 1 as int) + cast(7*(week-1) as int))::varchar as iso_date,
        ({_JAN4} - cast(isodow({_JAN4}) - 1 as int) + cast(7*(week-1) as int) + 28)::varchar as forecast_date
        from (select distinct year, week from climate)"""
    ),
)
def week_to_date(spark, sf):
    weeks = B.climate_weeks(spark, sf).select("year", "week").distinct()
    y, w = F.col("year"), F.col("week")
    iso = T.iso_week_to_date(y, w)
    return weeks.select(
        "year", "week", T.week_to_date(y, w).cast("string").alias("first_monday_date"),
        iso.cast("string").alias("iso_date"),
        T.forecast_date(iso, F.lit(4)).cast("string").alias("forecast_date"),
    )


@query(
    "align_schema",
    over_panel(
        """select cases, 0.0::double as wind_gust_kmh, outbreak_risk_index, year, 0.0::double as soil_moisture
        from panel"""
    ),
)
def align(spark, sf):
    wanted = ["cases", "wind_gust_kmh", "outbreak_risk_index", "year", "soil_moisture"]
    return align_schema(B.panel(spark, sf), wanted)


_DIM = """dim as (select n_name as province, 'RD' || lpad(cast(n_nationkey+1 as varchar), 2, '0') as province_code,
  floor((18.0+n_nationkey*0.07)*1e2+0.5+1e-6)/1e2 as latitude,
  floor((-72.0+n_nationkey*0.12)*1e2+0.5+1e-6)/1e2 as longitude, n_regionkey from nation)"""


@query(
    "entity_lookup",
    over_sources(
        """select k.province, coalesce(d.province_code, 'RD00') as province_code,
        coalesce(d.latitude, 18.7) as latitude, coalesce(d.longitude, -70.2) as longitude,
        cast(sum(k.cases) as bigint) as cases
        from cases k left join (select dim.* from dim join region on n_regionkey = r_regionkey
          where r_name <> 'EUROPE') d using (province) group by 1, 2, 3, 4""",
        _DIM,
    ),
)
def entity_lookup(spark, sf):
    """Entities of one region are left out of the dimension and get the defaults."""
    known = B.region_nations(spark, sf, F.col("r_name") != "EUROPE")
    dim = B.entity_dim(spark, sf).join(known, "province", "left_semi")
    totals = B.case_weeks(spark, sf).groupBy("province").agg(F.sum("cases").alias("cases"))
    return A.with_entity_lookup(totals, dim).select(
        "province", "province_code", "latitude", "longitude", "cases"
    )


@query(
    "entity_list",
    "select n_name as province, 'RD' || lpad(cast(n_nationkey+1 as varchar), 2, '0') as province_code, "
    "cast((select count(*) from nation) as bigint) as total from nation",
)
def entity_list(spark, sf):
    from panelcast.operators.reports import with_envelope

    dim = B.entity_dim(spark, sf).select("province", "province_code")
    return with_envelope(dim, dim.agg(F.count(F.lit(1)).alias("total"))).orderBy("province")


@query(
    "normalize_entity",
    """select raw, n_name as province, cast(count(*) as bigint) as n from (
      select case when user_id % 2 = 0 then '  nation_' || (user_id % 30) || ' ' else 'NATION_' || (user_id % 30) end as raw
      from events) left join nation on lower(trim(raw)) = lower(n_name) group by 1, 2""",
)
def normalize_entity(spark, sf):
    number = (F.col("user_id") % 30).cast("string")
    raw = F.when(
        F.col("user_id") % 2 == 0, F.concat(F.lit("  nation_"), number, F.lit(" "))
    ).otherwise(F.concat(F.lit("NATION_"), number))
    uploads = B.table(spark, sf, "events").select(raw.alias("raw"))
    counted = uploads.groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    return A.normalize_entity(counted, B.entity_dim(spark, sf).select("province"), "raw").select(
        "raw", "province", "n"
    )


@query(
    "display_labels",
    over_panel(
        f"""select province, cast(date as varchar) as date, level,
        case level when 'Bajo' then '#28a745' when 'Moderado' then '#ffc107' when 'Alto' then '#fd7e14'
          when 'Epidemia' then '#dc3545' else '#6f0000' end as color,
        case level when 'Bajo' then '🟢' when 'Moderado' then '🟡' when 'Alto' then '🟠'
          when 'Epidemia' then '🔴' else '⚫' end as emoji,
        '<span style="background:' || case level when 'Bajo' then '#28a745' when 'Moderado' then '#ffc107'
          when 'Alto' then '#fd7e14' when 'Epidemia' then '#dc3545' else '#6f0000' end
          || ';color:white;padding:2px 8px;border-radius:4px;">' || replace(level, 'Critico', 'Crítico')
          || ' (' || printf('%.1f', {r('risk', 1)}) || ')</span>' as badge,
        case when population >= 1000000 then printf('%.1f', {r('population/1e6', 1)}) || 'M'
          when population >= 1000 then printf('%.1f', {r('population/1e3', 1)}) || 'K'
          else printf('%.1f', {r('population', 1)}) end as population_text,
        replace(province, 'NATION_', 'N. ') as short_name, split_part(province, ' ', 1) as first_token
        from (select *, outbreak_risk_index as risk, {risk_class('outbreak_risk_index')} as level from panel)"""
    ),
)
def display_labels(spark, sf):
    risk = F.col("outbreak_risk_index")
    df = B.panel(spark, sf).withColumn("level", R.risk_class(risk))
    level = F.col("level")
    return df.select(
        "province", text("date"), "level", L.color(level).alias("color"), L.emoji(level).alias("emoji"),
        L.badge(risk, level).alias("badge"), L.short_number(F.col("population")).alias("population_text"),
        L.short_name(F.col("province"), {"NATION_": "N. "}).alias("short_name"),
        L.first_token(F.col("province")).alias("first_token"),
    )
