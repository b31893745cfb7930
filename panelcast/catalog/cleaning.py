"""Cleaning, scaling, imputation and the whole feature pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.catalog import bindings as B
from panelcast.catalog.registry import query
from panelcast.catalog.sql import over_panel, r
from panelcast.functions.numeric import half_up
from panelcast.operators import cleaning as C
from panelcast.operators.impute import KnnImputer
from panelcast.operators.scaling import apply_ranges, fit_ranges, inverse
from panelcast.operators.windows import (
    LAG_COLUMNS,
    LAGS,
    ROLLING_COLUMNS,
    ROLLING_WINDOWS,
    lag_columns,
)
from panelcast.plans.features import FeaturePipeline
from panelcast.session import materialized

text = lambda c: F.col(c).cast("string").alias(c)

UPLOADS_SQL = """uploads as (select event_id, 'NATION_' || (user_id % 30) as province,
  cast(year(ts) as int) as year, cast(regexp_extract(props, '[0-9]+') as int) as week,
  cast(floor(value) - 5 as bigint) as cases, ts from events)"""


def uploads(spark, sf):
    """Upload rows derived from events; some break rules, some repeat a key."""
    return B.table(spark, sf, "events").select(
        "event_id",
        F.concat(F.lit("NATION_"), (F.col("user_id") % 30).cast("string")).alias("province"),
        F.year("ts").alias("year"),
        F.from_json("props", "k int")["k"].alias("week"),
        (F.floor("value") - 5).alias("cases"),
        "ts",
    )


@query(
    "dedup_first",
    f"""with {UPLOADS_SQL} select province, year, week, event_id, cases from (
    select *, row_number() over (partition by province, year, week order by ts, event_id) as rn from uploads)
    where rn = 1""",
)
def dedup_first(spark, sf):
    kept = C.dedup_first(uploads(spark, sf), B.SPEC.key, ["ts", "event_id"])
    return kept.select("province", "year", "week", "event_id", "cases")


@query(
    "dedup_summary",
    f"""with {UPLOADS_SQL}, k as (select count(*) as n from uploads group by province, year, week)
    select cast(sum(n) as bigint) as rows_in, count(*) as rows_kept,
    cast(sum(n) - count(*) as bigint) as rows_removed from k""",
)
def dedup_summary(spark, sf):
    return C.dedup_summary(uploads(spark, sf), B.SPEC.key)


@query(
    "clip_negative",
    over_panel(
        """select p.province, cast(p.date as varchar) as date,
        case when enso_index < 0 then 0 else enso_index end as enso_index, cases, humidity_pct from panel p"""
    ),
)
def clip_negative(spark, sf):
    """Parity form: the centred index is clipped too."""
    clipped = C.clip_negative(B.panel(spark, sf), exclude=())
    return clipped.select("province", text("date"), "enso_index", "cases", "humidity_pct")


_CAPS = """caps as (select quantile_cont(cases, 0.995) as cap_cases,
  quantile_cont(rainfall_mm, 0.995) as cap_rain, quantile_cont(incidence_rate_100k, 0.995) as cap_inc from panel)"""


@query(
    "winsorize",
    over_panel(
        f"""select province, cast(date as varchar) as date, {r('least(cases, cap_cases)', 4)} as cases,
        {r('least(rainfall_mm, cap_rain)', 4)} as rainfall_mm,
        {r('least(incidence_rate_100k, cap_inc)', 4)} as incidence_rate_100k from panel, caps""",
        _CAPS,
    ),
)
def winsorize(spark, sf):
    panel = materialized(B.panel(spark, sf), "panel")
    capped = C.apply_caps(panel, C.fit_caps(panel))
    return capped.select(
        "province", text("date"), *[half_up(c, 4).alias(c) for c in C.WINSOR_COLUMNS]
    )


@query(
    "null_profile",
    over_panel(
        f"""select "column", {r('null_pct', 4)} as null_pct from (
        select 'enso_index' as "column", avg(cast(enso_index is null as int))*100 as null_pct from lagged
        union all select 'cases_lag1w', avg(cast(cases_lag1w is null as int))*100 from lagged
        union all select 'cases_lag12w', avg(cast(cases_lag12w is null as int))*100 from lagged) where null_pct > 0""",
        """lagged as (select *, lag(cases, 1) over w as cases_lag1w, lag(cases, 12) over w as cases_lag12w
        from panel window w as (partition by province order by date))""",
    ),
)
def null_profile(spark, sf):
    panel = B.panel(spark, sf)
    lagged = panel.withColumns(lag_columns(B.SPEC.window(panel), ["cases"], (1, 12)))
    return C.null_profile(lagged).select("column", half_up("null_pct", 4).alias("null_pct"))


def _scaled_sql(c: str) -> str:
    return r(
        f"({c}-(select min({c}) from panel))/(select case when max({c})=min({c}) then 1 else max({c})-min({c}) end from panel)",
        4,
    )


SCALED = ("cases", "rainfall_mm", "temp_avg_c", "humidity_pct", "population", "area_km2")


@query(
    "minmax_scale",
    over_panel(
        "select province, cast(date as varchar) as date, "
        + ", ".join(f"{_scaled_sql(c)} as {c}" for c in SCALED)
        + " from panel"
    ),
)
def minmax_scale(spark, sf):
    panel = materialized(B.panel(spark, sf), "panel")
    scaled = apply_ranges(panel, fit_ranges(panel, list(SCALED)))
    return scaled.select("province", text("date"), *[half_up(c, 4).alias(c) for c in SCALED])


@query(
    "inverse_scale",
    over_panel(
        f"select province, cast(date as varchar) as date, {r('outbreak_risk_index', 4)} as risk from panel"
    ),
)
def inverse_scale(spark, sf):
    """Scale the target, then back: the original again."""
    panel = materialized(B.panel(spark, sf), "panel")
    ranges = fit_ranges(panel, [B.SPEC.target])
    back = inverse(F.col(B.SPEC.target), *ranges[B.SPEC.target])
    return apply_ranges(panel, ranges).select("province", text("date"), half_up(back, 4).alias("risk"))


KNN_COLUMNS = ["rainfall_mm", "humidity_pct", "temp_avg_c", "cases", "enso_index", "cases_lag12w"]


def _knn_sql() -> str:
    gap = " + ".join(f"coalesce((q.{c}-d.{c})*(q.{c}-d.{c}), 0)" for c in KNN_COLUMNS)
    known = " + ".join(f"cast((q.{c}-d.{c}) is not null as int)" for c in KNN_COLUMNS)
    tie = ", ".join(f"d.{c} nulls first" for c in KNN_COLUMNS)
    parts = []
    for t in ("enso_index", "cases_lag12w"):
        parts.append(
            f"""near_{t} as (select province, date, sum(v)/count(*) as {t} from (
            select q.province, q.date, d.{t} as v, row_number() over (partition by q.province, q.date
              order by sqrt({float(len(KNN_COLUMNS))}/({known})*({gap})), {tie}) as rn
            from x q, x d where q.{t} is null and d.{t} is not null) where rn <= 5 group by 1, 2)"""
        )
    cast = ", ".join(f"cast({c} as double) as {c}" for c in KNN_COLUMNS if c != "cases_lag12w")
    return over_panel(
        f"""select x.province, cast(x.date as varchar) as date,
        {r('coalesce(x.enso_index, a.enso_index)', 4)} as enso_index,
        {r('coalesce(x.cases_lag12w, b.cases_lag12w)', 4)} as cases_lag12w
        from x left join near_enso_index a using (province, date) left join near_cases_lag12w b using (province, date)""",
        f"""x as (select province, date, {cast},
        cast(lag(cases, 12) over (partition by province order by date) as double) as cases_lag12w from panel),
        """
        + ",\n".join(parts),
    )


@query("knn_impute", _knn_sql())
def knn_impute(spark, sf):
    """Two columns with natural gaps, filled from the whole panel."""
    panel = B.panel(spark, sf)
    lagged = panel.withColumns(lag_columns(B.SPEC.window(panel), ["cases"], (12,)))
    base = materialized(lagged.select("province", "date", *KNN_COLUMNS), "knn")
    filled = KnnImputer(KNN_COLUMNS).fit(base).transform(base, ["province", "date"])
    return filled.select(
        "province", text("date"), *[half_up(c, 4).alias(c) for c in ("enso_index", "cases_lag12w")]
    )


def _pipeline_sql() -> str:
    base = [
        "rainfall_mm", "temp_max_c", "temp_min_c", "temp_avg_c", "humidity_pct", "wind_speed_kmh", "enso_index",
        "cases", "deaths", "population", "area_km2", "urban_pct", "poverty_index", "incidence_rate_100k",
    ]
    lags = {f"{c}_lag{k}w": f"lag({c}, {k}) over w" for c in LAG_COLUMNS for k in LAGS}
    rolls = {}
    for c in ROLLING_COLUMNS:
        for n in ROLLING_WINDOWS:
            rolls[f"{c}_roll{n}w_mean"] = f"avg({c}) over (w rows between {n-1} preceding and current row)"
            rolls[f"{c}_roll{n}w_std"] = (
                f"coalesce(stddev_samp({c}) over (w rows between {n-1} preceding and current row), 0)"
            )
    waves = {
        "week_sin": "sin(2*pi()*week/52)", "week_cos": "cos(2*pi()*week/52)",
        "is_rainy_season": "cast(week between 18 and 44 as int)",
        "month_sin": "sin(2*pi()*month/12)", "month_cos": "cos(2*pi()*month/12)",
    }
    made = lags | rolls | waves
    columns = base + list(made)
    features = ", ".join(f"{x} as {n}" for n, x in made.items())
    stats = ", ".join(f"avg({c}) as a_{c}, min({c}) as lo_{c}, max({c}) as hi_{c}" for c in columns)
    out = ", ".join(
        r(f"(coalesce({c}, a_{c}) - lo_{c}) / case when hi_{c} = lo_{c} then 1 else hi_{c} - lo_{c} end", 4)
        + f" as {c}"
        for c in columns
    )
    t = "outbreak_risk_index"
    return over_panel(
        f"""select province, cast(date as varchar) as date, year, week, month,
        {r(f'({t} - lo_t) / (hi_t - lo_t)', 4)} as {t}, {out} from features, stats""",
        f"""{_CAPS},
        capped as (select p.* replace (least(cases, cap_cases) as cases, least(rainfall_mm, cap_rain) as rainfall_mm,
          least(incidence_rate_100k, cap_inc) as incidence_rate_100k) from panel p, caps),
        features as (select *, {features} from capped window w as (partition by province order by date)),
        stats as (select {stats}, min({t}) as lo_t, max({t}) as hi_t from features)""",
    )


@query("feature_pipeline", _pipeline_sql())
def feature_pipeline(spark, sf):
    """Fit and transform with the mean imputer: all features, scaled."""
    panel = materialized(B.panel(spark, sf), "panel")
    model = FeaturePipeline(B.SPEC).fit(panel)
    made = model.transform(panel)
    columns = [B.SPEC.target, *model.feature_columns()]
    return made.select(
        "province", text("date"), "year", "week", "month", *[half_up(c, 4).alias(c) for c in columns]
    )
