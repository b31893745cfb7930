"""Forecast post-processing on member forecasts that SQL can compute too.

Member ``rf`` is the mean of an entity's last four risk values for every
horizon; member ``mlp`` repeats its last four values in order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.catalog import bindings as B
from panelcast.catalog.registry import query
from panelcast.catalog.sql import over_panel, r, risk_class
from panelcast.functions.numeric import half_up
from panelcast.operators import forecast as O
from panelcast.operators.evaluate import (
    accuracy_from_mae,
    accuracy_from_r2,
    ensemble_accuracy,
    fold_summary,
    horizon_mean,
    regression_metrics,
    retrain_gate,
)
from panelcast.operators.split import fold_sizes, time_split
from panelcast.operators.validate import forecast_rules, with_failures
from panelcast.operators.windows import tail_rows, target_columns
from panelcast.session import materialized

text = lambda c: F.col(c).cast("string").alias(c)
RISK = "outbreak_risk_index"

FORECAST_SQL = f"""
back as (select province, date, outbreak_risk_index as risk,
  row_number() over (partition by province order by date desc) as b from panel),
members as (select h as horizon, province, (select avg(x.risk) from back x where x.province = e.province and x.b <= 4) as rf,
  (select x.risk from back x where x.province = e.province and x.b = 5 - h) as mlp
  from (select distinct province from panel) e cross join (select cast(unnest(generate_series(1, 4)) as int) as h)),
present as (select province, horizon, rf, case when r_name <> 'AMERICA' then mlp end as mlp
  from members join nation on n_name = province join region on n_regionkey = r_regionkey),
combined as (select *, least(greatest((0.6*coalesce(rf, 0) + 0.4*coalesce(mlp, 0)) /
  (case when rf is null then 0 else 0.6 end + case when mlp is null then 0 else 0.4 end), 0), 100) as ensemble from present),
wide as (select province, {', '.join(f"max(ensemble) filter (where horizon = {h}) as e{h}, max(rf) filter (where horizon = {h}) as a{h}, max(mlp) filter (where horizon = {h}) as b{h}" for h in range(1, 5))}
  from combined group by province),
f as (select *, {', '.join(f"{r(f'e{h}', 2)} as w{h}" for h in range(1, 5))},
  greatest(e1, e2, e3, e4) as peak, (e1*-1.5 + e2*-0.5 + e3*0.5 + e4*1.5)/5 as slope from wide),
forecast as (select *, w1 as risk_index, {risk_class('w1')} as risk_level, {r('peak', 2)} as peak_risk,
  cast(case peak when e1 then 1 when e2 then 2 when e3 then 3 else 4 end as int) as peak_week,
  case when slope > 2 then 'Ascendente' when slope < -2 then 'Descendente' else 'Estable' end as trend from f),
run_day as (select max(date) as d from panel),
dim as (select n_name as province, 'RD' || lpad(cast(n_nationkey+1 as varchar), 2, '0') as province_code,
  floor((18.0+n_nationkey*0.07)*1e2+0.5+1e-6)/1e2 as latitude,
  floor((-72.0+n_nationkey*0.12)*1e2+0.5+1e-6)/1e2 as longitude from nation)"""


def over_forecast(select: str) -> str:
    return over_panel(select, FORECAST_SQL.strip())


def members(panel):
    """Long member forecasts from the last four rows of each entity."""
    tail = tail_rows(panel.select("province", "date", RISK), 4)
    horizons = F.explode(F.array(*[F.lit(h) for h in range(1, 5)]))
    rf = tail.groupBy("province").agg(F.avg(RISK).alias("value")).select(
        "province", horizons.alias("horizon"), "value"
    )
    mlp = tail.select(
        "province", (F.lit(5) - F.col("_back")).cast("int").alias("horizon"), F.col(RISK).alias("value")
    )
    return rf, mlp


def combined(spark, sf, panel=None):
    """The second member is missing for the entities of one region."""
    rf, mlp = members(B.stored_panel(spark, sf) if panel is None else panel)
    known = B.region_nations(spark, sf, F.col("r_name") != "AMERICA")
    return O.combine_members({"rf": rf, "mlp": mlp.join(known, "province", "left_semi")})


def forecast(spark, sf, panel=None):
    return O.forecast_struct(combined(spark, sf, panel))


@query(
    "ensemble_combine",
    over_forecast(
        f"""select province, horizon, {r('rf', 4)} as rf, {r('mlp', 4)} as mlp, {r('ensemble', 4)} as ensemble
        from combined"""
    ),
)
def ensemble_combine(spark, sf):
    return combined(spark, sf).select(
        "province", "horizon", *[half_up(c, 4).alias(c) for c in ("rf", "mlp", "ensemble")]
    )


_WEEKS = ", ".join(f"w{h} as week_{h}_forecast" for h in range(1, 5))


@query(
    "forecast_struct",
    over_forecast(
        f"""select province, {', '.join(f'w{h} as week_{h}' for h in range(1, 5))}, risk_index, risk_level, peak_risk,
        peak_week, trend, risk_index >= 65 as is_epidemic, risk_index >= 80 as is_alert from forecast"""
    ),
)
def forecast_struct(spark, sf):
    return forecast(spark, sf).select(
        "province", "forecast.*", "risk_index", "risk_level", "peak_risk", "peak_week", "trend",
        "is_epidemic", "is_alert",
    )


@query("forecast_peak", over_forecast("select province, peak_risk, peak_week from forecast"))
def forecast_peak(spark, sf):
    return forecast(spark, sf).select("province", "peak_risk", "peak_week")


@query(
    "trend_label",
    over_panel(
        """select province, cast(date as varchar) as date, case when slope > 2 then 'Ascendente'
        when slope < -2 then 'Descendente' else 'Estable' end as trend from (
        select province, date, (y1*-1.5 + y2*-0.5 + y3*0.5 + y4*1.5)/5 as slope from (select province, date, """
        + ", ".join(f"lead(outbreak_risk_index, {h}) over w as y{h}" for h in range(1, 5))
        + " from panel window w as (partition by province order by date)) where y4 is not null)"
    ),
)
def trend_label(spark, sf):
    """Trend of the four weeks after every row of the panel."""
    from panelcast.functions.risk import trend_label as label

    panel = B.panel(spark, sf)
    ahead = panel.withColumns(target_columns(B.SPEC.window(panel), RISK)).dropna(subset=["target_week_4"])
    return ahead.select(
        "province", text("date"), label([F.col(f"target_week_{h}") for h in range(1, 5)]).alias("trend")
    )


@query(
    "flatten_forecast",
    over_forecast(
        f"""select province, risk_index, risk_level, {_WEEKS}, peak_risk, peak_week,
        risk_index >= 65 as is_epidemic, trend from forecast"""
    ),
)
def flatten_forecast(spark, sf):
    return O.flatten_forecast(forecast(spark, sf))


_SUMMARY = f"""select province_code, province, latitude, longitude, cast(d as varchar) as prediction_date,
  cast((select max(date) from panel p where p.province = forecast.province) as varchar) as last_data_date,
  risk_index, risk_level, {_WEEKS}, peak_risk, peak_week, trend, risk_index >= 65 as is_epidemic,
  risk_index >= 80 as is_alert, {r('a1', 2)} as rf_week1, {r('b1', 2)} as mlp_week1
  from forecast join dim using (province), run_day"""


def summary(spark, sf, panel=None):
    panel = B.stored_panel(spark, sf) if panel is None else panel
    last = panel.groupBy("province").agg(F.max("date").cast("string").alias("last_data_date"))
    as_of = panel.agg(F.max("date").cast("string")).scalar()
    return O.summary_table(forecast(spark, sf, panel), B.entity_dim(spark, sf), last, as_of)


@query("forecast_summary", over_forecast(_SUMMARY))
def forecast_summary(spark, sf):
    return summary(spark, sf).orderBy(F.desc("risk_index"), "province")


@query(
    "forecast_long",
    over_forecast(
        "\nunion all ".join(
            f"""select province_code, province, cast({h} as int) as forecast_week,
            cast(d + {7 * h} as varchar) as forecast_date, w{h} as risk_index, {r(f'a{h}', 2)} as rf_risk,
            {r(f'b{h}', 2)} as mlp_risk, {risk_class(f'e{h}')} as risk_level
            from forecast join dim using (province), run_day"""
            for h in range(1, 5)
        )
    ),
)
def forecast_long(spark, sf):
    panel = B.stored_panel(spark, sf)
    as_of = panel.agg(F.max("date")).scalar()
    made = O.long_table(forecast(spark, sf, panel), B.entity_dim(spark, sf), as_of)
    return made.withColumn("forecast_date", F.col("forecast_date").cast("string"))


@query(
    "forecast_alerts",
    over_forecast(
        f"""select province_code, province, latitude, longitude, risk_index, risk_level,
        case when risk_index >= 80 then 'Critico' else 'Epidemia' end as alert_type, prediction_date, trend,
        week_2_forecast, week_3_forecast, week_4_forecast from ({_SUMMARY}) where risk_index >= 30"""
    ),
)
def forecast_alerts(spark, sf):
    """The threshold is a parameter; 30 here, as the last weeks end below 65."""
    return O.alert_table(summary(spark, sf), threshold=30.0).orderBy(F.desc("risk_index"), "province")


@query(
    "forecast_series",
    over_forecast(
        f"select province, cast(0 as int) as step, w1 as value, {risk_class('w1')} as level from forecast "
        + " ".join(
            f"union all select province, cast({h} as int), w{h}, {risk_class(f'w{h}')} from forecast"
            for h in range(1, 5)
        )
    ),
)
def forecast_series(spark, sf):
    return O.forecast_series(forecast(spark, sf))


@query(
    "member_band",
    over_forecast(
        "\nunion all ".join(
            f"""select province, cast({h} as int) as forecast_week, least({r(f'a{h}', 2)}, {r(f'b{h}', 2)}) as low,
            greatest({r(f'a{h}', 2)}, {r(f'b{h}', 2)}) as high,
            {r('(select min(least(w1, w2, w3, w4)) - 1 from forecast)', 2)} as axis_min,
            {r('(select max(greatest(w1, w2, w3, w4)) + 1 from forecast)', 2)} as axis_max from forecast"""
            for h in range(1, 5)
        )
    ),
)
def member_band(spark, sf):
    from panelcast.operators.reports import with_envelope

    # One row per entity, read for the axis and for the rows.
    made = materialized(forecast(spark, sf), "forecast")
    axis = O.axis_range(made).select(*[half_up(c, 2).alias(c) for c in ("axis_min", "axis_max")])
    return with_envelope(O.member_band(made), axis)


@query(
    "report_table",
    over_forecast(
        """select province as "Provincia", risk_index as "Riesgo Actual", risk_level as "Nivel", w1 as "Sem. 1",
        w2 as "Sem. 2", w3 as "Sem. 3", w4 as "Sem. 4", trend as "Tendencia", risk_index >= 65 as "Epidemia"
        from forecast"""
    ),
)
def report_table(spark, sf):
    return O.report_table(O.flatten_forecast(forecast(spark, sf)))


@query(
    "forecast_checks",
    over_forecast(
        """select province, not (w1 between 0 and 40) as over_40, peak_week between 1 and 4 as peak_ok from forecast"""
    ),
)
def forecast_checks(spark, sf):
    """Response ranges, and a narrower range that some rows do break."""
    flat = O.flatten_forecast(forecast(spark, sf))
    weeks = [f"week_{h}_forecast" for h in range(1, 5)]
    rules = forecast_rules(weeks, "peak_week") | {"narrow": F.col("week_1_forecast").between(0, 40)}
    failed = F.col("failed")
    return with_failures(flat, rules).select(
        "province", F.array_contains(failed, "narrow").alias("over_40"),
        (~F.array_contains(failed, "peak_week_range")).alias("peak_ok"),
    )


_EVAL = """
shifted as (select province, date, """ + ", ".join(
    f"lead(outbreak_risk_index, {h}) over w as y{h}" for h in range(1, 5)
) + """, avg(outbreak_risk_index) over (w rows between 3 preceding and current row) as mean4, outbreak_risk_index as hold
  from panel window w as (partition by province order by date)),
scored as (""" + " union all ".join(
    f"select 'mean4' as member, cast({h} as int) as horizon, date, y{h} as actual, mean4 as predicted from shifted "
    f"union all select 'hold', cast({h} as int), date, y{h}, hold from shifted"
    for h in range(1, 5)
) + """),
metrics as (select member, horizon, count(*) as n, avg(abs(actual-predicted)) as mae,
  sqrt(avg((actual-predicted)*(actual-predicted))) as rmse,
  1 - sum((actual-predicted)*(actual-predicted)) / (var_pop(actual)*count(*)) as r2
  from scored where actual is not null group by 1, 2)"""


def scored(spark, sf):
    """Two simple forecasts of every row against what came."""
    panel = B.panel(spark, sf)
    w = B.SPEC.window(panel)
    made = panel.select(
        "province", "date",
        *[c.alias(n) for n, c in target_columns(w, RISK).items()],
        F.avg(RISK).over(w.rowsBetween(-3, 0)).alias("mean4"),
        F.col(RISK).alias("hold"),
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(m).alias("member"), F.lit(h).alias("horizon"),
                F.col(f"target_week_{h}").alias("actual"), F.col(m).alias("predicted"),
            )
            for h in range(1, 5)
            for m in ("mean4", "hold")
        ]
    )
    return made.select("province", "date", F.explode(cells).alias("c")).select("province", "date", "c.*")


@query(
    "eval_metrics",
    over_panel(
        f"""select m.member, horizon, n, {r('mae', 4)} as mae, {r('rmse', 4)} as rmse, {r('r2', 4)} as r2,
        {r('greatest(100-mae, 0)', 4)} as accuracy_mae, {r('greatest(100*r2, 0)', 4)} as accuracy_r2,
        {r('mean_mae', 4)} as mean_mae, {r('mae_std', 4)} as mae_std
        from metrics m join (select member, avg(mae) as mean_mae, stddev_pop(mae) as mae_std from metrics group by 1) s
        on s.member = m.member""",
        _EVAL.strip(),
    ),
)
def eval_metrics(spark, sf):
    per = regression_metrics(scored(spark, sf), ["member", "horizon"])
    over = fold_summary(per, ["member"]).select(
        "member", F.col("cv_mae").alias("mean_mae"), F.col("cv_mae_std").alias("mae_std")
    )
    made = per.join(over, "member").withColumns(
        {"accuracy_mae": accuracy_from_mae(F.col("mae")), "accuracy_r2": accuracy_from_r2(F.col("r2"))}
    )
    digits = ("mae", "rmse", "r2", "accuracy_mae", "accuracy_r2", "mean_mae", "mae_std")
    return made.select("member", "horizon", "n", *[half_up(c, 4).alias(c) for c in digits])


@query(
    "ensemble_accuracy",
    over_panel(
        f"""select {r('sum(a*w)/sum(w)', 4)} as ensemble_accuracy from (select member,
        greatest(100-avg(mae), 0) as a, case member when 'mean4' then 0.6 else 0.4 end as w from metrics group by 1)""",
        _EVAL.strip(),
    ),
)
def ensemble_accuracy_query(spark, sf):
    per = regression_metrics(scored(spark, sf), ["member", "horizon"])
    scores = horizon_mean(per, ["member"]).select(
        "member", accuracy_from_mae(F.col("mae")).alias("accuracy")
    )
    made = ensemble_accuracy(scores, {"mean4": 0.6, "hold": 0.4})
    return made.select(half_up("ensemble_accuracy", 4).alias("ensemble_accuracy"))


@query(
    "retrain_gate",
    over_panel(
        f"""select member, cast(year as int) as year, {r('accuracy', 4)} as accuracy,
        accuracy < 0.94 as retrain from (
        select member, year(date) as year, greatest(100-avg(abs(actual-predicted)), 0)/100 as accuracy,
        row_number() over (partition by member order by year(date) desc) as rn
        from scored where actual is not null group by 1, 2) where rn = 1""",
        _EVAL.strip(),
    ),
)
def retrain_gate_query(spark, sf):
    """Yearly accuracy per member; the latest year decides."""
    yearly = regression_metrics(scored(spark, sf).withColumn("year", F.year("date")), ["member", "year"])
    scores = yearly.select("member", "year", (accuracy_from_mae(F.col("mae")) / 100).alias("accuracy"))
    made = retrain_gate(scores, "member", "year", "accuracy", threshold=0.94)
    return made.select("member", "year", half_up("accuracy", 4).alias("accuracy"), "retrain")


_SPLIT = """dates as (select date, row_number() over (order by date) - 1 as i, count(*) over () as n
  from (select distinct date from panel))"""


@query(
    "time_split",
    over_panel(
        """select split, count(*) as n, cast(min(date) as varchar) as first_date, cast(max(date) as varchar) as last_date
        from (select p.date, case when i < n - floor(n*0.15) - floor(n*0.15) then 'train'
          when i < n - floor(n*0.15) then 'val' else 'test' end as split from panel p join dates using (date))
        group by 1""",
        _SPLIT,
    ),
)
def time_split_query(spark, sf):
    made = time_split(B.panel(spark, sf))
    return made.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("date").cast("string").alias("first_date"),
        F.max("date").cast("string").alias("last_date"),
    )


@query(
    "row_split",
    over_panel(
        """select province, split, count(*) as n from (select province,
        case when i < n - floor(n*0.15) - floor(n*0.15) then 'train'
          when i < n - floor(n*0.15) then 'val' else 'test' end as split
        from (select province, row_number() over (order by province, date) - 1 as i, count(*) over () as n from panel))
        group by 1, 2"""
    ),
)
def row_split(spark, sf):
    made = time_split(B.panel(spark, sf), mode="row")
    return made.groupBy("province", "split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ts_folds",
    over_panel(
        """select cast(fold as int) as fold, cast(min(date) filter (where i = s) as varchar) as test_start,
        cast(max(date) filter (where i = s + z - 1) as varchar) as test_end,
        cast(sum(c) filter (where i < s) as bigint) as train_rows,
        cast(sum(c) filter (where i >= s and i < s + z) as bigint) as test_rows
        from (select f as fold, n // 6 as z, n - (5 - f + 1) * (n // 6) as s, date, i,
          (select count(*) from panel p where p.date = dates.date) as c
          from dates cross join (select unnest(generate_series(1, 5)) as f)) group by fold""",
        _SPLIT,
    ),
)
def ts_folds(spark, sf):
    return fold_sizes(B.panel(spark, sf)).select(
        "fold", text("test_start"), text("test_end"), "train_rows", "test_rows"
    )
