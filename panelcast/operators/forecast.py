"""Member forecasts, their combination, and the tables read off a forecast.

A member forecast is long: one row per (entity, horizon) with a value on the
0-100 scale. The combined forecast is one row per entity with a struct.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions import risk as R
from panelcast.functions.numeric import clamp, half_up
from panelcast.functions.temporal import forecast_date
from panelcast.operators.assemble import with_entity_lookup
from panelcast.spec import PanelSpec

# Member weights, horizon, columns and labels of the exports.
WEIGHTS = {"rf": 0.6, "mlp": 0.4}
HORIZON = 4
HISTORY_COLUMNS = (
    "province", "date", "year", "week", "month",
    "cases", "deaths", "incidence_rate_100k", "outbreak_risk_index",
    "rainfall_mm", "temp_avg_c", "humidity_pct",
    "population", "urban_pct", "poverty_index",
)
REPORT_LABELS = {
    "province": "Provincia", "risk_index": "Riesgo Actual", "risk_level": "Nivel",
    "week_1_forecast": "Sem. 1", "week_2_forecast": "Sem. 2",
    "week_3_forecast": "Sem. 3", "week_4_forecast": "Sem. 4",
    "trend": "Tendencia", "is_epidemic": "Epidemia",
}


def check_weights(weights: Mapping[str, float]) -> None:
    if abs(sum(weights.values()) - 1.0) > 1e-6:
        raise ValueError("ensemble weights must sum to 1")


def combine_members(
    members: Mapping[str, DataFrame],
    weights: Mapping[str, float] = WEIGHTS,
    spec: PanelSpec = PanelSpec(),
) -> DataFrame:
    """Weighted mean over the members present for an (entity, horizon).

    Full outer joins of the members; an aggregate over their union would be
    shorter, but the engine then may take the union as already grouped.
    Output: horizon, one column per member, ``ensemble`` limited to 0-100.
    """
    check_weights(weights)
    key, combined = [spec.entity, "horizon"], None
    for name, df in members.items():
        value = F.col("value").cast("double")
        one = df.where(value.isNotNull()).groupBy(*key).agg(F.max(value).alias(name))
        combined = one if combined is None else combined.join(one, key, "full")
    weighted = [F.coalesce(F.col(n) * F.lit(float(weights[n])), F.lit(0.0)) for n in members]
    present = [F.when(F.col(n).isNotNull(), F.lit(float(weights[n]))).otherwise(F.lit(0.0)) for n in members]
    mean = F.try_divide(sum(weighted[1:], weighted[0]), sum(present[1:], present[0]))
    return combined.withColumn("ensemble", clamp(mean, 0.0, 100.0))


def forecast_struct(
    combined: DataFrame, spec: PanelSpec = PanelSpec(), horizon: int = HORIZON
) -> DataFrame:
    """One row per entity: ``week_1..`` struct, current risk, class, peak, trend, flags."""
    names = [c for c in combined.columns if c not in (spec.entity, "horizon")]
    wide = combined.groupBy(spec.entity).agg(
        *[
            F.max(F.when(F.col("horizon") == h, F.col(n))).alias(f"{n}_{h}")
            for n in names
            for h in range(1, horizon + 1)
        ]
    )
    raw = [F.col(f"ensemble_{h}") for h in range(1, horizon + 1)]
    values = [half_up(x, 2) for x in raw]
    peak = F.array_max(F.array(*raw))
    current = values[0]
    members = [n for n in names if n != "ensemble"]
    return wide.select(
        spec.entity,
        F.struct(*[v.alias(f"week_{h}") for h, v in enumerate(values, 1)]).alias("forecast"),
        current.alias("risk_index"),
        R.risk_class(current).alias("risk_level"),
        half_up(peak, 2).alias("peak_risk"),
        F.array_position(F.array(*raw), peak).cast("int").alias("peak_week"),
        R.trend_label(raw).alias("trend"),
        R.is_epidemic(current).alias("is_epidemic"),
        R.is_alert(current).alias("is_alert"),
        *[
            F.struct(
                *[half_up(f"{m}_{h}", 2).alias(f"week_{h}") for h in range(1, horizon + 1)]
            ).alias(f"{m}_forecast")
            for m in members
        ],
        F.array(*[R.risk_class(x) for x in raw]).alias("week_levels"),
    )


def flatten_forecast(forecast: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """The eleven export columns of a prediction."""
    return forecast.select(
        spec.entity, "risk_index", "risk_level",
        *[F.col(f"forecast.week_{h}").alias(f"week_{h}_forecast") for h in range(1, HORIZON + 1)],
        "peak_risk", "peak_week", "is_epidemic", "trend",
    )


def summary_table(
    forecast: DataFrame,
    dim: DataFrame,
    last_dates: DataFrame,
    as_of: Column,
    spec: PanelSpec = PanelSpec(),
) -> DataFrame:
    """The nineteen-column summary, one row per entity."""
    joined = with_entity_lookup(forecast, dim, spec).join(last_dates, spec.entity, "left")
    return joined.select(
        "province_code", spec.entity, "latitude", "longitude",
        as_of.alias("prediction_date"), "last_data_date",
        "risk_index", "risk_level",
        *[F.col(f"forecast.week_{h}").alias(f"week_{h}_forecast") for h in range(1, HORIZON + 1)],
        "peak_risk", "peak_week", "trend", "is_epidemic", "is_alert",
        F.col("rf_forecast.week_1").alias("rf_week1"),
        F.col("mlp_forecast.week_1").alias("mlp_week1"),
    )


def long_table(
    forecast: DataFrame, dim: DataFrame, as_of: Column, spec: PanelSpec = PanelSpec()
) -> DataFrame:
    """One row per entity and horizon with the member values and the class."""
    weeks = F.array(
        *[
            F.struct(
                F.lit(h).alias("forecast_week"),
                F.col(f"forecast.week_{h}").alias("risk_index"),
                F.col(f"rf_forecast.week_{h}").alias("rf_risk"),
                F.col(f"mlp_forecast.week_{h}").alias("mlp_risk"),
                F.col("week_levels")[h - 1].alias("risk_level"),
            )
            for h in range(1, HORIZON + 1)
        ]
    )
    return (
        with_entity_lookup(forecast, dim, spec)
        .select("province_code", spec.entity, F.explode(weeks).alias("w"))
        .select(
            "province_code", spec.entity, "w.forecast_week",
            forecast_date(as_of, F.col("w.forecast_week")).alias("forecast_date"),
            "w.risk_index", "w.rf_risk", "w.mlp_risk", "w.risk_level",
        )
    )


def alert_table(summary: DataFrame, threshold: float = R.EPIDEMIC_THRESHOLD) -> DataFrame:
    """The twelve alert columns of summary rows at or above ``threshold``."""
    return summary.where(F.col("risk_index") >= F.lit(threshold)).select(
        "province_code", "province", "latitude", "longitude", "risk_index", "risk_level",
        R.alert_type(F.col("risk_index")).alias("alert_type"),
        "prediction_date", "trend",
        "week_2_forecast", "week_3_forecast", "week_4_forecast",
    )


def forecast_series(forecast: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Current value and forecast weeks as points, each with its class."""
    points = F.array(
        F.struct(F.lit(0).alias("step"), F.col("risk_index").alias("value")),
        *[
            F.struct(F.lit(h).alias("step"), F.col(f"forecast.week_{h}").alias("value"))
            for h in range(1, HORIZON + 1)
        ],
    )
    return (
        forecast.select(spec.entity, F.explode(points).alias("p"))
        .select(spec.entity, "p.step", "p.value")
        .withColumn("level", R.risk_class(F.col("value")))
    )


def member_band(forecast: DataFrame, members=("rf", "mlp"), spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Lower and upper member value per horizon."""
    a, b = members
    cells = F.array(
        *[
            F.struct(
                F.lit(h).alias("forecast_week"),
                F.least(f"{a}_forecast.week_{h}", f"{b}_forecast.week_{h}").alias("low"),
                F.greatest(f"{a}_forecast.week_{h}", f"{b}_forecast.week_{h}").alias("high"),
            )
            for h in range(1, HORIZON + 1)
        ]
    )
    return forecast.select(spec.entity, F.explode(cells).alias("c")).select(spec.entity, "c.*")


def axis_range(forecast: DataFrame) -> DataFrame:
    """Smallest value - 1 and largest + 1 over all forecast weeks."""
    weeks = [F.col(f"forecast.week_{h}") for h in range(1, HORIZON + 1)]
    return forecast.agg(
        (F.min(F.least(*weeks)) - 1.0).alias("axis_min"),
        (F.max(F.greatest(*weeks)) + 1.0).alias("axis_max"),
    )


def report_table(flat: DataFrame, labels: Mapping[str, str] = REPORT_LABELS) -> DataFrame:
    return flat.select(*[F.col(c).alias(label) for c, label in labels.items()])
