"""Batch scoring: every entity in one distributed job per member."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators import forecast as O
from panelcast.operators.reports import risk_bands
from panelcast.operators.cleaning import dedup_first, ensure_date
from panelcast.operators.windows import LAGS, ROLLING_WINDOWS, SEQUENCE_LENGTH, latest_row, tail_rows, tail_sequence
from panelcast.plans.features import FeaturePipelineModel, history_export
from panelcast.plans.training import Member, Prepared, prepared_from, with_features
from panelcast.session import materialized
from panelcast.spec import PanelSpec


# Rows that lags and rolling lengths reach back from the first row of a sequence.
REACH = max(*LAGS, *ROLLING_WINDOWS)


def scoring_rows(panel: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """The rows that a forecast depends on: of each entity the last sequence and what its features reach back to.

    Copies of a key count once; the series is limited per entity before the shuffle."""
    rest = [c for c in panel.columns if c not in spec.key]
    once = dedup_first(ensure_date(panel, spec), spec.key, rest)
    return tail_rows(once, SEQUENCE_LENGTH + REACH, spec).drop("_back")


def scoring_table(panel: DataFrame, pipeline: FeaturePipelineModel, spec: PanelSpec = PanelSpec()) -> Prepared:
    """The features of ``scoring_rows`` under a fitted state, written once: what stored members forecast from."""
    ends = date.max
    return prepared_from(pipeline, materialized(pipeline.transform(scoring_rows(panel, spec)), "features"), ends, ends)


def member_forecasts(
    data: Prepared, members: dict[str, Member], spec: PanelSpec = PanelSpec()
) -> dict[str, DataFrame]:
    """Forecasts from the latest row, or latest twelve rows, of each entity; a series that is shorter is filled up
    in front with its earliest row, so every entity gets a forecast from every member."""
    out = {}
    for name, model in members.items():
        if model.features == "features":
            rows = with_features(data, latest_row(data.table, spec))
        else:
            tail = tail_sequence(data.table, data.sequence_names, spec, pad="edge")
            rows = tail.withColumn("sequence", F.flatten("sequence"))
        out[name] = model.predict(rows, [spec.entity])
    return out


def score(
    data: Prepared, members: dict[str, Member], weights=O.WEIGHTS, spec: PanelSpec = PanelSpec()
) -> DataFrame:
    """The forecast record of every entity."""
    return O.forecast_struct(O.combine_members(member_forecasts(data, members, spec), weights, spec), spec)


def export_tables(
    panel: DataFrame, forecast: DataFrame, dim: DataFrame, as_of: Column, spec: PanelSpec = PanelSpec()
) -> dict[str, DataFrame]:
    """The five tables of an export run."""
    last = panel.groupBy(spec.entity).agg(F.max(spec.date).cast("string").alias("last_data_date"))
    summary = O.summary_table(forecast, dim, last, as_of, spec)
    ranked = [F.desc("risk_index"), spec.entity]
    return {
        "predictions_summary": summary.orderBy(*ranked),
        "predictions_forecast_weekly": O.long_table(forecast, dim, as_of.cast("date"), spec),
        "predictions_historical": history_export(panel, O.HISTORY_COLUMNS, dim, spec).orderBy(
            spec.entity, *spec.order(panel)
        ),
        "predictions_alerts": O.alert_table(summary).orderBy(*ranked),
        "predictions_risk_bands": risk_bands(summary),
    }
