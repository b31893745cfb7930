"""Learned forecasts, at the library's full size. Seeds are fixed; counts, ranges and errors have SQL twins.

Fitted parts come from the content-addressed store: a query fits only what it reads and no session has fitted yet.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.catalog import bindings as B
from panelcast.catalog.registry import query
from panelcast.catalog.sql import over_panel
from panelcast.functions.numeric import half_up
from panelcast.operators import forecast as O
from panelcast.plans import prediction as P
from panelcast.plans import training as T

_HORIZONS = "(select cast(unnest(generate_series(1, 4)) as int) as horizon)"


def learned(spark, sf) -> T.Learned:
    return T.Learned(B.stored_panel(spark, sf))


def forecasts(models: T.Learned, **members):
    """The members' forecasts for every entity, from the tail of its series."""
    return P.member_forecasts(P.scoring_table(models.panel, models.pipeline), members)


def rounded(df, columns, digits=4):
    return df.withColumns({c: half_up(c, digits) for c in columns})


_EVERY_HORIZON = over_panel(
    f"select province, horizon, true as in_range from (select distinct province from panel) cross join {_HORIZONS}"
)


def _in_range(made):
    return made.select("province", "horizon", F.col("value").between(0, 100).alias("in_range"))


@query("rf_forecast")
def rf_forecast(spark, sf):
    """Four weeks ahead for every entity, from its latest row."""
    models = learned(spark, sf)
    return rounded(forecasts(models, rf=models.forest())["rf"], ["value"], 2)


@query("rf_forecast_range", _EVERY_HORIZON)
def rf_forecast_range(spark, sf):
    """That the forest forecasts every entity and horizon, within 0-100."""
    models = learned(spark, sf)
    return _in_range(forecasts(models, rf=models.forest())["rf"])


@query("sequence_forecast")
def sequence_forecast(spark, sf):
    """Four weeks ahead for every entity, from its last twelve rows."""
    models = learned(spark, sf)
    return rounded(forecasts(models, mlp=models.network())["mlp"], ["value"], 2)


@query("sequence_forecast_range", _EVERY_HORIZON)
def sequence_forecast_range(spark, sf):
    """That the network forecasts every entity and horizon, within 0-100."""
    models = learned(spark, sf)
    return _in_range(forecasts(models, mlp=models.network())["mlp"])


@query("feature_importance")
def feature_importance(spark, sf):
    return rounded(learned(spark, sf).forest().importance(spark, 20), ["importance"], 6)


@query("feature_importance_sum", "select 1.0::double as total, true as none_negative")
def feature_importance_sum(spark, sf):
    """That the importances of all features are shares of one."""
    model = learned(spark, sf).forest()
    every = model.importance(spark, len(model.names))
    return every.agg(half_up(F.sum("importance"), 6).alias("total"),
                     F.bool_and(F.col("importance") >= 0).alias("none_negative"))


@query("cv_metrics")
def cv_metrics(spark, sf):
    """Errors of full forests per fold and horizon on expanding windows."""
    return rounded(learned(spark, sf).folds(), ["mae", "rmse", "r2"])


@query("training_report")
def training_report(spark, sf):
    """Both members, their combination and the last value, on training and held-out weeks."""
    models = learned(spark, sf)
    data, fitted = models.data, {"rf": models.forest(), "mlp": models.network()}
    metrics = T.evaluate_members(data, fitted)
    report = T.training_report(data, metrics, T.evaluate_members(data, fitted, "train"), models.folds(),
                               sum(m.seconds for m in fitted.values()))
    return report.select(
        "train_samples", "val_samples", "test_samples", "meets_threshold", "seconds", "cv_mae", "cv_mae_std",
        half_up("ensemble_accuracy_pct", 4).alias("ensemble_accuracy_pct"),
        F.explode("members").alias("m"),
    ).select(
        "*", "m.member", *[half_up(f"m.{c}", 4).alias(c) for c in ("mae", "rmse", "r2", "train_mae", "train_rmse", "train_r2")]
    ).drop("m")


@query(
    "training_samples",
    over_panel(
        """select count(*) filter (where target_date < c.val_start) as train_samples,
        count(*) filter (where date >= c.val_start and target_date < c.test_start) as val_samples,
        count(*) filter (where date >= c.test_start and target_date is not null) as test_samples
        from (select date, lead(date, 4) over (partition by province order by date) as target_date from panel), c""",
        """days as (select list(distinct date order by date) as d, count(distinct date) as n from panel),
        c as (select d[n - 2 * floor(n * 0.15)::int + 1] as val_start, d[n - floor(n * 0.15)::int + 1] as test_start
          from days)""",
    ),
)
def training_samples(spark, sf):
    """Rows of the three periods, as the report counts them."""
    return T.sample_counts(learned(spark, sf).data)


@query("scored_entities")
def scored_entities(spark, sf):
    """The forecast record of every entity from both learned members."""
    models = learned(spark, sf)
    table = P.scoring_table(models.panel, models.pipeline)
    return O.flatten_forecast(P.score(table, {"rf": models.forest(), "mlp": models.network()}))
