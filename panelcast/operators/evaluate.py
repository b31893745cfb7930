"""Forecast errors, accuracy scores, the ensemble score and the retrain gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETRAIN_THRESHOLD = 0.88


def regression_metrics(
    df: DataFrame, by: list[str], actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """n, MAE, RMSE, R2 per group over rows with both values."""
    err = F.col(actual) - F.col(predicted)
    known = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    sse = F.sum(err * err)
    return known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.lit(1.0) - F.try_divide(sse, F.var_pop(actual) * F.count(F.lit(1)))).alias("r2"),
    )


def horizon_mean(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Unweighted mean of the metrics over the horizons."""
    return metrics.groupBy(*by).agg(
        *[F.avg(c).alias(c) for c in ("mae", "rmse", "r2")]
    )


def fold_summary(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Mean and population deviation of the fold MAEs."""
    return metrics.groupBy(*by).agg(
        F.avg("mae").alias("cv_mae"), F.stddev_pop("mae").alias("cv_mae_std")
    )


def limited(x: Column) -> Column:
    """Scores do not go below 0; unknown stays null."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def accuracy_from_mae(mae: Column, scale: float = 1.0) -> Column:
    """100 - MAE on the 0-100 scale; ``scale=100`` for an MAE on the 0-1 scale."""
    return limited(F.lit(100.0) - mae * F.lit(scale))


def accuracy_from_r2(r2: Column, cv_mae: Column | None = None) -> Column:
    """100 R2; where that is unknown 100 - CV MAE; null when neither was measured."""
    score = limited(r2 * F.lit(100.0))
    return score if cv_mae is None else F.coalesce(score, accuracy_from_mae(cv_mae))


def ensemble_accuracy(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean over the members that were evaluated (member, accuracy)."""
    w = F.lit(0.0)
    for name, value in weights.items():
        w = F.when(F.col("member") == name, F.lit(value)).otherwise(w)
    known = scores.where(F.col("accuracy").isNotNull()).withColumn("w", w)
    return known.agg(
        F.try_divide(F.sum(F.col("accuracy") * F.col("w")), F.sum("w")).alias("ensemble_accuracy")
    )


def retrain_gate(
    metrics: DataFrame, model: str, stamp: str, accuracy: str, threshold: float = RETRAIN_THRESHOLD
) -> DataFrame:
    """Latest accuracy (0-1) per model; below the threshold or unknown -> retrain."""
    latest = metrics.groupBy(model).agg(
        F.max_by(F.struct(accuracy, stamp), F.col(stamp)).alias("l")
    )
    value = F.col(f"l.{accuracy}")
    return latest.select(
        model,
        F.col(f"l.{stamp}").alias(stamp),
        value.alias(accuracy),
        F.coalesce(value < F.lit(threshold), F.lit(True)).alias("retrain"),
    )
