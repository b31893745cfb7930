"""The runs a user starts: assemble, ingest, train, predict, check.

    spark-submit panelcast/jobs.py assemble --climate DIR --cases DIR --out DIR
    spark-submit panelcast/jobs.py ingest --panel DIR --uploads FILE.csv --out DIR --models DIR
    spark-submit panelcast/jobs.py train --panel DIR --models DIR
    spark-submit panelcast/jobs.py predict --panel DIR --models DIR --out DIR
    spark-submit panelcast/jobs.py check --panel DIR --models DIR
"""

from __future__ import annotations

import argparse
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.assemble import assemble_panel
from panelcast.operators.cleaning import ensure_date
from panelcast.operators.forecast import WEIGHTS
from panelcast.operators.forest import ForestSize
from panelcast.operators.network import NetworkSize
from panelcast.operators.validate import check_domain
from panelcast.streaming.uploads import check_batch, latest_per_key
from panelcast.operators.evaluate import RETRAIN_THRESHOLD, accuracy_from_mae, fold_summary, horizon_mean, retrain_gate
from panelcast.plans import prediction as P
from panelcast.plans import training as T
from panelcast.plans.features import FeaturePipelineModel
from panelcast.session import clear_scratch, materialized
from panelcast.sources import readers as R
from panelcast.sources import writers as W
from panelcast.sources.reference_data import entity_dimension
from panelcast.spec import PanelSpec


def assemble(
    spark: SparkSession, climate: str, cases: str, out: str,
    demographics: str | None = None, monthly: str | None = None,
) -> DataFrame:
    """Landed files to the stored panel, partitioned by year."""
    weeks = R.read_climate(spark, climate)
    dated = weeks.withColumns(
        {"year": F.extract(F.lit("YEAROFWEEK"), "date").cast("int"), "week": F.weekofyear("date")}
    )
    index = None if monthly is None else R.read_monthly_text(spark, monthly)
    panel = assemble_panel(
        dated, R.read_yearly_cases(spark, cases), R.read_demographics(spark, demographics), index
    )
    W.write_panel(panel, out)
    return spark.read.parquet(out)


def train(
    spark: SparkSession, panel: DataFrame, models: str, imputer: str = "mean", folds: int = 5,
    forest: ForestSize = ForestSize(), network: NetworkSize = NetworkSize(), spec: PanelSpec = PanelSpec(),
) -> DataFrame:
    """Fit, evaluate on held-out weeks, save everything; returns the metrics.

    Metrics are appended with the run's day, so that ``check`` sees the latest.
    """
    start = time.perf_counter()
    data = T.prepare(panel, spec, imputer)
    members = {"rf": T.train_forest(data, size=forest), "mlp": T.train_network(data, spec, network)}
    metrics = materialized(T.evaluate_members(data, members, spec=spec), "metrics")
    data.pipeline.save(spark, f"{models}/pipeline")
    for name, model in members.items():
        model.save(spark, f"{models}/{name}")
    members["rf"].importance(spark, 30).write.mode("overwrite").option("header", True).csv(f"{models}/importance")
    fitted_on = materialized(T.evaluate_members(data, members, "train", spec), "metrics")
    per_fold = None
    if folds:
        per_fold = materialized(T.cross_validate(data, folds, spec, forest), "folds")
        fold_summary(per_fold, ["horizon"]).write.mode("overwrite").parquet(f"{models}/cross_validation")
    seconds = time.perf_counter() - start
    W.write_report(T.training_report(data, metrics, fitted_on, per_fold, seconds), f"{models}/report")
    run = horizon_mean(metrics, ["member"]).withColumns(
        {"accuracy": accuracy_from_mae(F.col("mae")) / 100, "run": F.current_timestamp()}
    )
    run.write.mode("append").parquet(f"{models}/metrics")
    return metrics


def load(spark: SparkSession, panel: DataFrame, models: str, spec: PanelSpec = PanelSpec()):
    """(feature table of the rows of ``panel`` that a forecast needs, under the stored state; fitted members)."""
    pipeline = FeaturePipelineModel.load(spark, f"{models}/pipeline", spec)
    members = {name: T.Member.load(spark, f"{models}/{name}", pipeline.inverse_target) for name in WEIGHTS}
    return P.scoring_table(panel, pipeline, spec), members


def predict(
    spark: SparkSession, panel: DataFrame, models: str, out: str, as_of: str | None = None,
    dim: DataFrame | None = None, spec: PanelSpec = PanelSpec(),
) -> DataFrame:
    """Score every entity and write the export set and the latest forecast."""
    data, members = load(spark, panel, models, spec)
    forecast = materialized(P.score(data, members, spec=spec), "forecast")
    day = F.lit(as_of) if as_of else F.current_date().cast("string")
    dim = entity_dimension(spark) if dim is None else dim
    W.write_exports(P.export_tables(panel, forecast, dim, day, spec), out)
    forecast.write.mode("overwrite").parquet(f"{out}/latest")
    return forecast


def check(spark: SparkSession, panel: DataFrame, models: str, threshold: float = RETRAIN_THRESHOLD, **kw) -> bool:
    """Retrain if the latest measured accuracy of the ensemble is too low or unknown."""
    try:
        runs = spark.read.parquet(f"{models}/metrics").where("member = 'ensemble'")
        latest = retrain_gate(runs, "member", "run", "accuracy", threshold).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        latest = None
    due = latest is None or latest["retrain"]
    if due:
        train(spark, panel, models, **kw)
    return due


def ingest(
    spark: SparkSession, panel: DataFrame, uploads: str, out: str, models: str,
    threshold: float = RETRAIN_THRESHOLD, spec: PanelSpec = PanelSpec(), **kw,
) -> bool:
    """An uploaded CSV file into the panel, then the check whether the models need training; tells whether they
    were trained.

    What a valid row says replaces what the panel holds for its key; columns it lacks or leaves empty stay. Broken
    rows, and ones with values of the wrong type, are written as JSON to ``out``/broken, the new panel to
    ``out``/panel, which must not be where ``panel`` is read from."""
    typed, unreadable = R.read_upload_csv(spark, uploads)
    domain = panel.select(spec.entity).distinct()
    check_domain(typed, domain, "reject", spec)
    good, bad = check_batch(typed, domain, spec)
    rest = [c for c in good.columns if c not in spec.key and c in panel.columns]
    # A file has no times: of several rows of a key the last in value order counts, whatever the file's order.
    new = latest_per_key(good.select(*spec.key, *rest), rest, spec).withColumnsRenamed({c: f"_{c}" for c in rest})
    merged = panel.join(new, spec.key, "full").withColumns(
        {c: F.coalesce(F.col(f"_{c}").cast(panel.schema[c].dataType), F.col(c)) for c in rest})
    W.write_panel(ensure_date(merged.select(*panel.columns), spec), f"{out}/panel", spec.year)
    bad.select(F.to_json(F.struct("*")).alias("record")).unionAll(unreadable).write.mode("overwrite").text(f"{out}/broken")
    return check(spark, spark.read.parquet(f"{out}/panel"), models, threshold, spec=spec, **kw)


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("job", choices=("assemble", "ingest", "train", "predict", "check"))
    for name in ("climate", "cases", "demographics", "monthly", "panel", "models", "out", "as-of", "uploads"):
        args.add_argument(f"--{name}")
    args.add_argument("--format", default="parquet", choices=("parquet", "csv"))
    args.add_argument("--imputer", default="mean", choices=("mean", "knn"))
    opt = args.parse_args()
    spark = SparkSession.builder.appName(f"panelcast-{opt.job}").getOrCreate()
    if opt.job == "assemble":
        assemble(spark, opt.climate, opt.cases, opt.out, opt.demographics, opt.monthly)
        return
    panel = R.read_panel(spark, opt.panel, opt.format)
    if opt.job == "ingest":
        ingest(spark, panel, opt.uploads, opt.out, opt.models)
    elif opt.job == "train":
        train(spark, panel, opt.models, opt.imputer)
    elif opt.job == "predict":
        predict(spark, panel, opt.models, opt.out, opt.as_of)
    else:
        check(spark, panel, opt.models)
    clear_scratch(spark)


if __name__ == "__main__":
    main()
