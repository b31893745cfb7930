"""Learning on the feature table: a forest and a sequence network, each for all horizons at once.

``rf`` sees the current row's features, ``mlp`` the last twelve rows, one behind the other. Both learn the scaled
targets and are brought back to 0-100 before they are combined.
"""

from __future__ import annotations

import dataclasses
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.numeric import clamp
from panelcast.operators import evaluate as E
from panelcast.operators.forecast import WEIGHTS, combine_members
from panelcast.operators.forest import Forest, ForestSize, cut_table, fit_forests, read_forest
from panelcast.operators.network import Network, NetworkSize, fit_network
from panelcast.operators.split import cutoffs, expanding_folds
from panelcast.operators.windows import HORIZON, SEQUENCE_LENGTH, filled_array, target_columns
from panelcast.plans.features import FeaturePipeline, FeaturePipelineModel
from panelcast.plans.store import Store, fingerprint
from panelcast.session import materialized, send_code
from panelcast.spec import PanelSpec, numeric_columns

send_code(__name__)

# The calendar columns that the forest sees besides the features.
CALENDAR = ("year", "week", "month")
TARGETS = [f"target_week_{h}" for h in range(1, HORIZON + 1)]


def tabular(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """Numeric columns of a row as a vector, nulls as 0."""
    filled = df.fillna(0.0, subset=columns)
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="error").transform(filled)


def flattened(
    df: DataFrame, columns: list[str], spec: PanelSpec, length: int = SEQUENCE_LENGTH, out: str = "sequence"
) -> DataFrame:
    """The last ``length`` rows up to each row as one array; null while too short."""
    tail = F.collect_list(filled_array(columns)).over(spec.window(df).rowsBetween(-(length - 1), 0))
    return df.withColumn("_tail", tail).withColumn(
        out, F.when(F.size("_tail") == length, F.flatten("_tail"))
    ).drop("_tail")


@dataclass
class Member:
    """A fitted model of all horizons; predictions on the original scale.

    ``features`` names the array column it reads."""

    model: Forest | Network
    features: str
    back: Callable[[Column], Column]
    seconds: float | None = None

    @property
    def names(self) -> list[str]:
        return self.model.names

    def predict(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """(keep.., horizon, value), limited to 0-100; one pass over ``df``."""
        model = self.model

        @F.pandas_udf("array<double>")
        def predicted(x: pd.Series) -> pd.Series:
            return pd.Series(list(model.predicted(np.stack(x.to_list()).astype("f8"))) if len(x) else [], dtype=object)

        ready = df.where(F.col(self.features).isNotNull()).select(*keep, predicted(self.features).alias("_y"))
        rows = ready.select(*keep, F.posexplode("_y").alias("_h", "_v"))
        return rows.select(*keep, (F.col("_h") + 1).cast("int").alias("horizon"),
                           clamp(self.back(F.col("_v")), 0.0, 100.0).alias("value"))

    def importance(self, spark: SparkSession, top: int = 20) -> DataFrame:
        """The features' shares in what the forest's splits gain, largest first."""
        rows = [(n, float(v)) for n, v in zip(self.names, self.model.importance(), strict=True)]
        table = spark.createDataFrame(rows, "feature string, importance double")
        return table.orderBy(F.desc("importance"), "feature").limit(top)

    def save(self, spark: SparkSession, path: str) -> None:
        """The fitted numbers as Parquet under ``path``; what was there is replaced."""
        def write(df, name):
            df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")

        if isinstance(self.model, Forest):
            nodes = [(0, i, bytearray(t.nodes.tobytes())) for i, t in enumerate(self.model.trees)]
            write(spark.createDataFrame(nodes, "forest int, tree int, nodes binary"), "trees")
            write(cut_table(spark, self.names, self.model.cuts), "cuts")
        else:
            n = self.model
            numbers = {"flat": n.flat, "mean": n.mean, "scale": n.scale, "y_mean": n.y_mean, "y_scale": n.y_scale,
                       "losses": np.array(n.losses)}
            rows = [(k, bytearray(np.asarray(v, "f8").tobytes())) for k, v in numbers.items()]
            write(spark.createDataFrame(rows, "part string, numbers binary"), "weights")
            write(spark.createDataFrame(list(enumerate(self.names)), "place int, name string"), "names")
            write(spark.createDataFrame([(list(n.size.layers),)], "layers array<int>"), "size")
        about = [("forest" if isinstance(self.model, Forest) else "network", self.features, self.seconds)]
        write(spark.createDataFrame(about, "kind string, features string, seconds double"), "about")

    @staticmethod
    def load(spark: SparkSession, path: str, back: Callable[[Column], Column], horizon: int = HORIZON) -> Member:
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        about = read("about").first()
        if about["kind"] == "forest":
            cuts = read("cuts").orderBy("place").collect()
            model = read_forest(read("trees"), [r["name"] for r in cuts], [np.array(r["cuts"]) for r in cuts], horizon)
        else:
            part = {r["part"]: np.frombuffer(r["numbers"]) for r in read("weights").collect()}
            names = [r["name"] for r in read("names").orderBy("place").collect()]
            model = Network(names, part["flat"], NetworkSize(layers=tuple(read("size").first()[0])), part["mean"],
                            part["scale"], part["y_mean"], part["y_scale"], part["losses"].tolist())
        return Member(model, about["features"], back, about["seconds"])


@dataclass
class Prepared:
    """The scaled feature table with targets, split by time."""

    pipeline: FeaturePipelineModel
    table: DataFrame
    tabular_names: list[str]
    sequence_names: list[str]
    val_start: date
    test_start: date

    @property
    def keys(self) -> list[str]:
        return [self.pipeline.spec.entity, self.pipeline.spec.date]

    @property
    def train(self) -> DataFrame:
        """Rows whose last target lies before the validation period."""
        return self.table.where(F.col("target_date") < F.lit(self.val_start))

    @property
    def val(self) -> DataFrame:
        return self.table.where(
            (F.col("date") >= F.lit(self.val_start)) & (F.col("target_date") < F.lit(self.test_start))
        )

    @property
    def test(self) -> DataFrame:
        return self.table.where((F.col("date") >= F.lit(self.test_start)) & F.col("target_date").isNotNull())

    def actuals(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """(keep.., horizon, actual) on the original scale."""
        cells = F.array(
            *[
                F.struct(
                    F.lit(h).alias("horizon"),
                    self.pipeline.inverse_target(F.col(f"target_week_{h}")).alias("actual"),
                )
                for h in range(1, HORIZON + 1)
            ]
        )
        return df.select(*keep, F.explode(cells).alias("c")).select(*keep, "c.horizon", "c.actual")


def prepare(panel: DataFrame, spec: PanelSpec = PanelSpec(), imputer: str = "mean") -> Prepared:
    """Fit the pipeline on the training period only and apply it to all rows.

    The feature table is written once; every model reads it from there.
    """
    cut = cutoffs(panel, spec.date).first()
    pipeline = FeaturePipeline(spec, imputer).fit(panel.where(F.col(spec.date) < F.lit(cut["val_start"])))
    made = pipeline.transform(panel)
    w = spec.window(made)
    table = made.withColumns(
        target_columns(w, spec.target) | {"target_date": F.lead(spec.date, HORIZON).over(w)}
    )
    return prepared_from(pipeline, materialized(table, "features"), cut["val_start"], cut["test_start"])


def prepared_from(pipeline: FeaturePipelineModel, table: DataFrame, val_start: date, test_start: date) -> Prepared:
    """A written feature table with the names that the members learn from."""
    sequence_names = pipeline.feature_columns()
    skip = (pipeline.spec.target, "target_date", *TARGETS)
    tabular_names = [c for c in numeric_columns(table, skip) if c in sequence_names or c in CALENDAR]
    return Prepared(pipeline, table, tabular_names, sequence_names, val_start, test_start)


def train_forest(data: Prepared, df: DataFrame | None = None, size: ForestSize = ForestSize()) -> Member:
    """A forest over rows of the feature table, those of the training period if none are given."""
    start, rows = time.perf_counter(), data.train if df is None else df
    cuts, trees = fit_forests(rows, data.tabular_names, TARGETS, data.keys, size)
    forest = read_forest(trees, data.tabular_names, cuts, len(TARGETS))
    return Member(forest, "features", data.pipeline.inverse_target, time.perf_counter() - start)


def with_features(data: Prepared, df: DataFrame) -> DataFrame:
    return df.withColumn("features", filled_array(data.tabular_names))


def with_sequences(data: Prepared, spec: PanelSpec = PanelSpec()) -> DataFrame:
    return flattened(data.table, data.sequence_names, spec)


def train_network(data: Prepared, spec: PanelSpec = PanelSpec(), size: NetworkSize = NetworkSize()) -> Member:
    """A network over the sequences that end in the training period."""
    start = time.perf_counter()
    rows = with_sequences(data, spec).where(F.col("sequence").isNotNull() & (F.col("target_date") < F.lit(data.val_start)))
    # Written once, read in every round.
    stored = materialized(rows.select(
        F.col("sequence").cast("array<float>").alias("x"), F.array(*[F.col(c).cast("float") for c in TARGETS]).alias("y"),
        F.xxhash64(*data.keys).alias("hash")).repartition("hash").sortWithinPartitions("hash"), "sequences")
    names = [f"{c}_t{t}" for t in range(1, SEQUENCE_LENGTH + 1) for c in data.sequence_names]
    network = fit_network(stored, names, size)
    return Member(network, "sequence", data.pipeline.inverse_target, time.perf_counter() - start)


def persistence(data: Prepared, df: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """The current value as the forecast of every horizon."""
    value = data.pipeline.inverse_target(F.col(spec.target))
    horizons = F.explode(F.array(*[F.lit(h) for h in range(1, HORIZON + 1)]))
    return df.select(spec.entity, spec.date, horizons.alias("horizon"), value.alias("value"))


def evaluate_members(
    data: Prepared, members: dict[str, Member], part: str = "test", spec: PanelSpec = PanelSpec()
) -> DataFrame:
    """(member, horizon, n, mae, rmse, r2) on held-out rows, on the 0-100 scale.

    Besides the members: their weighted combination, and the last value as floor.
    """
    keep = [spec.entity, spec.date]
    period = getattr(data, part)
    sequenced = with_sequences(data, spec).join(period.select(*keep), keep, "left_semi")
    forecasts = {
        name: model.predict(
            with_features(data, period) if model.features == "features" else sequenced, keep
        )
        for name, model in members.items()
    }
    stacked = None
    for name, df in (forecasts | {"persistence": persistence(data, period, spec)}).items():
        rows = df.withColumn("member", F.lit(name))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    if len(members) > 1:
        # The combination is keyed by (entity, date) together.
        pair = PanelSpec(entity="_pair", date=spec.date)
        paired = {n: d.withColumn("_pair", F.struct(*keep)) for n, d in forecasts.items()}
        both = combine_members(paired, {n: WEIGHTS[n] for n in members}, pair)
        stacked = stacked.unionByName(
            both.select(
                *[F.col(f"_pair.{c}").alias(c) for c in keep], "horizon",
                F.col("ensemble").alias("value"), F.lit("ensemble").alias("member"),
            )
        )
    truth = data.actuals(period, keep)
    joined = stacked.join(truth, [*keep, "horizon"]).withColumnRenamed("value", "predicted")
    return E.regression_metrics(joined, ["member", "horizon"])


def cross_validate(data: Prepared, folds: int = 5, spec: PanelSpec = PanelSpec(), size: ForestSize = ForestSize()) -> DataFrame:
    """(fold, horizon, n, mae, rmse, r2) of the forest on expanding windows of the training period.

    The forests of all folds are grown together; each sees only weeks whose last target lies before its fold. The
    pipeline's caps, ranges and means are those of the whole training period, so a fold's own weeks take part in
    these few numbers per column.
    """
    bounds = sorted(expanding_folds(data.train, spec, folds).collect(), key=lambda x: x["fold"])
    keep = [spec.entity, spec.date]
    # The number of folds that begin too early for a row is the number of the first that may learn from it.
    first = sum((F.when(F.col("target_date") >= F.lit(b["test_start"]), 1).otherwise(0) for b in bounds), F.lit(0))
    rows = data.train.withColumn("_first", first).where(F.col("_first") < len(bounds))
    cuts, trees = fit_forests(rows, data.tabular_names, TARGETS, data.keys, size, "_first", len(bounds))
    out = None
    for i, b in enumerate(bounds):
        within = data.train.where(F.col(spec.date).between(F.lit(b["test_start"]), F.lit(b["test_end"])))
        model = Member(read_forest(trees, data.tabular_names, cuts, len(TARGETS), i), "features", data.pipeline.inverse_target)
        predicted = model.predict(with_features(data, within), keep)
        joined = predicted.join(data.actuals(within, keep), [*keep, "horizon"])
        scored = joined.withColumnRenamed("value", "predicted").withColumn("fold", F.lit(int(b["fold"])))
        out = scored if out is None else out.unionByName(scored)
    return E.regression_metrics(out, ["fold", "horizon"])


def sample_counts(data: Prepared) -> DataFrame:
    """Rows of the training, validation and test periods."""
    return data.table.agg(
        F.count_if(F.col("target_date") < F.lit(data.val_start)).alias("train_samples"),
        F.count_if(
            (F.col("date") >= F.lit(data.val_start)) & (F.col("target_date") < F.lit(data.test_start))
        ).alias("val_samples"),
        F.count_if((F.col("date") >= F.lit(data.test_start)) & F.col("target_date").isNotNull()).alias("test_samples"),
    )


def training_report(
    data: Prepared, metrics: DataFrame, train_metrics: DataFrame | None = None, folds: DataFrame | None = None,
    seconds: float | None = None, threshold: float = E.RETRAIN_THRESHOLD,
) -> DataFrame:
    """One nested row: sizes, metrics per member on held-out rows and, if given, on training rows, mean and
    deviation over the folds of a cross-validation, the seconds taken, measured ensemble accuracy."""
    sizes = sample_counts(data).withColumn("seconds", F.lit(seconds).cast("double"))
    per_member = E.horizon_mean(metrics, ["member"]).withColumn("accuracy", E.accuracy_from_mae(F.col("mae")))
    names = ("mae", "rmse", "r2")
    if train_metrics is None:
        per_member = per_member.withColumns({f"train_{c}": F.lit(None).cast("double") for c in names})
    else:
        own = E.horizon_mean(train_metrics, ["member"]).select("member", *[F.col(c).alias(f"train_{c}") for c in names])
        per_member = per_member.join(own, "member", "left")
    if folds is None:
        cv = sizes.select(F.lit(None).cast("double").alias("cv_mae"), F.lit(None).cast("double").alias("cv_mae_std"))
    else:
        by_fold = folds.groupBy("fold").agg(F.avg("mae").alias("mae"))
        cv = by_fold.agg(F.avg("mae").alias("cv_mae"), F.stddev_pop("mae").alias("cv_mae_std"))
    # A handful of members.
    listed = per_member.agg(
        F.sort_array(
            F.collect_list(F.struct("member", "mae", "rmse", "r2", "accuracy", "train_mae", "train_rmse", "train_r2"))
        ).alias("members"),
        F.max(F.when(F.col("member") == "ensemble", F.col("accuracy"))).alias("ensemble_accuracy_pct"),
    )
    return sizes.select(
        "*", listed.select(F.struct("*")).scalar().alias("r"), cv.select(F.struct("*")).scalar().alias("cv")
    ).select(
        "train_samples", "val_samples", "test_samples", "seconds", "r.members", "cv.*", "r.ensemble_accuracy_pct",
        (F.col("r.ensemble_accuracy_pct") >= threshold * 100).alias("meets_threshold"),
    )


class Learned:
    """What is fitted to a panel, each part when it is first asked for, and kept by content in a store.

    The keys depend on the panel's rows and on all parameters, so an equal panel in another session finds the same
    parts and any change of either fits anew."""

    def __init__(self, panel: DataFrame, spec: PanelSpec = PanelSpec(), imputer: str = "mean", store: Store | None = None):
        self.panel, self.spec, self.imputer = panel, spec, imputer
        self.spark = panel.sparkSession
        self.store = store or Store(self.spark)

    @cached_property
    def content(self) -> str:
        return fingerprint(self.panel)

    def _key(self, kind: str, **params) -> str:
        return self.store.key(kind, self.content, spec=dataclasses.asdict(self.spec), imputer=self.imputer, **params)

    @cached_property
    def _prepared(self) -> str:
        def write(path: str) -> None:
            made = prepare(self.panel, self.spec, self.imputer)
            made.table.write.parquet(f"{path}/features")
            made.pipeline.save(self.spark, f"{path}/pipeline")
            self.spark.createDataFrame([(made.val_start, made.test_start)], "val_start date, test_start date").write.parquet(
                f"{path}/cut")

        return self.store.get(self._key("prepared"), write)

    @cached_property
    def pipeline(self) -> FeaturePipelineModel:
        return FeaturePipelineModel.load(self.spark, f"{self._prepared}/pipeline", self.spec)

    @cached_property
    def data(self) -> Prepared:
        cut = self.spark.read.parquet(f"{self._prepared}/cut").first()
        return prepared_from(self.pipeline, self.spark.read.parquet(f"{self._prepared}/features"), *cut)

    def _member(self, kind: str, size, fit: Callable[[], Member]) -> Member:
        path = self.store.get(self._key(kind, **dataclasses.asdict(size)), lambda path: fit().save(self.spark, path))
        return Member.load(self.spark, path, self.pipeline.inverse_target)

    def forest(self, size: ForestSize = ForestSize()) -> Member:
        return self._member("forest", size, lambda: train_forest(self.data, size=size))

    def network(self, size: NetworkSize = NetworkSize()) -> Member:
        return self._member("network", size, lambda: train_network(self.data, self.spec, size))

    def folds(self, folds: int = 5, size: ForestSize = ForestSize()) -> DataFrame:
        """The metrics of ``cross_validate``."""
        key = self._key("folds", folds=folds, **dataclasses.asdict(size))
        return self.spark.read.parquet(self.store.get(
            key, lambda path: cross_validate(self.data, folds, self.spec, size).coalesce(1).write.parquet(path)))
