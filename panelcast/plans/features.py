"""The preprocessing pipeline: clean, lag, roll, date, impute, scale.

``fit`` runs the few aggregates that make up the state; ``transform`` only
applies it and refits nothing. All window columns share one shuffle.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.temporal import temporal_features
from panelcast.operators.cleaning import apply_caps, clip_negative, dedup_first, ensure_date, fit_caps
from panelcast.operators.impute import KnnImputer, MeanImputer
from panelcast.operators.scaling import Range, apply_ranges, column_stats, inverse
from panelcast.operators.windows import (
    LAG_COLUMNS,
    ROLLING_COLUMNS,
    lag_columns,
    rolling_mean_columns,
    rolling_std_columns,
)
from panelcast.session import materialized
from panelcast.spec import PanelSpec, numeric_columns, present


def clean(df: DataFrame, spec: PanelSpec, order: list[str | Column] | None = None) -> DataFrame:
    dated = ensure_date(df, spec)
    rest = [c for c in dated.columns if c not in spec.key]
    kept = dedup_first(dated, spec.key, order or rest)
    return clip_negative(kept)


def add_features(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Lags, rolling statistics and calendar columns in one window pass.

    With this many columns the merged form of ``add_rolling`` makes expressions
    too large to compile well, so every length slides on its own here.
    """
    w = spec.window(df)
    rolled = present(df, ROLLING_COLUMNS)
    windows = (
        lag_columns(w, present(df, LAG_COLUMNS))
        | rolling_mean_columns(w, rolled)
        | rolling_std_columns(w, rolled)
    )
    return df.withColumns(windows).withColumns(
        temporal_features(F.col(spec.week), F.col(spec.date))
    )


@dataclass
class FeaturePipelineModel:
    spec: PanelSpec
    caps: dict[str, float]
    imputer: MeanImputer | KnnImputer
    ranges: dict[str, Range]
    target_range: Range

    def transform(self, df: DataFrame, scale_target: bool = True) -> DataFrame:
        spec = self.spec
        features = add_features(apply_caps(clean(df, spec), self.caps), spec)
        scaled = apply_ranges(self.imputer.transform(features, spec.key), self.ranges)
        if scale_target and spec.target in scaled.columns:
            scaled = apply_ranges(scaled, {spec.target: self.target_range}, null_as=None)
        return scaled

    def inverse_target(self, x: Column) -> Column:
        return inverse(x, *self.target_range)

    def feature_columns(self) -> list[str]:
        return list(self.ranges)

    def state(self, spark: SparkSession, imputer: str = "mean") -> DataFrame:
        """The fitted numbers as a small table (kind, column, a, b); its row ``imputer`` names the imputer."""
        rows = [("imputer", imputer, None, None)]
        rows += [("cap", c, float(v), None) for c, v in self.caps.items()]
        rows += [("mean", c, float(v), None) for c, v in self.imputer.means.items()]
        rows += [("range", c, float(a), float(b)) for c, (a, b) in self.ranges.items()]
        rows += [("target", self.spec.target, *map(float, self.target_range))]
        return spark.createDataFrame(rows, "kind string, column string, a double, b double")

    def save(self, spark: SparkSession, path: str) -> None:
        """State as Parquet; the donors of a neighbour imputer beside it, in a folder of this save.

        The state is written last and names that folder, so a reader never meets parts of two saves."""
        name = "mean"
        if isinstance(self.imputer, KnnImputer):
            name = f"knn-{uuid.uuid4().hex[:12]}"
            self.imputer.save(spark, f"{path}/{name}")
        self.state(spark, name).write.mode("overwrite").parquet(f"{path}/state")

    @staticmethod
    def load(spark: SparkSession, path: str, spec: PanelSpec = PanelSpec()) -> FeaturePipelineModel:
        rows = spark.read.parquet(f"{path}/state").collect()
        of = lambda kind: [r for r in rows if r["kind"] == kind]
        means = {r["column"]: r["a"] for r in of("mean")}
        target = of("target")[0]
        name = of("imputer")[0]["column"]
        # An imputer that is named but can't be read is an error, never another imputer.
        imputer = MeanImputer(list(means), means) if name == "mean" else KnnImputer.load(spark, f"{path}/{name}")
        return FeaturePipelineModel(
            spec,
            {r["column"]: r["a"] for r in of("cap")},
            imputer,
            {r["column"]: (r["a"], r["b"]) for r in of("range")},
            (target["a"], target["b"]),
        )


@dataclass
class FeaturePipeline:
    """``imputer`` is ``mean`` or ``knn``; the target itself is never imputed. ``block``: columns that a
    neighbour must share, such as the week of the year."""

    spec: PanelSpec = field(default_factory=PanelSpec)
    imputer: str = "mean"
    neighbours: int = 5
    block: tuple[str, ...] = ()

    def fit(self, df: DataFrame) -> FeaturePipelineModel:
        spec = self.spec
        # Read by the caps, then by the statistics.
        base = materialized(clean(df, spec), "clean")
        caps = fit_caps(base)
        features = add_features(apply_caps(base, caps), spec)
        calendar = (spec.year, spec.week, "month")
        # Nothing the imputers fill in leaves the observed range of a column.
        stats = column_stats(features, numeric_columns(features, exclude=calendar))
        ranges = {c: (x.low, x.high) for c, x in stats.items()}
        target = ranges.pop(spec.target, (0.0, 1.0))
        if self.imputer == "knn":
            fitted = KnnImputer(list(ranges), k=self.neighbours, block=list(self.block)).fit(features)
        else:
            fitted = MeanImputer(list(ranges), {c: stats[c].mean for c in ranges})
        return FeaturePipelineModel(spec, caps, fitted, ranges, target)


def history_export(df: DataFrame, columns, codes: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Those of the history columns that exist, led by the entity code."""
    from panelcast.operators.assemble import DEFAULT_CODE

    kept = df.select(*present(df, columns)).join(
        codes.select(spec.entity, "province_code"), spec.entity, "left"
    )
    code = F.coalesce("province_code", F.lit(DEFAULT_CODE)).alias("province_code")
    return kept.select(code, *present(df, columns))
