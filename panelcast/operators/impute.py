"""Imputation by the nearest complete neighbours, and by the mean.

Distance is Euclidean over the columns known in both rows, scaled up by the
share of columns compared. Pivot columns that are never null span a grid: a
donor outside the cells next to a row's own is farther away than one cell width,
so once the k-th neighbour found is within a cell width the answer is exact.
Rows without enough near neighbours go on with cells twice as wide. Donors with
equal values are one row with a count. The widest-spread columns make the best
pivots, as they dominate the distance.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.functions.sqltext import number, quoted, with_sql
from panelcast.operators.scaling import column_stats
from panelcast.session import checkpointed, materialized

# Rows in the fullest cell of the first round.
CELL_ROWS = 256

PARAMETERS = (
    "columns array<string>, pivots array<string>, k int, widest double, "
    "first_width double, means map<string,double>, block array<string>"
)


def column_means(df: DataFrame, columns: list[str]) -> dict[str, float]:
    return {c: s.mean for c, s in column_stats(df, columns).items()}


@dataclass
class MeanImputer:
    """The cheap mode: fitted column means."""

    columns: list[str]
    means: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> MeanImputer:
        self.means = column_means(df, self.columns)
        return self

    def transform(self, df: DataFrame, key: list[str] | None = None) -> DataFrame:
        return with_sql(df, {c: f"coalesce(cast({quoted(c)} as double), {number(m)})" for c, m in self.means.items()})


@dataclass
class KnnImputer:
    """Mean of the ``k`` nearest fitted rows that know the value.

    With many columns neighbours are far, cells grow wide and a search comes
    close to all pairs. ``block`` names columns, such as the season or a group
    of entities, that a donor must share with the row: the search is then exact
    within the block, and a value no donor of the block knows gets the mean.
    """

    columns: list[str]
    pivots: list[str] | None = None
    k: int = 5
    block: list[str] = field(default_factory=list)
    donors: DataFrame | None = None
    means: dict[str, float] = field(default_factory=dict)
    widest: float = 0.0
    first_width: float = 1.0

    def fit(self, df: DataFrame) -> KnnImputer:
        values = df.select(*[F.col(c).cast("double").alias(c) for c in self.columns])
        row = values.agg(
            F.count(F.lit(1)).alias("n"),
            *[
                F.struct(
                    F.avg(c).alias("mean"),
                    (F.max(c) - F.min(c)).alias("range"),
                    F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias("spread"),
                    F.count_if(F.col(c).isNull()).alias("nulls"),
                ).alias(f"s{i}")
                for i, c in enumerate(self.columns)
            ],
        ).first()
        stats = {c: row[f"s{i}"] for i, c in enumerate(self.columns)}
        complete = [c for c in self.columns if stats[c]["nulls"] == 0]
        pivots = self.pivots or sorted(complete, key=lambda c: -stats[c]["spread"])[:2]
        if not pivots or any(c not in complete for c in pivots):
            raise ValueError("pivot columns must never be null")
        self.pivots = pivots
        self.means = {c: s["mean"] for c, s in stats.items() if s["mean"] is not None}
        ranges = [max(stats[c]["range"] or 0.0, 1e-9) for c in pivots]
        self.widest = max(ranges)
        blocks = [F.col(c).alias(f"block_{c}") for c in self.block]
        named = df.select(*blocks, *[F.col(c).cast("double").alias(c) for c in self.columns])
        donors = named.groupBy(*self._blocks, *self.columns).agg(F.count(F.lit(1)).alias("copies"))
        # Every round of the search reads them.
        self.donors = materialized(donors, "donors")
        # Cells that would hold about k donors each if these spread evenly.
        even = (prod(ranges) * self.k / max(row["n"], 1)) ** (1.0 / len(pivots))
        self.first_width = self._fit_width(max(even, 1e-9))
        return self

    def _fit_width(self, width: float) -> float:
        """Narrow the first cells until the fullest one is small, wherever the
        data crowds; starting narrow costs a few more rounds, not more pairs."""
        for _ in range(12):
            fullest = (
                self.donors.groupBy(*self._blocks, *[self._cell(F.col(p), width) for p in self.pivots])
                .agg(F.count(F.lit(1)).alias("n"))
                .agg(F.max("n"))
                .first()[0]
            )
            if (fullest or 0) <= CELL_ROWS:
                break
            width /= 2
        return width

    def transform(self, df: DataFrame, key: list[str]) -> DataFrame:
        """``df`` with nulls of the fitted columns filled; ``key`` is unique."""
        typed = df.withColumns({c: F.col(c).cast("double") for c in self.columns})
        wanted = F.array_compact(
            F.array(*[F.when(F.col(c).isNull(), F.lit(i)) for i, c in enumerate(self.columns)])
        )
        queries = (
            typed.select(
                *key, *[F.col(c).alias(f"block_{c}") for c in self.block],
                *[F.col(c).alias(f"q_{c}") for c in self.columns], F.explode(wanted).alias("target")
            )
        )
        found = self._search(checkpointed(queries), key)
        filled = found.groupBy(*key).agg(
            *[
                F.max(F.when(F.col("target") == i, F.col("value"))).alias(f"f_{i}")
                for i in range(len(self.columns))
            ]
        )
        out = typed.join(filled, key, "left")
        fallback = {c: F.lit(m) for c, m in self.means.items()}
        return out.select(
            *[
                F.coalesce(F.col(c), F.col(f"f_{self.columns.index(c)}"), fallback.get(c, F.lit(None))).alias(c)
                if c in self.columns
                else F.col(c)
                for c in df.columns
            ]
        )

    def _search(self, pending: DataFrame, key: list[str]) -> DataFrame:
        done: list[DataFrame] = []
        width = self.first_width
        while True:
            whole = width > self.widest
            best = checkpointed(self._nearest(pending, key, width))
            settled = F.lit(True) if whole else (F.col("taken") >= self.k) & (F.col("farthest") <= width)
            done.append(best.where(settled).select(*key, "target", "value"))
            if whole:
                break
            solved = best.where(settled).select(*key, "target")
            pending = checkpointed(pending.join(solved, [*key, "target"], "left_anti"))
            if pending.isEmpty():
                break
            width *= 2
        return reduce(DataFrame.unionByName, done)

    @property
    def _blocks(self) -> list[str]:
        return [f"block_{c}" for c in self.block]

    def _cell(self, x: Column, width: float) -> Column:
        return F.floor(x / F.lit(width))

    def _nearest(self, pending: DataFrame, key: list[str], width: float) -> DataFrame:
        cells = [f"cell_{p}" for p in self.pivots]
        donors = self.donors.withColumns(
            {cell: self._cell(F.col(p), width) for cell, p in zip(cells, self.pivots)}
        )
        around = pending
        for cell, p in zip(cells, self.pivots):
            own = self._cell(F.col(f"q_{p}"), width)
            around = around.withColumn(cell, F.explode(F.array(own - 1, own, own + 1)))
        value = F.coalesce(
            *[F.when(F.col("target") == i, F.col(c)) for i, c in enumerate(self.columns)]
        )
        gaps = [F.col(f"q_{c}") - F.col(c) for c in self.columns]
        squares = [F.coalesce(g * g, F.lit(0.0)) for g in gaps]
        known = [g.isNotNull().cast("int") for g in gaps]
        share = F.lit(float(len(self.columns))) / sum(known[1:], known[0])
        pairs = (
            around.join(donors, [*self._blocks, *cells])
            .withColumn("v", value)
            .where(F.col("v").isNotNull())
            .withColumn("distance", F.sqrt(share * sum(squares[1:], squares[0])))
        )
        if width <= self.widest:
            # Only what lies within a cell width can settle a row this round.
            pairs = pairs.where(F.col("distance") <= F.lit(width))
        order = Window.partitionBy(*key, "target").orderBy("distance", *self.columns)
        near = pairs.select(*key, "target", "v", "copies", "distance", F.row_number().over(order).alias("rn")).where(
            F.col("rn") <= self.k
        )
        upto = Window.partitionBy(*key, "target").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("copies").over(upto), F.lit(0))
        taken = near.withColumn("take", F.least(F.col("copies"), F.lit(self.k) - before)).where(F.col("take") > 0)
        return taken.groupBy(*key, "target").agg(
            (F.sum(F.col("v") * F.col("take")) / F.sum("take")).alias("value"),
            F.sum("take").alias("taken"),
            F.max("distance").alias("farthest"),
        )

    def save(self, spark: SparkSession, path: str) -> None:
        self.donors.write.mode("overwrite").parquet(f"{path}/donors")
        row = (self.columns, self.pivots, self.k, self.widest, self.first_width, self.means, self.block)
        spark.createDataFrame([row], PARAMETERS).write.mode("overwrite").parquet(f"{path}/parameters")

    @staticmethod
    def load(spark: SparkSession, path: str) -> KnnImputer:
        row = spark.read.schema(PARAMETERS).parquet(f"{path}/parameters").first()
        return KnnImputer(
            list(row["columns"]), list(row["pivots"]), row["k"], list(row["block"]),
            spark.read.parquet(f"{path}/donors"), dict(row["means"]), row["widest"], row["first_width"],
        )
