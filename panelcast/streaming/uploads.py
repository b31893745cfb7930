"""Continuous upload ingestion.

Each micro-batch appends what is valid to a log and the rest to a quarantine
folder, under the batch's own number, so that a repeated batch replaces itself.
Every upload is stored, however late, and also where it takes a value back to
an earlier one; only equal rows of one batch are stored once. The panel is the
latest row per key of the log; ``compact`` folds the log. Nothing that is being
read is ever overwritten, and the stream keeps no state.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelcast.operators.validate import split_valid, upload_rules
from panelcast.spec import PanelSpec

def latest_per_key(df: DataFrame, order: list[str], spec: PanelSpec = PanelSpec()) -> DataFrame:
    """The newest row of each key, combined before the shuffle."""
    rest = [c for c in df.columns if c not in spec.key]
    newest = df.groupBy(*spec.key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return newest.select(*[c if c in spec.key else F.col("_row")[c].alias(c) for c in df.columns])


def upsert(existing: DataFrame, new: DataFrame, order: list[str], spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Batch form: rows of ``new`` replace older rows of the same key."""
    return latest_per_key(existing.unionByName(new, allowMissingColumns=True), order, spec)


def check_batch(
    batch: DataFrame, domain: DataFrame, spec: PanelSpec = PanelSpec()
) -> tuple[DataFrame, DataFrame]:
    """(valid rows, broken rows with the names of what they break)."""
    known = domain.select(spec.entity).distinct().withColumn("_known", F.lit(True))
    marked = batch.join(known, spec.entity, "left")
    rules = upload_rules(batch) | {"entity_domain": F.coalesce("_known", F.lit(False))}
    good, bad = split_valid(marked, rules)
    return good.drop("_known").select(*batch.columns), bad.drop("_known").select(*batch.columns, "failed")


def start_ingestion(
    uploads: DataFrame,
    domain: DataFrame,
    target: str,
    checkpoint: str,
    spec: PanelSpec = PanelSpec(),
) -> StreamingQuery:
    """Ingest everything that has landed, then stop."""

    def append(batch: DataFrame, batch_id: int) -> None:
        # Two writes, one read of the sources.
        batch = batch.distinct().persist(StorageLevel.MEMORY_AND_DISK)
        good, bad = check_batch(batch, domain, spec)
        good.write.mode("overwrite").parquet(f"{target}/log/batch_id={batch_id}")
        bad.write.mode("overwrite").parquet(f"{target}/quarantine/batch_id={batch_id}")
        batch.unpersist()

    return (
        uploads.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_panel(spark: SparkSession, target: str, order: list[str], spec: PanelSpec = PanelSpec()) -> DataFrame:
    """The log as it stands, newest row per key."""
    return latest_per_key(spark.read.parquet(f"{target}/log").drop("batch_id"), order, spec)


def quarantined(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/quarantine")


def compact(spark: SparkSession, target: str, out: str, order: list[str], spec: PanelSpec = PanelSpec()) -> None:
    """Write the current panel as the first batch of a new log at ``out``."""
    current_panel(spark, target, order, spec).write.mode("overwrite").parquet(f"{out}/log/batch_id=-1")
