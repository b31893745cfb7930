"""What several operators share: tables, held-out rows, code for the tasks, written tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from panelcast import session
from panelcast.session import materialized

#: Labelled rows whose remainder is 0 are never learned from.
FOLDS = 5
#: A side of a join is broadcast only when its counted rows stay under this; rows here are at most a few longs.
BROADCAST_ROWS = 400_000
#: Rows with a text that a Python worker is handed at a time.
TEXT_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32 of the id as text leaves remainder 0; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % FOLDS == 0,
                      F.lit(False))


def send_code(*modules: str) -> None:
    """Send this module's functions and those of ``modules`` with the tasks that call them."""
    for module in (__name__, *modules):
        session.send_code(module)


def text_batches(spark: SparkSession) -> SparkSession:
    """Let this session hand rows to Python TEXT_ROWS at a time; for callers, before they run operators on long texts.
    The usual ten thousand rows of text, held on both sides, fill hundreds of MB of an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS)
    return spark


def by_text(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with a bigint column as text: pandas would turn whole numbers beside nulls into floating ones."""
    return rows.withColumn(key, F.col(key).cast("string"))


def by_number(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with what ``by_text`` changed as a bigint again."""
    return rows.withColumn(key, F.col(key).cast("long"))


def strings(values: pd.Series) -> list[str | None]:
    """A column of text as a list, nulls as None."""
    return [x if isinstance(x, str) else None for x in values.to_numpy(object)]


def counted(df: DataFrame, name: str, **also: Column) -> tuple[DataFrame, dict]:
    """``df`` as ``materialized`` gives it, and what was seen of its rows while they were written: ``rows``, their
    number, and the aggregates ``also``. A count of its own would be one more query, each of which keeps some of
    the driver's threads and memory for a while."""
    seen = Observation()
    out = materialized(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[x.alias(k) for k, x in also.items()]), name)
    # Of a plan that Spark finds empty nothing is seen.
    return out, {"rows": 0, **dict.fromkeys(also), **seen.get}


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if its rows, counted first unless known, stay under BROADCAST_ROWS; else as it
    is, so that Spark shuffles. For written tables, where a count is cheap."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


__all__ = ["BROADCAST_ROWS", "FOLDS", "by_number", "by_text", "counted", "held_out", "materialized", "send_code", "small", "strings", "table", "text_batches"]
