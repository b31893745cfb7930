"""Sinks: raw files, the export set, reports, protected columns, partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File set of an export run.
EXPORTS = (
    "predictions_summary", "predictions_forecast_weekly", "predictions_historical",
    "predictions_alerts", "predictions_risk_bands",
)


def write_raw(df: DataFrame, path: str, fmt: str = "csv") -> bool:
    """Write unless empty; tells whether anything was written."""
    if df.isEmpty():
        return False
    writer = df.write.mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)
    return True


def write_exports(tables: dict[str, DataFrame], folder: str) -> None:
    """One CSV folder per table. Empty tables are written too, so that no
    earlier alerts stay behind."""
    unknown = set(tables) - set(EXPORTS)
    if unknown:
        raise ValueError(f"unknown exports: {sorted(unknown)}")
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def write_report(report: DataFrame, path: str) -> None:
    """The one-row nested training report as JSON."""
    report.write.mode("overwrite").json(path)


def write_panel(df: DataFrame, path: str, partition: str = "year") -> None:
    df.write.mode("overwrite").partitionBy(partition).parquet(path)


def refresh_partitions(df: DataFrame, path: str, partitions: list[str]) -> None:
    """Replace just the partitions that ``df`` holds; the rest stays."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )


def encrypt(column: Column, key: Column, mode: str = "GCM") -> Column:
    """Base64 of the AES-encrypted value; a new vector each time.

    ``key`` is a column, so that it can come from a secret table instead of
    standing as a literal in the plan.
    """
    padding = F.lit("PKCS") if mode == "CBC" else F.lit("DEFAULT")
    return F.base64(F.aes_encrypt(column, key, F.lit(mode), padding))


def decrypt(column: Column, key: Column, mode: str = "GCM") -> Column:
    """The plain value; a wrong key or, with GCM, any tampering is an error."""
    padding = F.lit("PKCS") if mode == "CBC" else F.lit("DEFAULT")
    return F.aes_decrypt(F.unbase64(column), key, F.lit(mode), padding).cast("string")


def protect_columns(df: DataFrame, columns: list[str], key: Column, mode: str = "GCM") -> DataFrame:
    return df.withColumns({c: encrypt(F.col(c).cast("string"), key, mode) for c in columns})


def reveal_columns(df: DataFrame, columns: list[str], key: Column, mode: str = "GCM") -> DataFrame:
    return df.withColumns({c: decrypt(F.col(c), key, mode) for c in columns})
