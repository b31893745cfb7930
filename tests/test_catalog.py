"""Headline queries against their SQL twins on the smallest tables."""

import pathlib
import sys

import duckdb
import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1] / "tools"))

from check_oracle import TABLES, compare  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

NAMES = [
    "master_panel", "cyclic_features", "week_to_date", "dedup_first", "winsorize", "lag_features", "rolling_std",
    "sequences", "densify", "event_windows", "overview", "seasonal_profile", "describe", "corr_matrix",
    "phase_boxstats", "ensemble_combine", "forecast_summary", "forecast_long", "eval_metrics", "ts_folds",
    "upload_upsert", "alert_suppression", "event_suppression", "knn_impute", "encrypt_roundtrip",
]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    result = compare(df.collect(), types, con, entry.oracle_sql()[name])
    assert result.startswith("ok"), result


def test_entry(spark):
    assert entry.entry(spark).count() > 0
