"""Physical plans: shuffles, pushdown, and no Python in the built-in queries."""

import re

import pytest

from panelcast.catalog import ORACLES, QUERIES, bindings as B
from panelcast.operators.cleaning import dedup_first
from panelcast.operators.reports import overview
from panelcast.operators.windows import latest_row, tail_rows
from panelcast.plans.features import FeaturePipeline, FeaturePipelineModel, add_features, clean
from panelcast.session import materialized


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def panel(spark, sf):
    return materialized(B.panel(spark, sf), "panel")


def test_all_window_features_share_one_shuffle(panel):
    text = plan(add_features(panel, B.SPEC))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert len(re.findall(r"\bSort \[", text)) == 1


def test_latest_row_combines_before_the_shuffle(panel):
    text = plan(latest_row(panel))
    assert "partial_max_by" in text and "Window" not in text


def test_dedup_combines_before_the_shuffle(panel):
    assert "partial_min_by" in plan(dedup_first(panel, B.SPEC.key, ["date"]))


def test_tail_is_limited_before_the_shuffle(panel):
    text = plan(tail_rows(panel, 12))
    assert text.count("WindowGroupLimit") == 2


def test_scans_read_only_what_they_need(spark, sf):
    text = plan(B.climate_weeks(spark, sf))
    lineitem = next(x for x in text.splitlines() if "l_shipdate" in x and "FileScan" in x)
    assert "l_extendedprice" not in lineitem and "l_returnflag" not in lineitem


def test_partition_of_history_is_pruned(spark, panel, tmp_path):
    path = str(tmp_path / "p")
    panel.write.partitionBy("year").parquet(path)
    text = plan(spark.read.parquet(path).where("year = 1995 and cases > 3").select("province"))
    assert re.search(r"PartitionFilters: \[[^\]]*1995", text)
    assert "PushedFilters: [IsNotNull(cases), GreaterThan(cases,3)]" in text


@pytest.mark.parametrize(
    "name",
    ["master_panel", "lag_features", "rolling_std", "sequences", "tail_sequence_pad_edge", "overview",
     "describe", "corr_matrix", "forecast_summary", "event_windows", "customer_features", "upload_upsert"],
)
def test_no_python_and_no_cross_join(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    for word in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroups", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text, word


def test_every_query_with_a_twin_is_registered():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 90


def test_pipeline_state_round_trip(spark, panel, tmp_path):
    small = panel.where("province in ('NATION_1', 'NATION_2')")
    model = FeaturePipeline(B.SPEC).fit(small)
    model.save(spark, str(tmp_path / "state"))
    loaded = FeaturePipelineModel.load(spark, str(tmp_path / "state"), B.SPEC)
    assert loaded.caps == model.caps and loaded.ranges == model.ranges and loaded.target_range == model.target_range
    made = loaded.transform(small)
    assert made.exceptAll(model.transform(small)).count() == 0
    nulls = made.selectExpr(*[f"count_if({c} is null) as {c}" for c in model.feature_columns()]).first()
    assert sum(nulls) == 0
    assert made.selectExpr("min(outbreak_risk_index)", "max(outbreak_risk_index)").first()[:] == (0.0, 1.0)


def test_transform_does_not_refit(spark, panel):
    model = FeaturePipeline(B.SPEC).fit(panel.where("year < 1996"))
    one = panel.where("province = 'NATION_1'")
    alone = model.transform(one).select("date", "cases")
    among = model.transform(panel).where("province = 'NATION_1'").select("date", "cases")
    assert alone.exceptAll(among).count() == 0


def test_knn_pipeline(spark, panel):
    small = panel.where("province in ('NATION_1', 'NATION_2')")
    model = FeaturePipeline(B.SPEC, imputer="knn").fit(small)
    made = model.transform(small)
    assert made.count() == clean(small, B.SPEC).count()
    assert made.where("cases_lag12w is null or enso_index is null").count() == 0


def test_risk_is_in_range(panel):
    low, high, rows, keys = panel.selectExpr(
        "min(outbreak_risk_index)", "max(outbreak_risk_index)", "count(*)", "count(distinct province, year, week)"
    ).first()
    assert 0 <= low and high <= 100 and rows == keys


def test_overview_counts(panel):
    last = latest_row(panel).withColumnRenamed("outbreak_risk_index", "risk")
    assert overview(last).first()["total_entities"] == 25


def test_the_last_save_decides_the_imputer(spark, panel, tmp_path):
    path = str(tmp_path / "state")
    small = panel.where("province in ('NATION_1', 'NATION_2') and year = 1995")
    for kind, name in (("knn", "KnnImputer"), ("mean", "MeanImputer"), ("knn", "KnnImputer")):
        FeaturePipeline(B.SPEC, kind).fit(small).save(spark, path)
        assert type(FeaturePipelineModel.load(spark, path, B.SPEC).imputer).__name__ == name


def test_scoring_reads_the_tail_and_serves_short_series(spark, panel):
    from panelcast.plans.prediction import REACH, scoring_rows
    from panelcast.operators.windows import tail_sequence

    tail = scoring_rows(panel, B.SPEC)
    assert tail.groupBy("province").count().agg({"count": "max"}).first()[0] == 12 + REACH
    assert "WindowGroupLimit" in plan(tail)
    short = panel.where("province = 'NATION_3'").limit(5)
    assert tail_sequence(short, ["cases"], B.SPEC).selectExpr("size(sequence)").first()[0] == 12


@pytest.mark.parametrize("name", ["overview", "forecast_summary", "forecast_long", "describe", "phase_boxstats"])
def test_the_panel_is_assembled_once(spark, sf, name):
    assert "l_shipdate" not in plan(QUERIES[name](spark, sf))
