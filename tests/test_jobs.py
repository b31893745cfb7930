import json

from panelcast import jobs
from panelcast.catalog import bindings as B
from panelcast.operators.forest import ForestSize
from panelcast.operators.network import NetworkSize
from panelcast.session import materialized
from panelcast.sources.writers import EXPORTS

SMALL = {"forest": ForestSize(trees=3, depth=3), "network": NetworkSize(layers=(8, 4), rounds=2), "folds": 2}


def test_assemble(spark, tmp_path):
    weeks = ["2024-01-01", "2024-01-08"]
    for name in ("Azua", "Duarte"):
        folder = tmp_path / "climate" / f"province={name}"
        folder.mkdir(parents=True)
        (folder / "a.json").write_text("\n".join(
            json.dumps({"date": w, "rainfall_mm": 30.0, "temp_avg_c": 26.0, "humidity_pct": 80.0}) for w in weeks
        ))
    (tmp_path / "cases_2024.csv").write_text("province,week,cases,deaths,severe_cases\nAzua,1,21,0,1\n")
    (tmp_path / "oni.txt").write_text("YR " + " ".join("JFMAMJJASOND") + "\n2024 " + " ".join(["1.5"] * 12) + "\n")
    made = jobs.assemble(
        spark, str(tmp_path / "climate"), str(tmp_path / "cases_2024.csv"), str(tmp_path / "panel"),
        monthly=str(tmp_path / "oni.txt"),
    )
    row = made.where("province = 'Azua' and week = 1").first()
    assert made.count() == 4
    assert (row["cases"], row["incidence_rate_100k"], row["enso_index"]) == (21, 10.0, 1.5)
    # 10/100*40 + 30/300*25 + 6/15*20 + 30/50*10 + 48.3/100*5
    assert row["outbreak_risk_index"] == 22.92
    assert made.where("province = 'Duarte'").selectExpr("sum(cases)").first()[0] == 0


def test_train_check_predict(spark, sf, tmp_path):
    panel = materialized(
        B.panel(spark, sf).where("province in ('NATION_1', 'NATION_2', 'NATION_3')"), "panel"
    )
    models, out = str(tmp_path / "models"), str(tmp_path / "out")
    # Nothing measured yet: train. Measured and good enough: keep.
    assert jobs.check(spark, panel, models, **SMALL)
    assert not jobs.check(spark, panel, models, threshold=0.0, **SMALL)
    report = spark.read.json(f"{models}/report").first()
    assert report["train_samples"] > report["test_samples"] > 0
    forecast = jobs.predict(spark, panel, models, out, "2024-01-01", B.entity_dim(spark, sf))
    assert forecast.count() == 3
    for name in EXPORTS:
        assert spark.read.option("header", True).csv(f"{out}/{name}").columns
    weekly = spark.read.option("header", True).csv(f"{out}/predictions_forecast_weekly")
    assert weekly.count() == 12
    assert {r[0] for r in weekly.select("forecast_date").distinct().collect()} == {
        "2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29"
    }


def test_ingest_then_check(spark, sf, tmp_path):
    # The rules take years from 2000 on.
    later = B.panel(spark, sf).where("province in ('NATION_1', 'NATION_2')").selectExpr("* except (year)", "year + 10 as year")
    panel = materialized(later, "panel")
    row = panel.where("province = 'NATION_1'").orderBy("date").first()
    other = panel.where("province = 'NATION_2'").orderBy("date").first()
    lines = [
        "week,province,year,cases,rainfall_mm", f"{row['week']},NATION_1,{row['year']},777,",
        f"{other['week']},NATION_2,{other['year']},-4,1", "9,NATION_2,2031,many,1",
    ]
    (tmp_path / "up.csv").write_text("\n".join(lines) + "\n")
    args = (panel, str(tmp_path / "up.csv"), str(tmp_path / "out"), str(tmp_path / "models"))
    assert jobs.ingest(spark, *args, **SMALL)
    made = spark.read.parquet(str(tmp_path / "out" / "panel"))
    assert made.count() == panel.count()
    now = made.where("province = 'NATION_1'").orderBy("date").first()
    assert (now["cases"], now["rainfall_mm"]) == (777, row["rainfall_mm"])
    assert spark.read.text(str(tmp_path / "out" / "broken")).count() == 2


def test_scratch_is_cleared(spark):
    from panelcast.session import clear_scratch, run_dir

    path = materialized(spark.range(3), "gone").inputFiles()[0]
    assert run_dir(spark) in path
    assert clear_scratch(spark) and not clear_scratch(spark)
