import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelcast.sources import readers as R
from panelcast.sources import writers as W


def put(path, name, text):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(text, encoding="utf-8")
    return str(path / name)


def test_yearly_cases_by_file_name(spark, tmp_path):
    head = "province,week,cases,deaths,severe_cases\n"
    put(tmp_path / "c", "cases_2019.csv", head + "Azua,1,5,0,1\n")
    put(tmp_path / "c", "cases_2020.csv", head + "Azua,1,7,0,1\n")
    got = R.read_yearly_cases(spark, str(tmp_path / "c")).orderBy("year").collect()
    assert [(r["year"], r["cases"]) for r in got] == [(2019, 5), (2020, 7)]


def test_yearly_cases_by_folder(spark, tmp_path):
    head = "province,week,cases,deaths,severe_cases\n"
    put(tmp_path / "c" / "year=2021", "part.csv", head + "Azua,1,5,0,1\n")
    assert R.read_yearly_cases(spark, str(tmp_path / "c")).first()["year"] == 2021


def test_climate(spark, tmp_path):
    line = '{"date":"%s","rainfall_mm":1.5,"humidity_pct":70.0}\n'
    put(tmp_path / "k" / "province=Azua", "a.json", line % "2024-01-01" + line % "2024-06-03")
    put(tmp_path / "k" / "province=Duarte", "a.json", line % "2024-06-03")
    path = str(tmp_path / "k")
    assert R.read_climate(spark, path).count() == 3
    assert R.read_climate(spark, path, entity="Azua").count() == 2
    assert R.read_climate(spark, path, weeks=4).count() == 2


def test_demographics_fallback(spark):
    dim = R.read_demographics(spark)
    assert dim.count() == 32
    row = dim.where("province = 'Distrito Nacional'").first()
    assert row["population_density_km2"] == pytest.approx(1078000 / 91)
    assert row["sanitation_index"] == pytest.approx(100 - 18.2 * 0.6)


def test_monthly_text(spark, tmp_path):
    months = " ".join(str(m / 10) for m in range(1, 13))
    text = f"header of the file J F M A M J J A S O N D\n2020 {months}\n 2021  -9.9 x {months[8:]} 7 8\nshort line\n"
    path = put(tmp_path, "oni.txt", text)
    got = R.read_monthly_text(spark, path)
    assert got.where("year = 2020").count() == 12
    assert got.where("year = 2021 and month = 2").count() == 0
    assert got.where("year = 2021 and month = 1").first()["enso_index"] == -9.9


def test_concat_keeps_duplicates_and_fills(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([(1,)], "i int")
    got = R.concat_sources([a, b, b])
    assert got.count() == 3 and got.where("s is null").count() == 2


def test_upload_csv(spark, tmp_path):
    path = put(tmp_path, "up.csv", "week,province,year,cases,note\n1,Azua,2024,5,ok\n2,Azua,2024,many,bad\n")
    good, bad = R.read_upload_csv(spark, path)
    assert [tuple(r) for r in good.select("province", "year", "week", "cases").collect()] == [("Azua", 2024, 1, 5)]
    assert "many" in bad.first()["record"]


def test_upload_csv_refusals(spark, tmp_path):
    with pytest.raises(ValueError, match="csv"):
        R.read_upload_csv(spark, str(tmp_path / "up.txt"))
    path = put(tmp_path, "few.csv", "province,year\nAzua,2024\n")
    with pytest.raises(ValueError, match="cases"):
        R.read_upload_csv(spark, path)


def test_upload_json_list(spark, tmp_path):
    path = put(tmp_path, "up.json", '[{"province":"Azua","year":2024,"week":1,"cases":5},\n{"province":"Duarte","year":2024,"week":1,"cases":6}]')
    good, bad = R.read_upload_json(spark, path)
    assert good.agg(F.sum("cases")).first()[0] == 11 and bad.count() == 0


def test_upload_json_of_lines_and_lists(spark, tmp_path):
    lines = "".join(f'{{"province":"Azua","year":2024,"week":{w},"cases":{w}}}\n' for w in range(1, 6))
    put(tmp_path / "j", "lines.json", lines + '{"province":"Azua","week":"many"}\nnot json\n\n')
    put(tmp_path / "j", "list.json", ' \n[{"province":"Duarte","year":2024,"week":9,"cases":6},\n {"week":"x"}]')
    put(tmp_path / "j", "cut.json", '[{"province":"Duarte"')
    good, bad = R.read_upload_json(spark, str(tmp_path / "j"))
    assert sorted((r["province"], r["week"], r["cases"]) for r in good.collect()) == [
        ("Azua", w, w) for w in range(1, 6)
    ] + [("Duarte", 9, 6)]
    assert len(bad.collect()) == 4


def test_panel_csv_by_name(spark, tmp_path):
    put(tmp_path / "p", "a.csv", "cases,week,province,year,note\n7,1,Azua,2024,x\n8.0,2,Azua,2024,\n")
    put(tmp_path / "p", "b.csv", "province,year,week,date,rainfall_mm\nDuarte,2024,1,2024-01-01,many\n")
    got = R.read_panel(spark, str(tmp_path / "p"), "csv").select("province", "week", "cases", "rainfall_mm", "date")
    rows = sorted((r["province"], r["week"], r["cases"], r["rainfall_mm"], str(r["date"])) for r in got.collect())
    assert rows == [("Azua", 1, 7, None, "None"), ("Azua", 2, 8, None, "None"), ("Duarte", 1, None, None, "2024-01-01")]
    put(tmp_path / "q", "c.csv", "province,week,cases\nAzua,1,7\n")
    with pytest.raises(ValueError, match="year"):
        R.read_panel(spark, str(tmp_path / "q"), "csv")


def test_case_files_with_their_own_year(spark, tmp_path):
    put(tmp_path / "c", "cases_2019.csv", "province,year,week,cases,deaths,severe_cases\nAzua,2018,5,9,1,2\n")
    put(tmp_path / "c", "cases_2020.csv", "week,province,cases\n3,Azua,4\n")
    got = R.read_yearly_cases(spark, str(tmp_path / "c")).orderBy("year").collect()
    assert [tuple(r[c] for c in ("province", "year", "week", "cases", "severe_cases")) for r in got] == [
        ("Azua", 2018, 5, 9, 2), ("Azua", 2020, 3, 4, None)
    ]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1)], "x double, i int")
    assert R.no_nan(df).first()["x"] is None


def test_raw_sink_skips_empty(spark, tmp_path):
    df = spark.createDataFrame([("Azua", 1)], "province string, n int")
    path = str(tmp_path / "raw")
    assert not W.write_raw(df.where("n > 1"), path)
    assert W.write_raw(df, path)
    assert spark.read.option("header", True).csv(path).count() == 1


def test_empty_alerts_replace_old_ones(spark, tmp_path):
    df = spark.createDataFrame([("Azua", 70.0)], "province string, risk double")
    folder = str(tmp_path / "out")
    W.write_exports({"predictions_alerts": df}, folder)
    W.write_exports({"predictions_alerts": df.where("risk > 90")}, folder)
    assert spark.read.option("header", True).csv(f"{folder}/predictions_alerts").count() == 0
    with pytest.raises(ValueError):
        W.write_exports({"other": df}, folder)


def test_refresh_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([(2023, 1, "old"), (2024, 1, "old")], "year int, week int, v string")
    df.write.partitionBy("year", "week").parquet(path)
    W.refresh_partitions(df.where("year = 2024").withColumn("v", F.lit("new")), path, ["year", "week"])
    assert {r["year"]: r["v"] for r in spark.read.parquet(path).collect()} == {2023: "old", 2024: "new"}


@pytest.mark.parametrize("mode", ["GCM", "CBC"])
def test_protection(spark, mode):
    df = spark.createDataFrame([("Azua", "k" * 32)], "name string, key string")
    hidden = W.protect_columns(df, ["name"], F.col("key"), mode)
    assert hidden.first()["name"] != "Azua"
    assert W.reveal_columns(hidden, ["name"], F.col("key"), mode).first()["name"] == "Azua"
    with pytest.raises(PySparkException):
        W.reveal_columns(hidden, ["name"], F.lit("w" * 32), mode).collect()


def test_tampering_is_detected(spark):
    df = spark.createDataFrame([("Azua", "k" * 32)], "name string, key string")
    hidden = W.protect_columns(df, ["name"], F.col("key"))
    broken = hidden.withColumn("name", F.concat(F.lit("AAAA"), F.substring("name", 5, 400)))
    with pytest.raises(PySparkException):
        W.reveal_columns(broken, ["name"], F.col("key")).collect()


def test_panel_partitions_and_report(spark, tmp_path):
    df = spark.createDataFrame([(2023, 1.0), (2024, 2.0)], "year int, x double")
    W.write_panel(df, str(tmp_path / "panel"))
    assert spark.read.parquet(str(tmp_path / "panel")).where("year = 2024").first()["x"] == 2.0
    W.write_report(df.limit(1).select(F.struct("year", "x").alias("m")), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first()["m"]["year"] == 2023
    W.write_raw(df, str(tmp_path / "latest"), "parquet")
    assert R.read_latest_predictions(spark, str(tmp_path / "latest")).count() == 2
