import datetime as dt
import random

from pyspark.sql import functions as F

from panelcast.operators.suppression import mark_sent
from panelcast.streaming import uploads as S
from panelcast.streaming.alerts import due_alerts, settled_alerts, use_state_store

UPLOAD = "province string, year int, week int, cases long, ts timestamp"


def at(day, hour=0):
    return dt.datetime(2024, 3, day, hour)


def ingest(spark, folder, target, domain):
    stream = spark.readStream.schema(UPLOAD).parquet(folder)
    S.start_ingestion(stream, domain, target, f"{target}/checkpoint").awaitTermination()


def test_uploads_equal_the_batch_form(spark, tmp_path):
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    domain = spark.createDataFrame([("Azua",), ("Duarte",)], "province string")
    first = [
        ("Azua", 2024, 1, 5, at(1)), ("Azua", 2024, 1, 5, at(1, 5)), ("Duarte", 2024, 1, -3, at(1)),
        ("Atlantis", 2024, 1, 2, at(1)), ("Duarte", 2024, 2, 8, at(2)),
    ]
    second = [("Azua", 2024, 1, 9, at(3)), ("Duarte", 2024, 2, 8, at(3))]
    for part in (first, second):
        spark.createDataFrame(part, UPLOAD).coalesce(1).write.mode("append").parquet(folder)
        ingest(spark, folder, target, domain)
    got = S.current_panel(spark, target, ["ts"]).select("province", "week", "cases")
    good, bad = S.check_batch(spark.createDataFrame(first + second, UPLOAD), domain)
    want = S.upsert(good, good.limit(0), ["ts"]).select("province", "week", "cases")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [
        ("Azua", 1, 9), ("Duarte", 2, 8)
    ]
    # Every valid upload is kept, also one that repeats an older content.
    assert spark.read.parquet(f"{target}/log").count() == 5
    failed = {r["province"]: r["failed"] for r in S.quarantined(spark, target).collect()}
    assert failed == {"Duarte": ["cases_nonnegative"], "Atlantis": ["entity_domain"]}
    S.compact(spark, target, str(tmp_path / "small"), ["ts"])
    again = S.current_panel(spark, str(tmp_path / "small"), ["ts"]).select("province", "week", "cases")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, want.collect()))


def test_late_uploads_and_corrections_back_are_kept(spark, tmp_path):
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    domain = spark.createDataFrame([("Azua",)], "province string")
    parts = [
        [("Azua", 2024, 1, 10, at(20)), ("Azua", 2024, 1, 10, at(20))],
        [("Azua", 2024, 1, 20, at(21))],
        [("Azua", 2024, 1, 10, at(22)), ("Azua", 2023, 50, 7, dt.datetime(2023, 12, 20))],
    ]
    for part in parts:
        spark.createDataFrame(part, UPLOAD).coalesce(1).write.mode("append").parquet(folder)
        ingest(spark, folder, target, domain)
    got = S.current_panel(spark, target, ["ts"]).select("year", "week", "cases").collect()
    assert sorted(map(tuple, got)) == [(2023, 50, 7), (2024, 1, 10)]
    assert spark.read.parquet(f"{target}/log").count() == 4


def test_alert_stream_equals_batch_over_two_runs(spark, tmp_path):
    use_state_store(spark)
    rng = random.Random(1)
    data = [(k, rng.randrange(0, 400_000)) for k in ("a", "b", "c") for _ in range(60)]
    data += [("d", 0), ("d", 10000), ("d", 21600), ("d", 21601)]
    rows = spark.createDataFrame(data, "k string, s long").selectExpr("k", "timestamp_seconds(s) as ts", "s")
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows.where("s < 200000"), rows.where("s >= 200000")):
        part.select("k", "ts").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("k string, ts timestamp").parquet(folder)
        run = (
            due_alerts(stream, "k", "ts").writeStream.format("parquet")
            .option("path", f"{target}/sent").option("checkpointLocation", f"{target}/checkpoint")
            .trigger(availableNow=True).start()
        )
        run.awaitTermination()
    sent = {(r["k"], r["ts"]) for r in spark.read.parquet(f"{target}/sent").collect()}
    batch = {(r["k"], r["ts"]) for r in mark_sent(rows, "k", "ts").where(F.col("sent")).collect()}
    assert sent == batch


def test_settled_alerts_equal_batch_whatever_the_order(spark, tmp_path):
    """Moments out of order within the delay, files that come twice, moments later than the delay."""
    use_state_store(spark)
    rng = random.Random(2)
    data = sorted((rng.randrange(0, 400_000), k) for k in ("a", "b", "c") for _ in range(40))
    # In each file some moments of the one before.
    files = [[x for i, x in enumerate(data) if (s := i // 40 + (i % 5 == 0)) == part] for part in range(4)]
    files = [files[0], files[1], files[1], files[2], files[3], [(2_000_000, "end")], [(50, "a")]]
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    for part in files:
        spark.createDataFrame(part, "s long, k string").selectExpr("k", "timestamp_seconds(s) as ts").coalesce(1).write.mode(
            "append").parquet(folder)
    stream = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    settled_alerts(stream, "k", "ts", "3 days").writeStream.format("parquet").option("path", f"{target}/sent").option(
        "checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    sent = [(r["k"], r["ts"]) for r in spark.read.parquet(f"{target}/sent").collect()]
    rows = spark.createDataFrame(data, "s long, k string").selectExpr("k", "timestamp_seconds(s) as ts")
    batch = {(r["k"], r["ts"]) for r in mark_sent(rows, "k", "ts").where(F.col("sent")).collect()}
    assert set(sent) == batch and len(sent) == len(batch)
