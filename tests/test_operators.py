import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelcast.operators import assemble as A
from panelcast.operators import cleaning as C
from panelcast.operators import quantiles as Q
from panelcast.operators import reports as P
from panelcast.operators import gram
from panelcast.operators import suppression as S
from panelcast.operators import validate as V
from panelcast.operators import windows as W
from panelcast.operators.blocks import Blocks, apply_in_blocks
from panelcast.operators.forecast import combine_members, forecast_struct
from panelcast.operators.incremental import dirty_rows, refreshed
from panelcast.operators.impute import KnnImputer, MeanImputer
from panelcast.operators.ranking import global_rank, running_total
from panelcast.operators.scaling import apply_ranges, fit_ranges, inverse
from panelcast.operators.scans import carry_scan
from panelcast.operators.split import expanding_folds, time_split
from panelcast.sources.reference_data import entity_dimension
from panelcast.spec import PanelSpec, align_schema, numeric_columns

SPEC = PanelSpec()


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_dedup_of_wrapped_weeks(spark):
    weeks = spark.range(104).selectExpr(
        "'x' as province", "date_add(date'2024-01-01', cast(7 * id as int)) as date",
        "year(date_add(date'2024-01-01', cast(7 * id as int))) as year", "int(id % 52 + 1) as week",
    )
    kept = C.dedup_first(weeks, SPEC.key, ["date"])
    assert kept.count() == 103
    assert kept.where("date = '2024-12-30'").count() == 0
    assert C.dedup_first(kept, SPEC.key, ["date"]).count() == 103
    assert tuple(C.dedup_summary(weeks, SPEC.key).first()) == (104, 103, 1)


def test_clip_spares_the_centred_index(spark):
    df = spark.createDataFrame([(-1, -0.5, None)], "cases int, enso_index double, x double")
    assert tuple(C.clip_negative(df).first()) == (0, -0.5, None)
    assert tuple(C.clip_negative(df, exclude=()).first()) == (0, 0.0, None)
    assert C.clip_negative(df).schema == df.schema


def test_quantiles_equal_numpy(spark):
    rng = random.Random(3)
    values = [round(rng.gauss(50, 20), 1) for _ in range(30000)] + [50.0] * 15000
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = {r["prob"]: r["value"] for r in Q.exact_quantiles(df, ["v"], [0.0, 0.25, 0.5, 0.995, 1.0]).collect()}
    for p, v in got.items():
        assert v == pytest.approx(np.quantile(values, p), abs=1e-9), p


def test_quantiles_end_on_any_data(spark):
    """Neighbouring doubles with many ties, tails over the whole range, zeros of both signs, groups and columns."""
    rng = random.Random(4)
    up = float(np.nextafter(25.0, 26.0))
    tails = [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-320, 308) for _ in range(3001)]
    frames = {"ties": [25.0] * 1500 + [up] * 1501, "tails": tails, "zeros": [0.0, -0.0] * 1500 + [5e-324]}
    rows = [("g", *r) for r in zip(*frames.values())] + [("h", 1.0, None, float("nan")), ("h", 2.0, None, float("inf")),
                                                        (None, 9.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "g string, ties double, tails double, zeros double")
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r["g"], r["column"], r["prob"]): r["value"] for r in Q.exact_quantiles(df, list(frames), probs, ["g"]).collect()}
    for name, values in frames.items():
        ordered = sorted(values)
        for p in probs:
            assert got["g", name, p] == ordered[int(p * 3000)], (name, p)
    assert got["h", "ties", 0.5] == 1.5 and got["h", "zeros", 0.5] == float("inf") and ("h", "tails", 0.5) not in got
    assert Q.exact_quantiles(df.limit(0), ["ties"], probs).count() == 0


def test_keys_keep_the_order_of_doubles(spark):
    rng = random.Random(5)
    values = [rng.choice([-1, 1]) * x for x in (2.0**np.arange(-1074, 1024)).tolist()]
    values += [np.nextafter(v, s) for v in values for s in (-np.inf, np.inf)] + [0.0, -0.0, float("inf"), -float("inf")]
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", Q.ordered_key(F.col("v")).alias("key"))
    for v, key in rows.collect():
        bits = int(np.float64(abs(v)).view("i8"))
        assert key == (-bits if v < 0 else bits), v


def test_caps(spark):
    df = spark.range(1, 1001).selectExpr("cast(id as double) as cases")
    caps = C.fit_caps(df)
    assert caps["cases"] == pytest.approx(np.quantile(np.arange(1, 1001), 0.995))
    assert C.apply_caps(df, caps).agg(F.max("cases")).first()[0] == pytest.approx(caps["cases"])


def test_rolling_of_one_row(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1), 5.0)], "province string, date date, cases double")
    row = W.add_rolling(df).first()
    assert row["cases_roll4w_mean"] == 5.0 and row["cases_roll4w_std"] == 0.0


def test_merged_rolling_equals_plain(spark, series):
    gaps = series.withColumn("cases", F.expr("if(cases > 17, null, cases + 1e6)"))
    w = SPEC.window(gaps)
    plain = W.rolling_mean_columns(w, ["cases"]) | W.rolling_std_columns(w, ["cases"])
    want = gaps.select("province", "date", *[c.alias(n) for n, c in plain.items()])
    got = W.add_rolling(gaps, columns=("cases",)).select(*want.columns)
    for a, b in zip(rows(got, "province", "date"), rows(want, "province", "date")):
        assert a[2:] == pytest.approx(b[2:], rel=1e-9, abs=1e-7)


def test_odd_lengths_slide_on_their_own(series):
    made = W.add_rolling(series, columns=("cases",), windows=(3, 4)).where("province = 'b'").orderBy("date")
    assert made.collect()[1]["cases_roll3w_mean"] == 3.5


def test_windows_stay_in_the_entity(series):
    first = W.add_lags(series, columns=("cases",), lags=(1,)).where("date = '2020-01-06'")
    assert [r["cases_lag1w"] for r in first.collect()] == [None, None]


def test_targets(series):
    assert W.add_targets(series).count() == 103 - 4 + 15 - 4
    held = W.add_targets(series, tail="hold")
    assert held.count() == 118
    last = held.where("province = 'b'").orderBy(F.desc("date")).first()
    assert last["target_week_1"] == last["outbreak_risk_index"]


def test_sequences(series):
    made = W.sequences(series, ["cases"])
    assert {r[0]: r[1] for r in made.groupBy("province").count().collect()} == {"a": 88}
    assert W.sequences(series, ["cases"], length=12, horizon=3).where("province = 'b'").count() == 1
    row = made.orderBy("date").first()
    assert [x[0] for x in row["sequence"]] == [float((i * 7) % 23) for i in range(12)]
    assert row["targets"] == [float((i * 5) % 17) for i in range(12, 16)]


def test_padding(spark):
    df = spark.createDataFrame(
        [("a", dt.date(2024, 1, 1), 1.0), ("a", dt.date(2024, 1, 8), 2.0)], "province string, date date, x double"
    )
    flat = lambda pad: [v[0] for v in W.tail_sequence(df, ["x"], length=4, pad=pad).first()["sequence"]]
    assert flat("edge") == [1, 1, 1, 2]
    assert flat("zero") == [0, 0, 1, 2]


def test_densify(spark):
    df = spark.createDataFrame(
        [("a", dt.date(2024, 1, 1), 1), ("a", dt.date(2024, 1, 22), 4), ("b", dt.date(2024, 1, 8), 9)],
        "province string, date date, cases int",
    )
    got = rows(W.densify(df).select("province", "date", "cases", "is_filled"), "province", "date")
    assert [(r[1].day, r[2], r[3]) for r in got] == [
        (1, 1, False), (8, None, True), (15, None, True), (22, 4, False), (8, 9, False)
    ]


@pytest.mark.parametrize("size", [13, 50, 1000])
def test_blocks_equal_plain_windows(spark, size):
    df = spark.range(700).selectExpr("'hot' as k", "id", "cast(id * 37 % 101 as double) as v", "int(id / 90) as c").unionByName(
        spark.range(5).selectExpr("'cold' as k", "id", "cast(id as double) as v", "int(id) as c")
    )

    def build(w):
        return {
            "lag": F.lag("v", 12).over(w), "lead": F.lead("v", 4).over(w),
            "mean": F.avg("v").over(w.rowsBetween(-11, 0)),
        }

    plain = df.withColumns(build(Window.partitionBy("k").orderBy("id")))
    cut = apply_in_blocks(df, "k", ["id"], build, Blocks(F.col("c"), size), back=12, ahead=4)
    assert rows(cut, "k", "id") == rows(plain, "k", "id")


def test_block_must_hold_its_frames(spark):
    with pytest.raises(ValueError):
        apply_in_blocks(spark.range(3), "id", ["id"], lambda w: {}, Blocks(F.lit(1), 5), back=5)


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0)], "a double, b double")
    ranges = fit_ranges(df, ["a", "b"])
    scaled = apply_ranges(df, ranges)
    assert rows(scaled, "a") == [(0.0, 0.0), (1.0, 0.0)]
    assert rows(scaled.select(inverse(F.col("a"), *ranges["a"]).alias("a")), "a") == [(1.0,), (3.0,)]


def brute_knn(x, k):
    n, f = x.shape
    out = x.copy()
    for i in range(n):
        for c in range(f):
            if not np.isnan(x[i, c]):
                continue
            near = []
            for j in range(n):
                both = ~np.isnan(x[i]) & ~np.isnan(x[j])
                if np.isnan(x[j, c]) or not both.any():
                    continue
                near.append((math.sqrt(f / both.sum() * ((x[i] - x[j])[both] ** 2).sum()), j))
            near.sort()
            out[i, c] = np.mean([x[j, c] for _, j in near[:k]])
    return out


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(0, 30, 250), rng.normal(0, 10, 250), rng.normal(0, 5, 250), rng.normal(0, 1, 250)])
    # A far outlier, copies of one row, and gaps in the last two columns.
    x[0, :2] = (900.0, -400.0)
    x[1:40] = x[1]
    x[rng.random(250) < 0.2, 2] = np.nan
    x[rng.random(250) < 0.2, 3] = np.nan
    x[0, 2] = np.nan
    names = ["p", "q", "r", "s"]
    data = [(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)]
    df = spark.createDataFrame(data, "id int, p double, q double, r double, s double")
    imputer = KnnImputer(names).fit(df)
    assert imputer.pivots == ["p", "q"]
    got = np.array([r[1:] for r in rows(imputer.transform(df, ["id"]), "id")])
    assert np.allclose(got, brute_knn(x, 5))


def test_knn_within_blocks_equals_brute_force_of_each(spark):
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.normal(0, 30, 120), rng.normal(0, 10, 120), rng.normal(0, 5, 120)])
    x[rng.random(120) < 0.2, 2] = np.nan
    group = np.arange(120) % 3
    data = [(i, int(g), *[None if np.isnan(v) else float(v) for v in row]) for i, (g, row) in enumerate(zip(group, x))]
    df = spark.createDataFrame(data, "id int, g int, p double, q double, r double")
    imputer = KnnImputer(["p", "q", "r"], block=["g"]).fit(df)
    got = np.array([r[2:] for r in rows(imputer.transform(df, ["id"]), "id")])
    for g in range(3):
        assert np.allclose(got[group == g], brute_knn(x[group == g], 5))


def test_imputers_keep_known_values_and_save(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 4.0), (3, 3.0, 6.0)], "id int, a double, b double")
    assert rows(MeanImputer(["b"]).fit(df).transform(df), "id") == [(1, 1.0, 5.0), (2, 2.0, 4.0), (3, 3.0, 6.0)]
    fitted = KnnImputer(["a", "b"], k=1).fit(df)
    fitted.save(spark, str(tmp_path / "knn"))
    loaded = KnnImputer.load(spark, str(tmp_path / "knn"))
    assert rows(loaded.transform(df, ["id"]), "id") == [(1, 1.0, 4.0), (2, 2.0, 4.0), (3, 3.0, 6.0)]
    with pytest.raises(AnalysisException):
        KnnImputer.load(spark, str(tmp_path / "none"))


def test_knn_needs_a_complete_pivot(spark):
    df = spark.createDataFrame([(1, None, 1.0)], "id int, a double, b double")
    with pytest.raises(ValueError):
        KnnImputer(["a", "b"], pivots=["a"]).fit(df)


def brute_sent(times, interval):
    sent, last = [], None
    for t in sorted(set(times)):
        if last is None or t - last > interval:
            sent.append(t)
            last = t
    return sent


def marked(spark, data, **kw):
    df = spark.createDataFrame(data, "k string, s long").selectExpr("k", "s", "timestamp_seconds(s) as ts")
    return {(r["k"], r["s"]) for r in S.mark_sent(df, "k", "ts", **kw).where("sent").collect()}


def test_suppression_is_strict_and_counts_from_the_sent(spark):
    data = [("a", 0), ("a", 10000), ("a", 21600), ("a", 21601), ("b", 5)]
    assert marked(spark, data) == {("a", 0), ("a", 21601), ("b", 5)}


@pytest.mark.parametrize(("fan", "session"), [(2, 2), (64, 20), (64, 10_000)])
@pytest.mark.parametrize("chunk", [1, 28])
def test_suppression_equals_brute_force(spark, monkeypatch, chunk, fan, session):
    monkeypatch.setattr(S, "FAN", fan)
    monkeypatch.setattr(S, "SESSION_ROWS", session)
    rng = random.Random(chunk)
    data = [("hot", rng.randrange(0, 4_000_000)) for _ in range(3000)]
    data += [("dense", i * 60) for i in range(2000)]
    data += [("rare", i * 700_000) for i in range(6)] + [("rare", 3), ("rare", -50_000), ("rare", -3)]
    want = {
        (k, t) for k in ("hot", "dense", "rare") for t in brute_sent([s for n, s in data if n == k], 21600)
    }
    assert marked(spark, data, chunk_intervals=chunk) == want


def test_seasonal_deviation_of_large_totals(spark):
    data = [(f"{y}-01-05", 1e12 + d) for y, d in ((2020, 0.0), (2021, 1.0), (2022, 3.0))] + [("2021-02-01", 6.0)]
    df = spark.createDataFrame(data, "day string, v double").selectExpr("date(day) as date", "v")
    got = {r["month"]: (r["mean"], r["std"]) for r in P.seasonal_profile(df, "v").collect()}
    assert got[1] == (pytest.approx(1e12 + 4 / 3, abs=1e-3), pytest.approx(np.std([0, 1, 3], ddof=1), rel=1e-3))
    assert got[2] == (2.0, pytest.approx(np.std([0, 6, 0], ddof=1)))


def test_correlation_is_pairwise_complete(spark):
    rng = random.Random(8)
    data = [(rng.gauss(1e6, 1), rng.gauss(0, 1) if rng.random() < 0.8 else None, 3.0) for _ in range(300)]
    data = [(a, b if b is None else b + a - 1e6, c) for a, b, c in data]
    df = spark.createDataFrame(data, "a double, b double, c double")
    got = {(r["column_a"], r["column_b"]): r["r"] for r in P.correlation_matrix(df, ["a", "b", "c"]).collect()}
    full = np.array([(a, b) for a, b, _ in data if b is not None])
    assert got["a", "b"] == got["b", "a"] == pytest.approx(np.corrcoef(full.T)[0, 1], abs=1e-9)
    assert got["a", "a"] == pytest.approx(1.0) and got["a", "c"] is None and got["c", "c"] is None


def test_normalize_and_lookup(spark):
    dim = entity_dimension(spark)
    raw = spark.createDataFrame([(" san josé DE ocoa ",), ("Atlantis",)], "raw string")
    got = dict(rows(A.normalize_entity(raw, dim, "raw").select("raw", "province"), "raw"))
    assert got == {" san josé DE ocoa ": "San José de Ocoa", "Atlantis": None}
    assert A.lookup_entity(dim, "AZUA", dim).count() == 1
    with pytest.raises(LookupError):
        A.lookup_entity(dim, "Atlantis", dim)


def test_lookup_defaults(spark):
    df = spark.createDataFrame([("Azua",), ("Atlantis",)], "province string")
    got = {r["province"]: (r["province_code"], r["latitude"]) for r in A.with_entity_lookup(df, entity_dimension(spark)).collect()}
    assert got == {"Azua": ("RD01", 18.45), "Atlantis": ("RD00", 18.7)}


def test_missing_member_gives_the_other(spark):
    schema = "province string, horizon int, value double"
    a = spark.createDataFrame([("x", h, 120.0) for h in range(1, 5)] + [("y", 1, 50.0)], schema)
    b = spark.createDataFrame([("y", 1, 100.0), ("z", 1, 10.0)], schema)
    got = {(r["province"], r["horizon"]): r["ensemble"] for r in combine_members({"rf": a, "mlp": b}).collect()}
    assert got[("x", 1)] == 100.0 and got[("y", 1)] == 70.0 and got[("z", 1)] == 10.0


def test_forecast_struct(spark):
    schema = "province string, horizon int, value double"
    a = spark.createDataFrame([("x", h, v) for h, v in enumerate([30.0, 70.0, 70.0, 40.0], 1)], schema)
    row = forecast_struct(combine_members({"rf": a, "mlp": a})).first()
    assert (row["risk_index"], row["peak_risk"], row["peak_week"], row["trend"]) == (30.0, 70.0, 2, "Ascendente")
    assert tuple(row["forecast"]) == (30.0, 70.0, 70.0, 40.0)


def test_split_is_chronological(series):
    made = time_split(series)
    bounds = {r["split"]: (r["a"], r["b"]) for r in made.groupBy("split").agg(F.min("date").alias("a"), F.max("date").alias("b")).collect()}
    assert bounds["train"][1] < bounds["val"][0] <= bounds["val"][1] < bounds["test"][0]
    assert made.count() == 118


def test_row_split_counts(series):
    made = time_split(series, mode="row")
    assert {r[0]: r[1] for r in made.groupBy("split").count().collect()} == {"train": 84, "val": 17, "test": 17}


def test_folds(series):
    bounds = expanding_folds(series).orderBy("fold").collect()
    assert len(bounds) == 5
    assert bounds[-1]["test_end"] == series.agg(F.max("date")).first()[0]
    assert all(a["test_end"] < b["test_start"] for a, b in zip(bounds, bounds[1:]))


def test_correlation_of_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, None)], "a double, b double")
    got = {(r[0], r[1]): r[2] for r in P.correlation_matrix(df, ["a", "b"]).collect()}
    assert got[("a", "a")] == pytest.approx(1.0) and got[("a", "b")] is None and len(got) == 4


def test_validation(spark):
    df = spark.createDataFrame(
        [("a", 2024, 1, 5, 10.0), ("a", 1999, 54, -1, 101.0), ("zz", 2024, 2, 1, None)],
        "province string, year int, week int, cases int, humidity_pct double",
    )
    good, bad = V.split_valid(df, V.upload_rules(df))
    assert good.count() == 2
    assert bad.first()["failed"] == ["year_range", "week_range", "cases_nonnegative", "humidity_range"]
    domain = spark.createDataFrame([("a",)], "province string")
    assert V.check_domain(df, domain, "quarantine").count() == 2
    with pytest.raises(ValueError, match="zz"):
        V.check_domain(df, domain)
    with pytest.raises(ValueError, match="week"):
        V.require_columns(df.drop("week"))


def test_columns(spark):
    df = spark.createDataFrame([("a", 1, 2.0)], "s string, i int, d double")
    assert numeric_columns(df, ["i"]) == ["d"]
    assert rows(align_schema(df, ["d", "missing"]), "d") == [(2.0, 0.0)]


def test_threshold(spark):
    df = spark.createDataFrame([("a", 64.9), ("b", 65.0)], "province string, risk double")
    assert rows(P.threshold_alerts(df, "risk"), "province") == [("b", 65.0)]


def test_global_rank_and_running_total(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(50)]), i, rng.randrange(9)) for i in range(500)] + [(3, 7, 1)] * 40
    df = spark.createDataFrame(rows, "a int, b int, n int").repartition(5)
    got = global_rank(df, [F.desc("a"), F.asc("b")]).orderBy("rank").collect()
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r["a"], r["b"]) for r in got] == [w[:2] for w in want] and [r["rank"] for r in got] == list(range(1, 541))
    total = running_total(df, [F.desc("a"), F.asc("b")], F.col("n"), "upto").groupBy("a", "b").agg(F.max("upto").alias("m"))
    ends = {}
    for w, upto in zip(want, np.cumsum([w[2] for w in want])):
        ends[w[:2]] = int(upto)
    assert {(r["a"], r["b"]): r["m"] for r in total.collect()} == ends
    assert global_rank(df.limit(0), ["a"]).count() == 0


def test_carry_scan_equals_one_window(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "x", "y"]), i, rng.choice([None, None, i])) for i in range(400)] + [("z", 1, None)]
    df = spark.createDataFrame(rows, "k string, t int, v int")
    blocks = Blocks(chunk=F.floor(F.col("t") / 30), rows=7)
    made = carry_scan(df, "k", ["t"], blocks, {"fill": F.col("v")}, {"total": F.col("v")})
    got = {(r["k"], r["t"]): (r["fill"], r["total"]) for r in made.collect()}
    state, want = {}, {}
    for k, t, v in sorted(rows, key=lambda r: (r[0], r[1])):
        fill, total = state.get(k, (None, None))
        state[k] = want[k, t] = (fill, total) if v is None else (v, (total or 0) + v)
    assert got == want and set(made.columns) == {"k", "t", "v", "fill", "total"}


@pytest.mark.parametrize("block", [3, 16])
def test_wide_correlation_equals_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(gram, "BLOCK_COLUMNS", block)
    rng = random.Random(10)
    rows = []
    for i in range(300):
        a = rng.gauss(1e6, 1)
        values = [a, a + rng.gauss(0, 1), rng.gauss(0, 1e-3), 5.0, None, a * 2, float("nan") if i % 9 == 0 else rng.random()]
        rows.append(tuple(None if rng.random() < 0.1 and j != 3 else v for j, v in enumerate(values)))
    names = list("abcdefg")
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(3)
    got = {(r["column_a"], r["column_b"]): r["r"] for r in gram.wide_correlation(df, names).collect()}
    frame = pd.DataFrame(rows, columns=names, dtype="f8")
    assert len(got) == 49
    for (a, b), r in got.items():
        both = frame[[a, b]].dropna().to_numpy().T
        if a in "de" or b in "de":
            assert r is None
        else:
            assert r == pytest.approx(np.corrcoef(both[0], both[1])[0, 1], abs=1e-9)


def test_refreshed_features_equal_full_ones(spark):
    """After random corrections, removals and additions; few rows are read and computed again."""
    rng = random.Random(11)
    spec, reach = PanelSpec(entity="k", date="t"), 3
    old = {(k, t): rng.random() for k in range(30) for t in range(rng.randint(1, 80))}
    now, changed = dict(old), set()
    for k, t in rng.sample(sorted(old), 12):
        changed.add((k, t))
        if rng.random() < 0.5:
            now[k, t] = -1.0
        else:
            del now[k, t]
    for key in [(3, 500), (3, -5), (99, 1), (5, 10_000)]:
        now[key] = 7.0
        changed.add(key)

    def frame(rows):
        return spark.createDataFrame([(k, t, v) for (k, t), v in rows.items()], "k int, t int, v double").repartition(4)

    def build(df):
        w = Window.partitionBy("k").orderBy("t")
        return df.withColumns({"lag3": F.lag("v", 3).over(w), "mean": F.avg("v").over(w.rowsBetween(-3, 0))})

    keys = spark.createDataFrame(sorted(changed) + [(1, None), (77, 5)], "k int, t int")
    got = refreshed(build(frame(old)), frame(now), keys, build, reach, spec)
    want = build(frame(now))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    read = dirty_rows(frame(now), keys, reach, spec)
    assert read.count() <= len(changed) * (2 * reach + 1) and read.where("_dirty").count() <= len(changed) * (reach + 1)
