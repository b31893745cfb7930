import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.catalog import bindings as B
from panelcast.operators import forest as F_
from panelcast.operators import network as N_
from panelcast.operators.forest import ForestSize
from panelcast.operators.network import NetworkSize
from panelcast.plans import prediction as P
from panelcast.plans import training as T
from panelcast.plans.store import Store
from panelcast.session import materialized
from panelcast.sources.writers import EXPORTS

FOREST, NETWORK = ForestSize(trees=4, depth=4), NetworkSize(layers=(8, 4), rounds=2)


@pytest.fixture(scope="module")
def data(spark, sf):
    small = B.panel(spark, sf).where("province in ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4')")
    return T.prepare(materialized(small, "panel"))


@pytest.fixture(scope="module")
def members(data):
    return {"rf": T.train_forest(data, size=FOREST), "mlp": T.train_network(data, size=NETWORK)}


def test_parts_do_not_overlap_in_time(data):
    last = data.train.agg({"target_date": "max"}).first()[0]
    assert last < data.val_start <= data.val.agg({"date": "min"}).first()[0]
    assert data.val.agg({"target_date": "max"}).first()[0] < data.test_start


def test_feature_counts(data):
    assert len(data.tabular_names) == len(data.sequence_names) + 3
    assert "outbreak_risk_index" not in data.tabular_names


def test_held_out_metrics(data, members):
    rows = T.evaluate_members(data, members).collect()
    assert {(r["member"], r["horizon"]) for r in rows} == {
        (m, h) for m in ("rf", "mlp", "ensemble", "persistence") for h in range(1, 5)
    }
    assert all(0 <= r["mae"] <= r["rmse"] <= 100 for r in rows)
    report = T.training_report(data, T.evaluate_members(data, members)).first()
    assert 0 <= report["ensemble_accuracy_pct"] <= 100 and len(report["members"]) == 4


def test_scoring_and_exports(spark, sf, data, members):
    forecast = P.score(data, members)
    assert forecast.count() == 4
    assert forecast.where("risk_index < 0 or risk_index > 100 or peak_week not between 1 and 4").count() == 0
    panel = B.panel(spark, sf)
    as_of = panel.selectExpr("cast(max(date) as string)").scalar()
    tables = P.export_tables(panel, forecast, B.entity_dim(spark, sf), as_of)
    assert set(tables) == set(EXPORTS)
    assert len(tables["predictions_summary"].columns) == 19
    assert len(tables["predictions_forecast_weekly"].columns) == 8
    assert len(tables["predictions_alerts"].columns) == 12
    assert tables["predictions_forecast_weekly"].count() == 16


def test_importance(spark, members):
    rows = members["rf"].importance(spark, 10).collect()
    assert len(rows) == 10
    assert [r["importance"] for r in rows] == sorted((r["importance"] for r in rows), reverse=True)


def test_models_round_trip(spark, data, members, tmp_path):
    for name, member in members.items():
        member.save(spark, str(tmp_path / name))
        loaded = T.Member.load(spark, str(tmp_path / name), data.pipeline.inverse_target)
        a = P.member_forecasts(data, {name: member})[name]
        b = P.member_forecasts(data, {name: loaded})[name]
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_cross_validation(data):
    """The forests of all folds, grown together, are those that each fold's own rows give."""
    rows = T.cross_validate(data, folds=2, size=FOREST).collect()
    assert {(r["fold"], r["horizon"]) for r in rows} == {(f, h) for f in (1, 2) for h in range(1, 5)}
    assert all(0 <= r["mae"] <= r["rmse"] <= 100 for r in rows)


def test_store_fits_once_and_anew(spark, sf, tmp_path, monkeypatch):
    panel = materialized(B.panel(spark, sf).where("province in ('NATION_1', 'NATION_2')"), "panel")
    store = Store(spark, str(tmp_path / "store"))
    one = T.Learned(panel, store=store)
    first = sorted(map(tuple, P.member_forecasts(one.data, {"rf": one.forest(FOREST)})["rf"].collect()))
    seen = one.folds(2, FOREST).count()

    def never(*args, **kw):
        raise AssertionError("fitted again")

    for name in ("prepare", "train_forest", "cross_validate"):
        monkeypatch.setattr(T, name, never)
    # The same rows in another order and other files; nothing is fitted, and only what is asked is read.
    two = T.Learned(panel.orderBy("cases").repartition(3), store=store)
    table = P.scoring_table(two.panel, two.pipeline)
    assert sorted(map(tuple, P.member_forecasts(table, {"rf": two.forest(FOREST)})["rf"].collect())) == first
    assert two.folds(2, FOREST).count() == seen == 8
    with pytest.raises(AssertionError):
        two.forest(ForestSize(trees=5, depth=4))
    with pytest.raises(AssertionError):
        T.Learned(panel.where("cases <> 0 or week > 1").withColumn("cases", F.col("cases") + 1), store=store).data


def test_store_survives_lost_pointers_and_folders(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    key = store.key("x", "content", a=1)
    assert store.find(key) is None and key != store.key("x", "content", a=2) != store.key("y", "content", a=2)
    made = store.get(key, lambda path: spark.range(3).write.parquet(path))
    assert store.get(key, None) == made and spark.read.parquet(made).count() == 3
    again = store.put(key, lambda path: spark.range(4).write.parquet(path))
    assert again != made and store.find(key) == again and spark.read.parquet(made).count() == 3
    shutil.rmtree(again)
    assert store.find(key) is None


def plain_tree(rows, paths, tree, size, features, at=1):
    """A tree grown by trying each split of each tried feature: {path: (feature, bin, n, mean)}."""
    w = sum(r[2] for r in rows)
    mean = [sum(r[2] * r[1][k] for r in rows) / w for k in range(2)]
    paths[at] = (-1, 0, w, mean)

    def cost(part):
        n = sum(r[2] for r in part)
        return sum(r[2] * (r[1][k] - sum(q[2] * q[1][k] for q in part) / n) ** 2 for r in part for k in range(2))

    whole, best = cost(rows), None
    if at.bit_length() <= size.depth and w >= 2 * size.min_leaf:
        for f in F_.tried(np.array([at]), tree, features, size)[0]:
            for b in range(F_.BINS):
                left, right = [r for r in rows if r[0][f] <= b], [r for r in rows if r[0][f] > b]
                if min(sum(r[2] for r in left), sum(r[2] for r in right)) >= size.min_leaf:
                    gain = whole - cost(left) - cost(right)
                    if gain > 1e-9 * w and (best is None or gain > best[0] + 1e-9):
                        best = gain, int(f), b, left, right
    if best:
        paths[at] = (best[1], best[2], w, mean)
        plain_tree(best[3], paths, tree, size, features, 2 * at)
        plain_tree(best[4], paths, tree, size, features, 2 * at + 1)
    return paths


@pytest.mark.parametrize("local", [100_000, 60, 7])
def test_forest_equals_brute_force(spark, monkeypatch, local):
    """Grown in one task, and with passes over all rows for the upper nodes."""
    monkeypatch.setattr(F_, "LOCAL_ROWS", local)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (150, 5)).astype("f8")
    y = np.stack([x[:, 0] * 2 + x[:, 3] + rng.normal(0, 1, 150), x[:, 1] - x[:, 0] + rng.normal(0, 1, 150)], 1)
    rows = [(i, *map(float, x[i]), *map(float, y[i]), int(i % 3 == 0)) for i in range(150)]
    df = spark.createDataFrame(rows, "i long, a double, b double, c double, d double, e double, y double, z double, f int")
    size = ForestSize(trees=3, depth=4, features=2)
    cuts, trees = F_.fit_forests(df.repartition(3), list("abcde"), ["y", "z"], ["i"], size, "f", 2)
    hashes = np.array([r[0] for r in df.select(F.xxhash64("i")).collect()])
    bins = F_.binned(x, cuts)
    for forest in (0, 1):
        made = F_.read_forest(trees, list("abcde"), cuts, 2, forest)
        assert len(made.trees) == 3
        for t, tree in enumerate(made.trees):
            number = forest * 3 + t
            w = F_.bag(hashes, number, size.seed)
            own = [(bins[i], y[i], int(w[i])) for i in range(150) if w[i] and rows[i][-1] <= forest]
            want = plain_tree(own, {}, number, size, 5)
            assert tree.nodes["path"].tolist() == sorted(want)
            for n in tree.nodes:
                f, b, weight, mean = want[int(n["path"])]
                assert (n["feature"], n["n"]) == (f, weight) and n["value"] == pytest.approx(mean)
                assert f < 0 or (bins[:, f] <= n["bin"]).tolist() == (bins[:, f] <= b).tolist() or n["gain"] > 0
    assert sum(made.importance()) == pytest.approx(1)


def test_forest_learns_and_bags_alike(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 1, (2000, 6))
    y = np.sin(5 * x[:, 0]) + x[:, 2]
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(2000)],
                               "i long, a double, b double, c double, d double, e double, f double, y double")
    cuts, trees = F_.fit_forests(df.where("i < 1500"), list("abcdef"), ["y"], ["i"], ForestSize(trees=30, depth=10))
    forest = F_.read_forest(trees, list("abcdef"), cuts, 1)
    error = np.abs(forest.predicted(x[1500:])[:, 0] - y[1500:]).mean()
    assert error < 0.25 * np.abs(y[1500:] - y[:1500].mean()).mean()
    assert set(np.argsort(forest.importance())[-2:]) == {0, 2}
    counts = F_.bag(np.arange(100_000), 5, 42)
    assert counts.mean() == pytest.approx(1, abs=0.02) and (counts == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)


def test_gradients_equal_differences():
    rng = np.random.default_rng(5)
    size = NetworkSize(layers=(5, 4))
    dims = N_.shapes(3, 2, size)
    flat = N_.first_weights(3, 2, size) + rng.normal(0, 0.1, sum(a * b + b for a, b in dims))
    x, y = rng.normal(0, 1, (7, 3)), rng.normal(0, 1, (7, 2))
    loss, slope = N_.gradient(flat, dims, x, y)
    for i in range(len(flat)):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        near = (N_.gradient(flat + step, dims, x, y)[0] - N_.gradient(flat - step, dims, x, y)[0]) / 2e-6
        assert slope[i] == pytest.approx(near, rel=1e-4, abs=1e-6)


def test_network_learns_over_partitions(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (3000, 8))
    y = np.stack([x[:, 0] * x[:, 1], x[:, 2] + 3], 1)
    df = spark.createDataFrame([(list(map(float, a)), list(map(float, b)), i) for i, (a, b) in enumerate(zip(x, y))],
                               "x array<float>, y array<float>, hash long").repartition(4)
    made = N_.fit_network(materialized(df.where("hash < 2500"), "x"), list("abcdefgh"), NetworkSize(layers=(32, 16), rate=0.01))
    error = np.abs(made.predicted(x[2500:]) - y[2500:]).mean(0)
    assert error[0] < 0.5 * np.abs(y[2500:, 0]).mean() and error[1] < 0.2
    assert min(made.losses) < 0.3 * made.losses[0]
    none = N_.fit_network(df.limit(0), ["a"], NetworkSize(layers=(2,)))
    assert none.predicted(np.zeros((1, 1))).shape == (1, 1)


def test_network_beats_the_last_value(data):
    """On held-out weeks of the panel, of one province each."""
    metrics = {r["member"]: r["mae"] for r in T.E.horizon_mean(
        T.evaluate_members(data, {"mlp": T.train_network(data)}), ["member"]).collect()}
    assert metrics["mlp"] < metrics["persistence"]
