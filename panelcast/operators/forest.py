"""Random forests for several targets at once, grown by Spark from binned rows.

Features are cut into bins once; a row is then one byte a feature. A pass sums, for each open node of each tree,
weights and targets by (feature, bin), and the split that explains most of all targets together is taken, so one
forest serves every horizon. Nodes of more than LOCAL_ROWS rows are split by such passes over all rows; what is below
them is grown whole by one task, which holds the rows of that node alone. The driver holds the trees, never rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.sqltext import number, quoted
from panelcast.operators.windows import filled_array
from panelcast.session import materialized, send_code

send_code(__name__)

BINS = 32
#: A node of at most so many rows is grown by one task.
LOCAL_ROWS = 100_000
#: Sums that a task holds at a time, in bytes.
SUMS_BYTES = 2**26


@dataclass(frozen=True)
class ForestSize:
    """``features`` is the number tried at a node, the root of all if None."""

    trees: int = 200
    depth: int = 15
    min_leaf: int = 2
    features: int | None = None
    seed: int = 42


# ---- binned rows


def cut_points(df: DataFrame, columns: list[str]) -> list[np.ndarray]:
    """At most BINS - 1 rising cut points a column: values up to the first are in bin 0, and so on."""
    shares = ", ".join(number((i + 1) / BINS) for i in range(BINS - 1))
    value = [f"coalesce(cast({quoted(c)} as double), 0.0D)" for c in columns]
    found = df.selectExpr(*[f"percentile_approx({x}, array({shares}), 10000) as c{i}" for i, x in enumerate(value)],
                          *[f"max({x}) as m{i}" for i, x in enumerate(value)]).first()
    # A cut at the greatest value would leave the last bin empty.
    return [np.array(sorted(x for x in set(found[f"c{i}"] or []) if x < found[f"m{i}"])) for i in range(len(columns))]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], axis=1).astype("u1")


def binned_rows(df: DataFrame, columns: list[str], targets: list[str], cuts: list[np.ndarray], key: list[str],
                first: str | None = None) -> DataFrame:
    """(hash, first, bins, y): a hash of the key, the number of the first forest that may learn from the row, a byte
    per feature and the targets. Nulls count as 0."""
    rows = df.select(F.xxhash64(*key).alias("hash"), (F.col(first) if first else F.lit(0)).cast("int").alias("first"),
                     filled_array(columns).alias("x"), filled_array(targets).alias("y"))

    def cut(frames):
        for frame in frames:
            if not len(frame):
                continue
            bins, y = binned(np.stack(frame["x"].to_list()), cuts), np.stack(frame["y"].to_list())
            yield pd.DataFrame({"hash": frame["hash"], "first": frame["first"], "bins": [r.tobytes() for r in bins],
                                "y": [r.tobytes() for r in y]})

    return rows.mapInPandas(cut, "hash long, first int, bins binary, y binary")


def unpacked(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    n = len(frame)
    return (np.frombuffer(b"".join(frame["bins"]), "u1").reshape(n, -1),
            np.frombuffer(b"".join(frame["y"]), "f8").reshape(n, -1))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits in which each bit of the input shows everywhere."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# How likely a row is drawn at most 0, 1, 2 ... times in a sample as large as the table.
_DRAWN = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])


def bag(hashes: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree's sample with replacement holds each row: by the row's hash, wherever the row is."""
    salt = np.uint64((tree * 0x9E3779B97F4A7C15 + seed) % 2**64)
    u = _mixed(_mixed(hashes.astype("i8").view("u8") ^ salt) + salt) / 2.0**64
    return np.searchsorted(_DRAWN, u, side="right").astype("u1")


# ---- trees

NODE = [("path", "<i8"), ("feature", "<i4"), ("bin", "<i4"), ("gain", "<f8"), ("n", "<f8")]


def node_type(targets: int) -> np.dtype:
    """A node: its path (the root is 1, the children of p are 2p and 2p + 1), its split (feature -1: none), what the
    split gained, the weight of its rows, their mean targets."""
    return np.dtype([*NODE, ("value", "<f8", (targets,))])


def tried(paths: np.ndarray, tree: int, features: int, size: ForestSize) -> np.ndarray:
    """The features tried at each node, without repeats, by a hash of seed, tree, node and feature."""
    wanted = size.features or max(1, math.isqrt(features))
    salt = _mixed(np.array([size.seed * 1_000_003 + tree], "u8"))
    dice = _mixed(_mixed(paths.astype("u8")[:, None] + salt) ^ np.arange(1, features + 1, dtype="u8")[None, :])
    return np.sort(np.argpartition(dice, wanted - 1, axis=1)[:, :wanted], axis=1)


def sums(bins, y, w, slot, chosen) -> np.ndarray:
    """Weights and weighted targets by (node, tried feature, bin); ``slot`` is each row's node in ``chosen``."""
    nodes, m = chosen.shape
    place = ((slot[:, None] * m + np.arange(m)) * BINS + np.take_along_axis(bins, chosen[slot], 1)).ravel()
    parts = [np.bincount(place, np.repeat(v, m), nodes * m * BINS) for v in (w, *(y * w[:, None]).T)]
    return np.stack(parts, -1).reshape(nodes, m, BINS, -1)


def best_splits(total: np.ndarray, min_leaf: int):
    """(tried feature, bin, gain, weight of the left side) of the best split of each node; gain 0 where there is none.
    A split sends bins up to ``bin`` to the left; it gains what it takes off the targets' squared deviations."""
    left = total.cumsum(2)
    whole = left[:, :, -1:, :]
    right = whole - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = ((left[..., 1:] ** 2).sum(-1) / left[..., 0] + (right[..., 1:] ** 2).sum(-1) / right[..., 0]
                - (whole[..., 1:] ** 2).sum(-1) / whole[..., 0])
    gain[(left[..., 0] < min_leaf) | (right[..., 0] < min_leaf) | ~np.isfinite(gain)] = 0
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(1)
    each = np.arange(len(gain))
    return at // BINS, at % BINS, flat[each, at], left[each, at // BINS, at % BINS, 0]


def grown(bins: np.ndarray, y: np.ndarray, w: np.ndarray, root: int, tree: int, size: ForestSize) -> np.ndarray:
    """The nodes below and with ``root``, from all of its rows, level by level."""
    w = w.astype("f8")
    step = max(1, SUMS_BYTES // (8 * BINS * (y.shape[1] + 1) * (size.features or max(1, math.isqrt(bins.shape[1])))))
    rows, paths, out = np.arange(len(w)), np.array([root]), []
    slot = np.zeros(len(w), "i8")
    while len(paths):
        n = np.bincount(slot, w[rows], len(paths))
        value = np.stack([np.bincount(slot, w[rows] * y[rows, k], len(paths)) for k in range(y.shape[1])], 1) / n[:, None]
        nodes = np.zeros(len(paths), node_type(y.shape[1]))
        nodes["path"], nodes["feature"], nodes["n"], nodes["value"] = paths, -1, n, value
        out.append(nodes)
        if int(paths[0]).bit_length() > size.depth:
            break
        spread = np.bincount(slot, w[rows] * (y[rows] ** 2).sum(1), len(paths)) - n * (value ** 2).sum(1)
        open_ = np.flatnonzero((n >= 2 * size.min_leaf) & (spread > 1e-12 * n))
        chosen = tried(paths, tree, bins.shape[1], size)
        order = np.argsort(slot, kind="stable")
        edges = np.searchsorted(slot[order], np.arange(len(paths) + 1))
        for at in range(0, len(open_), step):
            part = open_[at:at + step]
            own = np.concatenate([order[edges[p]:edges[p + 1]] for p in part])
            local = np.repeat(np.arange(len(part)), edges[part + 1] - edges[part])
            r = rows[own]
            # Sums of deviations from the node's mean keep their digits.
            total = sums(bins[r], y[r] - value[part][local], w[r], local, chosen[part])
            f, b, gain, _ = best_splits(total, size.min_leaf)
            split = gain > 1e-12 * n[part]
            nodes["feature"][part] = np.where(split, chosen[part, f], -1)
            nodes["bin"][part], nodes["gain"][part] = b, np.where(split, gain, 0)
        inner = nodes["feature"] >= 0
        keep = inner[slot]
        rows, slot = rows[keep], slot[keep]
        right = bins[rows, nodes["feature"][slot]] > nodes["bin"][slot]
        paths = np.stack([paths[inner] * 2, paths[inner] * 2 + 1], 1).ravel()
        slot = (inner.cumsum() - 1)[slot] * 2 + right
    return np.concatenate(out)


class Tree:
    """Nodes by path, for sending rows down."""

    def __init__(self, nodes: np.ndarray):
        order = np.argsort(nodes["path"])
        self.nodes = nodes[order]
        left = np.searchsorted(self.nodes["path"], self.nodes["path"] * 2)
        self.left = np.where(self.nodes["feature"] >= 0, left, np.arange(len(left)))

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The index of the node where each row ends."""
        at, each = np.zeros(len(bins), "i8"), np.arange(len(bins))
        feature, cut = self.nodes["feature"], self.nodes["bin"]
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                return at
            at = np.where(inner, self.left[at] + (bins[each, feature[at]] > cut[at]), at)


# ---- growing


def _wide_pass(rows: DataFrame, trees: dict[int, Tree], wanted: dict[int, np.ndarray], features: int, targets: int,
               size: ForestSize) -> list:
    """One pass over all rows for the nodes ``wanted`` of each tree: (tree, path, sums of the best split)."""
    m = size.features or max(1, math.isqrt(features))

    def summed(frames):
        total = {t: np.zeros((len(p), m, BINS, targets + 1)) for t, p in wanted.items()}
        chosen = {t: tried(p, t, features, size) for t, p in wanted.items()}
        for frame in frames:
            bins, y = unpacked(frame)
            hashes, first = frame["hash"].to_numpy("i8"), frame["first"].to_numpy()
            for t, paths in wanted.items():
                w = bag(hashes, t, size.seed) * (first <= t // size.trees)
                used = np.flatnonzero(w)
                at = trees[t].nodes["path"][trees[t].places(bins[used])]
                slot = np.searchsorted(paths, at).clip(0, len(paths) - 1)
                here = paths[slot] == at
                used, slot = used[here], slot[here]
                total[t] += sums(bins[used], y[used], w[used].astype("f8"), slot, chosen[t])
        for t, paths in wanted.items():
            yield pd.DataFrame({"tree": t, "path": paths, "sums": [x.tobytes() for x in total[t]]})

    def split(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, "f8") for b in frame["sums"]).reshape(1, m, BINS, targets + 1)
        tree, path = int(frame["tree"].iloc[0]), int(frame["path"].iloc[0])
        f, b, gain, left = best_splits(total, size.min_leaf)
        own = total[0, 0].sum(0)
        cut = total[0, f[0], : b[0] + 1].sum(0)
        return pd.DataFrame([(tree, path, int(tried(np.array([path]), tree, features, size)[0, f[0]]), int(b[0]),
                              float(gain[0]), own.tobytes(), cut.tobytes())],
                            columns=["tree", "path", "feature", "bin", "gain", "own", "cut"])

    parts = rows.mapInPandas(summed, "tree int, path long, sums binary")
    made = parts.groupBy("tree", "path").applyInPandas(
        split, "tree int, path long, feature int, bin int, gain double, own binary, cut binary")
    return made.collect()


def _split_wide(rows: DataFrame, total: int, forests: int, features: int, targets: int, size: ForestSize):
    """The upper parts of all trees and, of each, the paths below which one task is enough."""
    kind = node_type(targets)
    trees, open_ = {}, {}
    for t in range(size.trees * forests):
        root = np.zeros(1, kind)
        root["path"], root["feature"] = 1, -1
        trees[t], open_[t] = Tree(root), np.array([1] if total > LOCAL_ROWS else [], "i8")
    ends = {t: [1] if total <= LOCAL_ROWS else [] for t in trees}
    room = max(1, SUMS_BYTES // (8 * BINS * (targets + 1) * (size.features or max(1, math.isqrt(features)))))
    while any(len(p) for p in open_.values()):
        asked = [(t, p) for t, paths in open_.items() for p in paths.tolist()]
        open_ = {t: [] for t in trees}
        added = {t: [] for t in trees}
        for at in range(0, len(asked), room):
            part = {}
            for t, p in asked[at:at + room]:
                part.setdefault(t, []).append(p)
            wanted = {t: np.array(sorted(p), "i8") for t, p in part.items()}
            for r in _wide_pass(rows, {t: trees[t] for t in wanted}, wanted, features, targets, size):
                own, cut = np.frombuffer(r["own"]), np.frombuffer(r["cut"])
                node = trees[r["tree"]].nodes
                i = np.searchsorted(node["path"], r["path"])
                node["n"][i], node["value"][i] = own[0], own[1:] / max(own[0], 1)
                if r["gain"] <= 1e-12 * own[0] or int(r["path"]).bit_length() > size.depth:
                    continue
                added[r["tree"]].append((r, [(2 * r["path"], cut), (2 * r["path"] + 1, own - cut)]))
        for t, splits in added.items():
            node = trees[t].nodes.copy()
            fresh = []
            for r, sides in splits:
                i = np.searchsorted(node["path"], r["path"])
                node["feature"][i], node["bin"][i], node["gain"][i] = r["feature"], r["bin"], r["gain"]
                for path, side in sides:
                    leaf = np.zeros(1, kind)
                    leaf["path"], leaf["feature"], leaf["n"], leaf["value"] = path, -1, side[0], side[1:] / side[0]
                    fresh.append(leaf)
                    (open_[t] if side[0] > LOCAL_ROWS else ends[t]).append(path)
            if fresh:
                trees[t] = Tree(np.concatenate([node, *fresh]))
        open_ = {t: np.array(p, "i8") for t, p in open_.items()}
    return trees, ends


def grow_forests(rows: DataFrame, features: int, targets: int, size: ForestSize = ForestSize(), forests: int = 1) -> DataFrame:
    """(forest, tree, nodes) of ``forests`` forests that are grown together, from ``binned_rows`` written before. Forest
    f learns from the rows whose ``first`` is f or less, so that expanding windows need no pass of their own.

    ``nodes`` are arrays of ``node_type``, some of a tree's nodes in each row. Without rows there are no trees."""
    total = rows.count()
    if not total:
        return rows.sparkSession.createDataFrame([], "forest int, tree int, nodes binary")
    trees, ends = _split_wide(rows, total, forests, features, targets, size)
    upper = [(t // size.trees, t, trees[t].nodes[~np.isin(trees[t].nodes["path"], ends[t])].tobytes()) for t in trees]
    below = {t: np.array(sorted(p), "i8") for t, p in ends.items() if p}

    def dealt(frames):
        for frame in frames:
            bins, y = unpacked(frame)
            hashes, first = frame["hash"].to_numpy("i8"), frame["first"].to_numpy()
            for t, paths in below.items():
                w = bag(hashes, t, size.seed) * (first <= t // size.trees)
                used = np.flatnonzero(w)
                if not len(used):
                    continue
                at = trees[t].nodes["path"][trees[t].places(bins[used])]
                out = []
                for p in paths[np.isin(paths, at)]:
                    own = used[at == p]
                    out.append((t, int(p), bins[own].tobytes(), y[own].tobytes(), w[own].astype("u1").tobytes()))
                yield pd.DataFrame(out, columns=["tree", "path", "bins", "y", "w"])

    def finished(frame: pd.DataFrame) -> pd.DataFrame:
        w = np.frombuffer(b"".join(frame["w"]), "u1")
        bins = np.frombuffer(b"".join(frame["bins"]), "u1").reshape(len(w), features)
        y = np.frombuffer(b"".join(frame["y"]), "f8").reshape(len(w), targets)
        tree = int(frame["tree"].iloc[0])
        nodes = grown(bins, y, w, int(frame["path"].iloc[0]), tree, size)
        return pd.DataFrame([(tree // size.trees, tree, nodes.tobytes())], columns=["forest", "tree", "nodes"])

    parts = rows.mapInPandas(dealt, "tree int, path long, bins binary, y binary, w binary")
    parallel = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    made = parts.repartition(4 * parallel, "tree", "path").groupBy("tree", "path").applyInPandas(
        finished, "forest int, tree int, nodes binary")
    spark = rows.sparkSession
    return made.unionByName(spark.createDataFrame(upper, "forest int, tree int, nodes binary").where(F.length("nodes") > 0))


# ---- fitted forests


@dataclass
class Forest:
    """A fitted forest: names of its features, their cut points, its trees."""

    names: list[str]
    cuts: list[np.ndarray]
    trees: list[Tree] = field(repr=False)
    targets: int = 4

    def predicted(self, x: np.ndarray) -> np.ndarray:
        """The mean over the trees, one column a target."""
        bins = binned(x, self.cuts)
        out = np.zeros((len(x), self.targets))
        for tree in self.trees:
            out += tree.nodes["value"][tree.places(bins)]
        return out / max(1, len(self.trees))

    def importance(self) -> np.ndarray:
        """The share of each feature in what the splits of a tree gain, averaged over the trees that split."""
        total = np.zeros(len(self.names))
        for tree in self.trees:
            inner = tree.nodes[tree.nodes["feature"] >= 0]
            if len(inner):
                gain = np.bincount(inner["feature"], inner["gain"], len(self.names))
                total += gain / gain.sum()
        return total / total.sum() if total.sum() else total


def fit_forests(
    df: DataFrame, columns: list[str], targets: list[str], key: list[str], size: ForestSize = ForestSize(),
    first: str | None = None, forests: int = 1,
) -> tuple[list[np.ndarray], DataFrame]:
    """Cut points and the written trees of ``grow_forests`` over the rows of ``df``. ``key`` tells rows apart; a
    forest does not depend on how rows are dealt out, but for the last digits of sums."""
    cuts = cut_points(df, columns)
    rows = materialized(binned_rows(df, columns, targets, cuts, key, first), "binned")
    return cuts, materialized(grow_forests(rows, len(columns), len(targets), size, forests), "trees")


def read_forest(trees: DataFrame, names: list[str], cuts: list[np.ndarray], targets: int, forest: int = 0) -> Forest:
    """The trees of one forest, by number; at most 2 to the depth nodes for each reach the driver."""
    by = {}
    for r in trees.where(F.col("forest") == forest).select("tree", "nodes").collect():
        by.setdefault(r["tree"], []).append(np.frombuffer(r["nodes"], node_type(targets)))
    return Forest(names, cuts, [Tree(np.concatenate(by[t])) for t in sorted(by)], targets)


def cut_table(spark: SparkSession, names: list[str], cuts: list[np.ndarray]) -> DataFrame:
    return spark.createDataFrame([(i, n, [float(x) for x in c]) for i, (n, c) in enumerate(zip(names, cuts, strict=True))],
                                 "place int, name string, cuts array<double>")
