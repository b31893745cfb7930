"""Centroid clustering in whole numbers, with lower bounds from Ptolemy's inequality over fixed pivot pairs.

For points q, o and pivots p, s: d(q,o) d(p,s) >= |d(q,p) d(o,s) - d(q,s) d(o,p)|. The distances d(q,p) of every vector
to the pivots are computed once and kept beside it; a round computes those of its centroids and measures exactly only
the centroids that no pair of pivots rules out.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import by_number, by_text, materialized, send_code

SIZE, SCALE = 64, 256
CENTROIDS, ROUNDS, SEED = 40, 5, 2
PIVOTS = 6
#: Larger components count as this: then no squared distance leaves 64 bits.
LARGEST = 2**27
#: Rows for which a task holds bounds at a time.
ROWS = 4096
#: Doubles err by less than this share in a bound; bounds are lowered by it.
SLACK = 1e-9


def whole_numbers(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows with SIZE components, none null or non-finite: floor(SCALE * x) of each, as int."""
    x = F.col("embedding").cast("array<double>")
    fine = (F.size(x) == SIZE) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform(x, lambda c: F.floor(F.greatest(
        F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), c * SCALE))).cast("int"))
    return embeddings.where(F.coalesce(fine, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int = SEED) -> np.ndarray:
    """The k vectors of the smallest hash of seed and id; equal hashes in order of their components."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.orderBy(F.sha2(text, 256), "v").limit(k).select("v").collect()
    return np.array([r[0] for r in rows], "i8").reshape(len(rows), SIZE)


def squares(v: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances, in 64 bits, of every row of ``v`` to every point."""
    return np.stack([((v - p) ** 2).sum(1) for p in points], axis=1)


def chosen_pivots(centroids: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """The first centroid and then always the one farthest from those chosen, as long as there are others."""
    at = [0]
    while len(at) < n:
        near = squares(centroids, centroids[at]).min(1)
        if near.max() == 0:
            break
        at.append(int(near.argmax()))
    return centroids[at]


class Round:
    """The centroids of one round with what bounds need: their distances to the pivots, and the pairs of pivots."""

    def __init__(self, centroids: np.ndarray, pivots: np.ndarray):
        self.centroids, self.reach = centroids, np.sqrt(squares(centroids, pivots).astype("f8"))
        between = np.sqrt(squares(pivots, pivots).astype("f8"))
        self.pairs = [(a, b, between[a, b]) for a, b in itertools.combinations(range(len(pivots)), 2) if between[a, b]]
        self.measured = 0

    def bounds(self, cached: np.ndarray) -> np.ndarray:
        """A number not above the squared distance of every row to every centroid."""
        best = np.zeros((len(cached), len(self.centroids)))
        for a, b, apart in self.pairs:
            one = cached[:, a, None] * self.reach[None, :, b]
            two = cached[:, b, None] * self.reach[None, :, a]
            low = (np.abs(one - two) - SLACK * (one + two)) / apart
            np.maximum(best, low, out=best)
        return np.floor(best * best * (1 - SLACK))

    def nearest(self, v: np.ndarray, cached: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row, the smaller number where two are.

        The centroid of the least bound is measured first; then those whose bound does not exceed what was found."""
        low = self.bounds(cached)
        number = low.argmin(1)
        found = ((v - self.centroids[number]) ** 2).sum(1)
        first = number.copy()
        self.measured += len(v)
        for c, centroid in enumerate(self.centroids):
            left = np.flatnonzero((low[:, c] <= found) & (first != c))
            exact = ((v[left] - centroid) ** 2).sum(1)
            self.measured += len(left)
            better = (exact < found[left]) | ((exact == found[left]) & (c < number[left]))
            number[left[better]], found[left[better]] = c, exact[better]
        return number, found


def _batches(frames):
    """vec_id, components and cached distances of at most ROWS rows at a time."""
    for frame in frames:
        for at in range(0, len(frame), ROWS):
            part = frame.iloc[at:at + ROWS]
            yield part["vec_id"], np.stack(part["v"].to_list()).astype("i8"), np.stack(part["d"].to_list())


def with_distances(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``vectors`` with the column d, their distances to the pivots."""
    send_code(__name__)

    def measured(frames):
        for frame in frames:
            for at in range(0, len(frame), ROWS):
                part = frame.iloc[at:at + ROWS].copy()
                part["d"] = list(np.sqrt(squares(np.stack(part["v"].to_list()).astype("i8"), pivots).astype("f8")))
                yield part

    return by_number(by_text(vectors, "vec_id").mapInPandas(measured, "vec_id string, v array<int>, d array<double>"), "vec_id")


def moved(stored: DataFrame, now: Round) -> np.ndarray:
    """The centroids after a round: each becomes the floor of its vectors' mean, exactly, and stays if it has none.

    A task adds up its vectors; sums of one row per centroid and task are added by Spark, and one row per centroid
    reaches the driver."""
    def added(frames):
        total, n = np.zeros(now.centroids.shape, "i8"), np.zeros(len(now.centroids), "i8")
        for _, v, cached in _batches(frames):
            number, _ = now.nearest(v, cached)
            np.add.at(total, number, v)
            n += np.bincount(number, minlength=len(n))
        used = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": used, "n": n[used], "total": list(total[used])})

    parts = stored.mapInPandas(added, "cluster int, n long, total array<long>")
    sums = parts.groupBy("cluster").agg(F.sum("n"), *[F.sum(F.col("total")[i]) for i in range(SIZE)]).collect()
    out = now.centroids.copy()
    for cluster, n, *total in sums:
        out[cluster] = [x // n for x in total]
    return out


def clustered(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid of every vector of
    ``embeddings`` (vec_id, embedding) with SIZE finite components; other rows and columns are left out.

    Components become floor(SCALE * x), beyond LARGEST that number. Rows with a null id count as having an empty
    one; rows of one id are vectors of their own. With fewer vectors than ``k``, each begins a cluster; an empty table
    gives no rows. Sums of distances beyond 64 bits are given as the largest long."""
    spark = embeddings.sparkSession
    send_code(__name__)
    vectors = whole_numbers(embeddings)
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
                                         "centroid_sha256 string, centroid array<long>")
    pivots = chosen_pivots(centroids)
    stored = materialized(with_distances(vectors, pivots), "vectors")
    for _ in range(rounds):
        centroids = moved(stored, Round(centroids, pivots))
    last = Round(centroids, pivots)

    def assigned(frames):
        for ids, v, cached in _batches(frames):
            number, found = last.nearest(v, cached)
            yield pd.DataFrame({"vec_id": ids.to_numpy(object), "cluster": number, "distance": found})

    rows = by_text(stored, "vec_id").mapInPandas(assigned, "vec_id string, cluster int, distance long")
    rows = materialized(by_number(rows, "vec_id"), "assigned")
    sums = {r[0]: int(r[1]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)"))).collect()}
    most = 2**63 - 1
    table = [(c, min(most, s), min(most, sum(sums.values())), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest(), row)
             for c, s in sums.items() for row in [[int(x) for x in centroids[c]]]]
    # One row per centroid.
    about = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, "
                                         "centroid array<long>")
    return rows.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
