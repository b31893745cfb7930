"""Near duplicates of vectors by an inverted multi-index: two codebooks over the halves form a grid of cells."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import materialized, send_code, small
from panelcast.llm.components import components

MIN_COSINE = 0.98
#: The codebooks are fitted on at most so many distinct vectors, chosen by a hash.
SAMPLE = 20_000
#: Wanted rows of a label in a cell, and the most centroids of a codebook.
CELL_ROWS, MOST_CENTROIDS = 24, 256
#: Vectors whose true partners, found against all rows, tell how many cells must be visited for the recall.
CALIBRATION, TARGET_RECALL = 1_000, 0.995
#: Cells visited where the calibration vectors have no partner to tell by.
FEWEST_CELLS = 8
#: Rows of one side that a task compares at a time; larger cells are cut into blocks of so many.
BLOCK = 1_500


def unit(vectors) -> np.ndarray:
    """Rows at length 1, in double precision; scaled by their largest entry first, so that nothing overflows."""
    x = np.stack(list(vectors)).astype("f8")
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class MultiIndex:
    """Codebooks of both halves of unit vectors. A cell is the pair of nearest centroids."""

    def __init__(self, sample: np.ndarray, centroids: int, seed: int = 7):
        self.half = sample.shape[1] // 2 if sample.size else 0
        rng = np.random.default_rng(seed)
        self.books = [self._fit(part, centroids, rng) for part in self._halves(sample)]
        self.cells = FEWEST_CELLS

    def _halves(self, x):
        return x[:, :self.half], x[:, self.half:]

    @staticmethod
    def _fit(x, k, rng):
        """Lloyd's algorithm from distinct rows; an empty centroid stays where it was."""
        first = np.unique(x, axis=0)
        centers = first[rng.choice(len(first), min(k, len(first)), replace=False)]
        for _ in range(10):
            near = MultiIndex._squares(x, centers).argmin(1)
            count = np.bincount(near, minlength=len(centers))
            sums = np.zeros_like(centers)
            np.add.at(sums, near, x)
            centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers)
        return centers

    @staticmethod
    def _squares(x, centers):
        d = (x * x).sum(1)[:, None] + (centers * centers).sum(1)[None, :] - 2 * x @ centers.T
        return np.maximum(d, 0)

    def squares(self, x) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of both halves of each row to the centroids of their codebook."""
        return tuple(self._squares(part, book) for part, book in zip(self._halves(x), self.books, strict=True))

    def cell(self, x) -> np.ndarray:
        one, two = self.squares(x)
        return one.argmin(1) * len(self.books[1]) + two.argmin(1)

    def rank(self, one: np.ndarray, two: np.ndarray, cell: int) -> int:
        """The place of a cell in the order in which the vector with these distances visits the cells."""
        reach = one[cell // len(two)] + two[cell % len(two)]
        return 1 + int((one[:, None] + two[None, :] < reach - 1e-12).sum())

    def visits(self, one: np.ndarray, two: np.ndarray) -> list[int]:
        """The cells nearest to a vector, by the multi-sequence algorithm: a heap over pairs of ranks in the two
        sorted lists of distances, until ``cells`` are visited. Cells that no partner of a vector can be in are left
        out: the centroid nearest to a partner is at most twice the partners' distance farther than one's own."""
        order = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
        a, b = one[order[0]], two[order[1]]
        farther = (np.sqrt(a) - math.sqrt(a[0])) ** 2, (np.sqrt(b) - math.sqrt(b[0])) ** 2
        reach = 4 * (2 - 2 * MIN_COSINE) + 1e-9
        heap, seen, out, popped = [(a[0] + b[0], 0, 0)], {(0, 0)}, [], 0
        while heap and popped < self.cells:
            _, i, j = heapq.heappop(heap)
            popped += 1
            if farther[0][i] + farther[1][j] <= reach:
                out.append(int(order[0][i]) * len(b) + int(order[1][j]))
            for u, v in ((i + 1, j), (i, j + 1)):
                if u < len(a) and v < len(b) and (u, v) not in seen:
                    seen.add((u, v))
                    heapq.heappush(heap, (a[u] + b[v], u, v))
        return out


def distinct_vectors(embeddings: DataFrame) -> DataFrame:
    """(label, vector, id, n): each different vector of a label with its least id and number of rows, of the rows
    that can link at all: id, label and vector not null, components finite and not null, not all zero. ``label``
    is text with the length of the vector, so that only vectors of one length are compared."""
    v = F.col("embedding").cast("array<double>")
    fine = F.coalesce(
        (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = embeddings.where(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.select(F.concat_ws("/", F.col("label").cast("string"), F.size("embedding").cast("string")).alias("label"),
                       F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    rows = rows.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), "vector")})
    return rows.groupBy("label", "h1", "h2").agg(
        F.min("id").alias("id"), F.count("*").alias("n"), F.min_by("vector", "id").alias("vector"))


def fit(vectors: DataFrame, exact: bool = False) -> dict[str, MultiIndex]:
    """One index for each length of vectors there is, fitted on a bounded sample of ``vectors``; the number of
    cells to visit comes from the partners that a bounded set of vectors has among all rows, compared in blocks.
    Of the partners only their ranks in the visiting order, counted in the tasks, reach the driver. If ``exact``,
    every cell that can hold a partner is visited."""
    send_code(__name__)
    sizes = vectors.groupBy(F.size("vector").alias("size")).agg(
        F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels")).collect()
    out = {}
    for size, n, labels in sorted(tuple(r) for r in sizes):
        own = vectors.where(F.size("vector") == size)
        sample = own.orderBy("h1", "id").limit(SAMPLE).select("vector").collect()
        k = min(MOST_CENTROIDS, max(2, round(math.sqrt(n / max(1, labels) / CELL_ROWS))))
        index = MultiIndex(unit([r[0] for r in sample]), k)
        out[size] = index
        if exact:
            index.cells = math.prod(map(len, index.books))
            continue
        asked = own.orderBy("h2", "id").limit(CALIBRATION).select("label", "id", "vector").collect()
        q, q_id = unit([r["vector"] for r in asked]), np.array([r["id"] for r in asked])
        q_label = np.array([r["label"] for r in asked], dtype=object)

        def ranks(frames, index=index, q=q, q_id=q_id, q_label=q_label):
            one, two = index.squares(q)
            for frame in frames:
                if not len(frame):
                    continue
                x = unit(frame["vector"])
                cells = index.cell(x)
                same = frame["label"].to_numpy(object)[:, None] == q_label[None, :]
                same &= frame["id"].to_numpy()[:, None] != q_id[None, :]
                found = [index.rank(one[j], two[j], cells[i]) for i, j in np.argwhere((x @ q.T >= MIN_COSINE) & same)]
                rank, count = np.unique(np.array(found, "i8"), return_counts=True)
                yield pd.DataFrame({"rank": rank, "n": count})

        found = own.select("label", "id", "vector").mapInPandas(ranks, "rank long, n long").groupBy("rank").agg(
            F.sum("n").alias("n")).orderBy("rank").collect()
        if found:
            share = np.cumsum([r["n"] for r in found]) / sum(r["n"] for r in found)
            index.cells = max(FEWEST_CELLS, found[int(np.searchsorted(share, TARGET_RECALL))]["rank"])
    return out


ROUTED = "label string, cell long, probe boolean, id long, n long, vector array<double>, home long, visits array<long>"


def _linked(base: pd.DataFrame, probe: pd.DataFrame):
    """Links between the rows of a cell and the vectors that visit it: (id, links, root) of every linked row.

    A visiting vector counts each partner; a row of the cell counts its visitor only where it does not visit the
    visitor's own cell, so that no pair is counted twice. Roots join what this block connects."""
    x, y = unit(probe["vector"]), unit(base["vector"])
    x_id, y_id = probe["id"].to_numpy("i8"), base["id"].to_numpy("i8")
    hit = (x @ y.T >= MIN_COSINE) & (x_id[:, None] != y_id[None, :])
    if not hit.any():
        return None
    unseen = np.zeros_like(hit)
    home = probe["home"].to_numpy("i8")
    for j, visited in enumerate(base["visits"]):
        rows = np.flatnonzero(hit[:, j])
        if len(rows):
            unseen[rows, j] = ~np.isin(home[rows], np.asarray(visited, "i8"))
    x_links = hit @ base["n"].to_numpy("i8")
    y_links = unseen.T @ probe["n"].to_numpy("i8")
    big = np.iinfo("i8").max
    x_root, y_root = x_id.copy(), y_id.copy()
    while True:
        new_y = np.minimum(y_root, np.where(hit, x_root[:, None], big).min(0))
        new_x = np.minimum(x_root, np.where(hit, new_y[None, :], big).min(1))
        if (new_x == x_root).all() and (new_y == y_root).all():
            break
        x_root, y_root = new_x, new_y
    rows = pd.DataFrame({"id": np.concatenate([x_id, y_id]), "links": np.concatenate([x_links, y_links]),
                         "root": np.concatenate([x_root, y_root])})
    return rows[(rows["links"] > 0) | (rows["id"] != rows["root"])]


def links(vectors: DataFrame, indexes: dict[int, MultiIndex]) -> DataFrame:
    """(id, links, root) rows: shares of the number of linked rows of each vector, and edges that connect what is
    linked. Every vector is indexed in its cell and visits its nearest cells; all visited are verified exactly.

    A cell with more rows than BLOCK, on either side, is cut into blocks by a hash, and each block of one side
    meets each of the other, so that no task holds a whole hot cell and no pair leaves the tasks."""
    send_code(__name__)

    def routed(frames):
        for frame in frames:
            for size, part in frame.groupby(frame["vector"].map(len)):
                index = indexes[size]
                x = unit(part["vector"])
                cells, (one, two) = index.cell(x), index.squares(x)
                visits = [index.visits(one[i], two[i]) for i in range(len(x))]
                rows = []
                for i, r in enumerate(part.itertuples()):
                    rows.append((r.label, int(cells[i]), False, r.id, r.n, r.vector, int(cells[i]), visits[i]))
                    rows += [(r.label, c, True, r.id, r.n, r.vector, int(cells[i]), None) for c in visits[i]]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in ROUTED.split(", ")], dtype=object)

    rows = materialized(vectors.select("label", "id", "n", "vector").mapInPandas(routed, ROUTED), "routed")
    sizes = rows.groupBy("label", "cell").agg(
        F.count_if("probe").alias("probes"), F.count_if(~F.col("probe")).alias("bases"))
    sizes = sizes.where("probes > 0 and bases > 0")
    large = materialized(sizes.where(F.greatest("probes", "bases") > BLOCK).select(
        "label", "cell", F.ceil(F.col("probes") / BLOCK).alias("pb"), F.ceil(F.col("bases") / BLOCK).alias("bb")), "large")
    rows = rows.join(small(large), ["label", "cell"], "left").fillna(1, ["pb", "bb"])
    mine = F.when(F.col("probe"), F.pmod(F.xxhash64("id"), "pb")).otherwise(F.pmod(F.xxhash64("id"), "bb"))
    other = F.sequence(F.lit(0).cast("long"), F.when(F.col("probe"), F.col("bb")).otherwise(F.col("pb")) - 1)
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(other))
    rows = rows.withColumns({"b": F.when(F.col("probe"), F.col("other")).otherwise(F.col("mine")),
                             "p": F.when(F.col("probe"), F.col("mine")).otherwise(F.col("other"))})
    key = ["label", "cell", "b", "p"]

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        probe = rows["probe"].to_numpy(bool)
        found = _linked(rows[~probe], rows[probe]) if probe.any() and not probe.all() else None
        return pd.DataFrame({"id": [], "links": [], "root": []}, dtype="i8") if found is None else found

    rows = rows.select(*key, "probe", "id", "n", "vector", "home", "visits")
    return rows.groupBy(*key).applyInPandas(compared, "id long, links long, root long")


def near_duplicates(embeddings: DataFrame, exact: bool = False) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``embeddings`` (vec_id, label, embedding; other columns
    are left out).

    Two rows link when their labels are equal and not null and their cosine, in double precision, is MIN_COSINE
    or more. Rows with a null id, label or vector, without components, with null or non-finite components, or all
    zero, link with nothing: no links, their own component, kept. Rows with one id count as one
    vector where they hold the same one, and share a component in any case; equal vectors of a label are
    collapsed first and counted, so their number never multiplies. No pair below MIN_COSINE is ever linked; of
    those above, the index finds TARGET_RECALL on the calibration vectors, and all of them if ``exact``.
    """
    vectors = materialized(distinct_vectors(embeddings), "vectors")
    found = materialized(links(vectors, fit(vectors, exact)), "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    groups = vectors.select("label", "h1", "h2", "id", "n").join(counts, "id", "left").join(roots, "id", "left").select(
        "label", "h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"))
    rows = embeddings.select(
        "vec_id", F.concat_ws("/", F.col("label").cast("string"), F.size("embedding").cast("string")).alias("label"),
        F.when(F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.xxhash64("embedding")).alias("h1"),
        F.xxhash64(F.lit(1), "embedding").alias("h2"))
    rows = rows.withColumn("label", F.when(F.col("h1").isNull(), F.col("vec_id").cast("string")).otherwise(F.col("label")))
    rows = rows.withColumn("h1", F.coalesce("h1", F.xxhash64("vec_id")))
    out = rows.join(groups, ["label", "h1", "h2"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                      F.coalesce("component_id", F.col("vec_id").cast("long")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
