"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network."""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import held_out, send_code, strings

#: Tokens share this many rows by hash; their vectors have so many numbers.
ROWS, WIDTH = 4096, 64
#: Non-zero entries of an index vector, and neighbours to each side that a context has.
ENTRIES, REACH = 4, 2
#: Numbers in a pooled vector.
POOLED = 3 * WIDTH + 3
#: At most so many labelled rows are learned from, chosen by a hash of their id.
MAX_EXAMPLES = 20_000
HIDDEN, EPOCHS, RATE = 24, 60, 0.01
#: Documents whose tokens are held at a time.
BATCH_TOKENS = 1_000_000
SEED = 20

_TOKEN = re.compile(r"\w+|[^\w\s]+")


def token_rows(text: str | None, known: dict[str, int]) -> np.ndarray:
    """Rows of the tokens of a text: words in lower case, words in capitals as they are, runs of other signs.

    ``known`` remembers rows of tokens and is emptied when it grows too large."""
    found = _TOKEN.findall(text or "")
    out = np.empty(len(found), "i4")
    for i, token in enumerate(found):
        row = known.get(token)
        if row is None:
            if len(known) > 500_000:
                known.clear()
            plain = token if len(token) > 1 and token.isupper() else token.lower()
            row = known[token] = crc32(plain.encode("utf-8", "replace")) % ROWS
        out[i] = row
    return out


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each row's index vector, by a fixed seed."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, WIDTH, (ROWS, ENTRIES)), rng.choice([-1.0, 1.0], (ROWS, ENTRIES))


def context_sums(rows: np.ndarray, documents: np.ndarray, places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Sum over all token occurrences of the index vectors of their neighbours in the same document."""
    sums = np.zeros(ROWS * WIDTH)
    for reach in range(1, REACH + 1):
        same = documents[reach:] == documents[:-reach]
        left, right = rows[:-reach][same].astype("i8"), rows[reach:][same].astype("i8")
        for one, other in ((left, right), (right, left)):
            for k in range(ENTRIES):
                sums += np.bincount(one * WIDTH + places[other, k], signs[other, k], ROWS * WIDTH)
    return sums.reshape(ROWS, WIDTH)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The context vectors of all rows over the whole of ``docs``, each at length 1 (unseen rows: zero).

    A task adds up its documents and hands over one vector per row it saw; Spark sums them, in whole numbers,
    so that order doesn't matter. What reaches the driver has a fixed size, ROWS x WIDTH."""
    send_code(__name__)

    def sums(frames):
        places, signs = index_vectors()
        known, total = {}, np.zeros((ROWS, WIDTH))
        seen = np.zeros(ROWS, bool)
        parts, held = [], 0

        def flush():
            if parts:
                rows = np.concatenate(parts)
                documents = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
                seen[rows] = True
                np.add(total, context_sums(rows, documents, places, signs), out=total)

        for frame in frames:
            for text in strings(frame["text"]):
                parts.append(token_rows(text, known))
                held += len(parts[-1])
                if held >= BATCH_TOKENS:
                    flush()
                    parts, held = [], 0
        flush()
        rows = np.flatnonzero(seen)
        yield pd.DataFrame({"row": rows, "vector": pd.Series(list(total[rows].astype("i8")), dtype=object)})

    parts = docs.select("text").mapInPandas(sums, "row int, vector array<bigint>")
    added = parts.groupBy("row").agg(*[F.sum(F.col("vector")[i]).alias(f"s{i}") for i in range(WIDTH)])
    out = np.zeros((ROWS, WIDTH))
    for r in added.collect():
        out[r[0]] = r[1:]
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size > 0, size, 1)


def pooled(text: str | None, vectors: np.ndarray, known: dict[str, int]) -> np.ndarray:
    """The word vectors of a text pooled: their mean, their mean square, the mean product of neighbours (which
    repetition raises), the shares of distinct tokens and of tokens equal to the one before, and the log length.
    Zeros for a text without tokens."""
    rows = token_rows(text, known)
    if not len(rows):
        return np.zeros(POOLED)
    counts = np.bincount(rows, minlength=ROWS)
    used = np.flatnonzero(counts)
    share, v = counts[used] / len(rows), vectors[used]
    beside = np.zeros(WIDTH)
    for at in range(0, len(rows) - 1, 20_000):
        part = vectors[rows[at:at + 20_001]]
        beside += np.einsum("ij,ij->j", part[:-1], part[1:])
    same = (rows[1:] == rows[:-1]).sum()
    rest = max(1, len(rows) - 1)
    return np.concatenate([share @ v, share @ (v * v), beside / rest,
                           [len(used) / len(rows), same / rest, np.log1p(len(rows)) / 10]])


class QualityModel:
    """Two dense layers over the pooled vectors; the probability is calibrated by a temperature."""

    def __init__(self, vectors: np.ndarray, x: np.ndarray, y: np.ndarray):
        self.vectors, self.temperature, self.net = vectors, 1.0, None
        self.base = (y.sum() + 0.5) / (len(y) + 1)
        if len(set(y.tolist())) < 2:
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        rng = np.random.default_rng(SEED)
        order = rng.permutation(len(y))
        check, learn = order[: len(y) // 5], order[len(y) // 5:]
        self._train((x[learn] - self.mean) / self.scale, y[learn], rng)
        z = self._logits((x[check] - self.mean) / self.scale)
        grid = np.exp(np.linspace(-1.5, 2.5, 81))
        loss = [np.logaddexp(0, -np.where(y[check] == 1, z, -z) / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def _train(self, x, y, rng) -> None:
        """Adam on the log loss, in batches, with weight decay."""
        net = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
               rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
        first, second, step = [np.zeros_like(w) for w in net], [np.zeros_like(w) for w in net], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for at in range(0, len(y), 128):
                xb, yb = x[order[at:at + 128]], y[order[at:at + 128]]
                hidden = np.maximum(xb @ net[0] + net[1], 0)
                error = (1 / (1 + np.exp(-np.clip(hidden @ net[2] + net[3], -30, 30))) - yb) / len(yb)
                back = np.outer(error, net[2]) * (hidden > 0)
                slopes = [xb.T @ back, back.sum(0), hidden.T @ error, np.array([error.sum()])]
                step += 1
                for i, slope in enumerate(slopes):
                    first[i] = 0.9 * first[i] + 0.1 * slope
                    second[i] = 0.999 * second[i] + 0.001 * slope * slope
                    move = first[i] / (1 - 0.9 ** step) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
                    net[i] = net[i] - RATE * (move + 0.01 * net[i])
        self.net = net

    def _logits(self, x) -> np.ndarray:
        return np.maximum(x @ self.net[0] + self.net[1], 0) @ self.net[2] + self.net[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.net is None:
            return np.full(len(x), self.base)
        z = self._logits((x - self.mean) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> QualityModel:
    """Word vectors from every document; the network from labelled rows that are not held out, at most
    ``max_examples`` (a documented bound), chosen by a hash of the id. Several labels of one id count as their
    largest, of several texts one is learned from; null labels and ids are left out. With labels of one kind only, every text gets their share."""
    send_code(__name__)
    vectors = word_vectors(docs)
    chosen = labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(
        F.max("quality").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    # max_examples rows of two numbers; of repeated ids one text, so that the examples are as many.
    examples = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.first("label").alias("label"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def pool(frames):
        known = {}
        for frame in frames:
            x = [pooled(t, vectors, known).astype("f4") for t in strings(frame["text"])]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "label": frame["label"], "x": x})

    rows = examples.mapInPandas(pool, "doc_id long, label int, x array<float>").toArrow().to_pandas()
    rows = rows.sort_values(["doc_id", "label"], kind="stable")
    x = np.stack(rows["x"].to_list()).astype("f8") if len(rows) else np.zeros((0, POOLED))
    return QualityModel(vectors, x, rows["label"].to_numpy("f8"))


def scored(docs: DataFrame, model: QualityModel, text: str = "text", into: str = "quality_score") -> DataFrame:
    """``docs`` with a column ``into`` from the whole text. Null and empty texts are scored as texts
    without tokens. Rows never meet one another, so repeated rows score alike."""
    send_code(__name__)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        known = {}
        if not len(texts):
            return pd.Series([], dtype="f8")
        return pd.Series(model.scores(np.stack([pooled(x, model.vectors, known) for x in strings(texts)])))

    return docs.withColumn(into, score(F.col(text)))
