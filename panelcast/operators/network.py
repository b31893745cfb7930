"""A dense network trained where the data is: weights go out to the tasks, what they learned comes back.

In a round every task walks the rows of its partition once, in small batches, from the weights it is given, and hands
back how far it moved, times its rows; the sums over all tasks, added by Spark in slices, make the next weights. Rows
held back by a hash tell when to stop. The driver holds weights only, the tasks one batch of rows besides.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.session import send_code

send_code(__name__)


@dataclass(frozen=True)
class NetworkSize:
    """``layers`` are the widths between input and output; of the rows one in ``held`` tells when to stop."""

    layers: tuple[int, ...] = (256, 128, 64)
    rounds: int = 24
    patience: int = 4
    batch: int = 64
    rate: float = 0.002
    fade: float = 0.93
    decay: float = 1e-4
    held: int = 10
    seed: int = 42


# Numbers of one slice of the weights in the exchange between tasks.
SLICE = 32_768
#: Rows a task holds at a time.
ROWS = 2_048


def shapes(inputs: int, outputs: int, size: NetworkSize) -> list[tuple[int, int]]:
    widths = [inputs, *size.layers, outputs]
    return list(zip(widths[:-1], widths[1:]))


def first_weights(inputs: int, outputs: int, size: NetworkSize) -> np.ndarray:
    """All weights and offsets in one row of numbers, layer after layer."""
    rng = np.random.default_rng(size.seed)
    parts = []
    for a, b in shapes(inputs, outputs, size):
        parts += [rng.normal(0, np.sqrt(2 / a), a * b), np.zeros(b)]
    return np.concatenate(parts)


def layers(flat: np.ndarray, dims: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in dims:
        out.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def forward(x: np.ndarray, net) -> list[np.ndarray]:
    """The input and what every layer gives: the positive part, but for the last."""
    out = [x]
    for i, (w, b) in enumerate(net):
        z = out[-1] @ w + b
        out.append(np.maximum(z, 0) if i + 1 < len(net) else z)
    return out


def gradient(flat: np.ndarray, dims, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """The sum over the rows of half the squared errors, and its slope in every weight."""
    net = layers(flat, dims)
    values = forward(x, net)
    error = values[-1] - y
    loss, parts = float((error ** 2).sum() / 2), []
    for i in range(len(net) - 1, -1, -1):
        parts[:0] = [(values[i].T @ error).ravel(), error.sum(0)]
        if i:
            error = (error @ net[i][0].T) * (values[i] > 0)
    return loss, np.concatenate(parts)


def walked(flat: np.ndarray, dims, batches, size: NetworkSize, rate: float) -> tuple[np.ndarray, int]:
    """The weights after steps over all ``batches`` (x, y), each scaled by running moments, and the rows seen."""
    at, first, second, step, rows = flat.copy(), np.zeros_like(flat), np.zeros_like(flat), 0, 0
    for x, y in batches:
        _, slope = gradient(at, dims, x, y)
        slope /= len(x)
        step, rows = step + 1, rows + len(x)
        first += 0.1 * (slope - first)
        second += 0.01 * (slope * slope - second)
        move = first / (1 - 0.9 ** step) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
        at -= rate * (move + size.decay * at)
    return at, rows


def _arrays(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.stack(frame["x"].to_list()).astype("f4"), np.stack(frame["y"].to_list()).astype("f4")


def _round(rows: DataFrame, flat: np.ndarray, dims, size: NetworkSize, rate: float) -> tuple[np.ndarray, float]:
    """The weights after a round, and the mean squared error of the rows held back under the weights before it."""
    sent = flat.astype("f4")

    def learned(frames):
        error = np.zeros(2)

        def batches():
            for frame in frames:
                for at in range(0, len(frame), ROWS):
                    part = frame.iloc[at:at + ROWS]
                    x, y = _arrays(part)
                    back = part["held"].to_numpy(bool)
                    if back.any():
                        gap = forward(x[back], layers(sent, dims))[-1] - y[back]
                        error[:] += (gap ** 2).sum(), gap.size
                    x, y = x[~back], y[~back]
                    order = np.random.default_rng(size.seed + len(x)).permutation(len(x))
                    for b in range(0, len(x), size.batch):
                        yield x[order[b:b + size.batch]], y[order[b:b + size.batch]]

        at, seen = walked(sent, dims, batches(), size, rate)
        moved = (at - sent).astype("f8") * seen
        places = range(0, len(moved), SLICE)
        yield pd.DataFrame({"slice": [*range(len(places)), -1], "n": seen,
                            "part": [*(moved[p:p + SLICE].tobytes() for p in places), error.tobytes()]})

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(p) for p in frame["part"])
        return pd.DataFrame({"slice": frame["slice"].iloc[:1], "n": [int(frame["n"].sum())], "part": [total.tobytes()]})

    schema = "slice int, n long, part binary"
    parts = {r["slice"]: r for r in rows.mapInPandas(learned, schema).groupBy("slice").applyInPandas(added, schema).collect()}
    error, count = np.frombuffer(parts[-1]["part"])
    if not parts[-1]["n"]:
        return flat, error / max(count, 1)
    moved = np.concatenate([np.frombuffer(parts[i]["part"]) for i in range(len(parts) - 1)])
    return flat + moved / parts[0]["n"], error / max(count, 1)


@dataclass
class Network:
    """Fitted weights; inputs and targets are brought to mean 0 and deviation 1 by the numbers kept here."""

    names: list[str]
    flat: np.ndarray = field(repr=False)
    size: NetworkSize
    mean: np.ndarray = field(repr=False)
    scale: np.ndarray = field(repr=False)
    y_mean: np.ndarray
    y_scale: np.ndarray
    losses: list[float] = field(default_factory=list)

    def predicted(self, x: np.ndarray) -> np.ndarray:
        dims = shapes(len(self.mean), len(self.y_mean), self.size)
        return forward((x - self.mean) / self.scale, layers(self.flat, dims))[-1] * self.y_scale + self.y_mean


def _moments(rows: DataFrame, column: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every place of an array column, from sums that the tasks hand over as one row each."""
    def summed(frames):
        n, one, two = 0, np.zeros(width), np.zeros(width)
        for frame in frames:
            x = np.stack(frame[column].to_list()).astype("f8") if len(frame) else np.zeros((0, width))
            n, one, two = n + len(x), one + x.sum(0), two + (x ** 2).sum(0)
        yield pd.DataFrame({"i": np.arange(width), "n": n, "one": one, "two": two})

    parts = rows.select(column).mapInPandas(summed, "i int, n long, one double, two double")
    got = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two")).orderBy("i").toPandas()
    n = got["n"].to_numpy("f8").clip(1)
    mean = got["one"].to_numpy() / n
    spread = np.sqrt(np.maximum(got["two"].to_numpy() / n - mean ** 2, 0))
    return mean, np.where(spread > 1e-9, spread, 1.0)


def fit_network(rows: DataFrame, names: list[str], size: NetworkSize = NetworkSize()) -> Network:
    """A network over ``rows`` (x array, y array, hash bigint), written before. Inputs are brought to one scale first.

    Ends after ``rounds``, or when the rows held back have not improved for ``patience`` rounds, with the best weights
    seen. Without rows, or all of them held back, it keeps the weights it begins with."""
    sizes = rows.agg(F.max(F.size("x")), F.max(F.size("y"))).first()
    if sizes[0] is None:
        inputs, outputs = len(names), 1
        return Network(names, first_weights(inputs, outputs, size), size, np.zeros(inputs), np.ones(inputs),
                       np.zeros(outputs), np.ones(outputs))
    inputs, outputs = sizes
    mean, scale = _moments(rows, "x", inputs)
    y_mean, y_scale = _moments(rows, "y", outputs)

    def scaled(frames):
        for frame in frames:
            for at in range(0, len(frame), ROWS):
                part = frame.iloc[at:at + ROWS]
                x = (np.stack(part["x"].to_list()).astype("f8") - mean) / scale
                y = (np.stack(part["y"].to_list()).astype("f8") - y_mean) / y_scale
                yield pd.DataFrame({"x": list(x.astype("f4")), "y": list(y.astype("f4")), "held": part["held"].to_numpy(bool)})

    held = F.pmod(F.xxhash64("hash", F.lit(size.seed)), F.lit(size.held)) == 0
    ready = rows.withColumn("held", held).select("x", "y", "held").mapInPandas(
        scaled, "x array<float>, y array<float>, held boolean")
    dims = shapes(inputs, outputs, size)
    flat = first_weights(inputs, outputs, size)
    best, losses, rate = (np.inf, flat), [], size.rate
    for turn in range(size.rounds + 1):
        after, error = _round(ready, flat, dims, size, rate)
        losses.append(float(error))
        if error < best[0]:
            best = error, flat
        if turn - int(np.argmin(losses)) >= size.patience or not np.isfinite(error):
            break
        flat, rate = after, rate * size.fade
    return Network(names, best[1], size, mean, scale, y_mean, y_scale, losses)
