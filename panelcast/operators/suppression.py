"""Alert suppression in batch: an alert is sent only if the last *sent* one of
its entity is more than the interval old.

An alert more than the interval after the one before it is sent whatever was
sent before, so a series falls into sessions that know nothing of each other.
Sessions are found by windows over (entity, time chunk); one of up to
SESSION_ROWS moments is a short array that is folded in the JVM.

The rule is sequential, yet a longer session need not fit in one task. What a
time chunk inherits is one number, the last sent time before it, and only its
effect on the first interval of the chunk matters. Each (entity, chunk) is
reduced to that step function. Step functions compose: runs of FAN chunks become
one function, runs of those again, up to one per entity; then the inherited
numbers go down the same tree, and each chunk marks its own rows. No task holds
more than one chunk or FAN functions.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.session import materialized, send_code

send_code(__name__)

# Fixed value: six hours, in seconds; the comparison is strict.
INTERVAL_SECONDS = 21600
# A chunk spans this many intervals (28 of six hours are a week).
CHUNK_INTERVALS = 28
# Functions that one task composes.
FAN = 64
# Moments of a session that is folded as one array.
SESSION_ROWS = 256
NEVER = -(2**62)


def _successors(times: np.ndarray, interval: int) -> np.ndarray:
    """Index of the next alert sent after each alert, ``len(times)`` for none."""
    return np.searchsorted(times, times + interval, side="right")


def _last_sent(times: np.ndarray, interval: int) -> np.ndarray:
    """For each alert, were it sent: the last time sent up to the chunk's end.

    Pointer doubling: each round follows twice as many successors at once.
    """
    n = len(times)
    hop = np.append(_successors(times, interval), n)
    last = np.arange(n + 1)
    while True:
        ahead = hop[:n] < n
        if not ahead.any():
            return times[last[:n]]
        last[:n] = np.where(ahead, last[hop[:n]], last[:n])
        hop = hop[hop]


def _chunk_function(times: np.ndarray, start: int, interval: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps (bound, exit): the first bound above ``inherited + interval`` gives
    the last time sent in the chunk; no such bound means nothing is sent."""
    reach = min(int(np.searchsorted(times, start + interval, side="right")) + 1, len(times))
    exits = _last_sent(times, interval)[:reach]
    bounds = times[:reach]
    keep = np.append(exits[1:] != exits[:-1], True)
    return bounds[keep], exits[keep]


def _sent_times(times: np.ndarray, inherited: int, interval: int) -> np.ndarray:
    following = _successors(times, interval)
    at = int(np.searchsorted(times, inherited + interval, side="right"))
    sent = []
    while at < len(times):
        sent.append(times[at])
        at = int(following[at])
    return np.array(sent, dtype="int64")


def _apply(bounds: np.ndarray, exits: np.ndarray, inherited: int, interval: int) -> int:
    """The last sent time after a chunk that inherits one."""
    at = int(np.searchsorted(bounds, inherited + interval, side="right"))
    return int(exits[at]) if at < len(bounds) else inherited


def _composed(
    first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray], interval: int
) -> tuple[np.ndarray, np.ndarray]:
    """The step function of two chunks in a row."""
    bounds, exits = first
    through = np.array([_apply(*then, int(e), interval) for e in exits], dtype="int64")
    # What passes the first chunk untouched meets the second alone.
    rest = then[0] > (bounds[-1] if len(bounds) else NEVER)
    bounds, exits = np.concatenate([bounds, then[0][rest]]), np.concatenate([through, then[1][rest]])
    # What is inherited lies before the first moment, so one bound beyond an interval after it is enough.
    reach = int(np.searchsorted(bounds, bounds[0] + interval, side="right")) + 1
    bounds, exits = bounds[:reach], exits[:reach]
    keep = np.append(exits[1:] != exits[:-1], True)
    return bounds[keep], exits[keep]


def _sent_moments(times: DataFrame, interval: int, span: int) -> DataFrame:
    """(k, t) of the moments at which something is sent."""
    key_type = times.schema["k"].dataType
    field = lambda n, t=T.LongType(): T.StructField(n, t)
    chunked = times.withColumn("chunk", F.floor(F.col("t") / F.lit(span)).cast("long"))

    def reduce_chunk(key: Any, pdf: pd.DataFrame) -> pd.DataFrame:
        moments = np.sort(pdf["t"].to_numpy())
        bounds, exits = _chunk_function(moments, int(key[1]) * span, interval)
        return pd.DataFrame({"k": key[0], "node": key[1], "bound": bounds, "exit": exits})

    function = T.StructType([field("k", key_type), field("node"), field("bound"), field("exit")])
    chunks = materialized(chunked.groupBy("k", "chunk").applyInPandas(reduce_chunk, function), "alert-steps")
    low, high = chunks.agg(F.min("node"), F.max("node")).first()
    if low is None:
        return times
    levels, width = [chunks.withColumn("node", F.col("node") - low)], high - low

    def functions(pdf: pd.DataFrame):
        for node, part in pdf.sort_values(["node", "bound"]).groupby("node", sort=True):
            yield int(node), (part["bound"].to_numpy("int64"), part["exit"].to_numpy("int64"))

    def compose(key: Any, pdf: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for _, one in functions(pdf):
            whole = one if whole is None else _composed(whole, one, interval)
        return pd.DataFrame({"k": key[0], "node": key[1], "bound": whole[0], "exit": whole[1]})

    def hand_down(key: Any, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows, state = [], int(right["inherited"].iloc[0])
        for node, one in functions(left):
            rows.append((key[0], node, state))
            state = _apply(*one, state, interval)
        return pd.DataFrame(rows, columns=["k", "node", "inherited"])

    above = F.floor(F.col("node") / F.lit(FAN)).cast("long")
    while width > 0:
        made = levels[-1].groupBy("k", above.alias("above")).applyInPandas(compose, function)
        levels.append(materialized(made, "alert-steps"))
        width //= FAN
    entries = levels[-1].select("k", "node").distinct().withColumn("inherited", F.lit(NEVER))
    for steps in reversed(levels[:-1]):
        entries = (
            steps.groupBy("k", above.alias("above"))
            .cogroup(entries.groupBy("k", "node"))
            .applyInPandas(hand_down, T.StructType([field("k", key_type), field("node"), field("inherited")]))
        )
    entries = entries.select("k", (F.col("node") + low).alias("chunk"), "inherited")

    def mark_chunk(key: Any, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"k": [], "t": []})
        sent = _sent_times(np.sort(left["t"].to_numpy()), int(right["inherited"].iloc[0]), interval)
        return pd.DataFrame({"k": key[0], "t": sent})

    return (
        chunked.groupBy("k", "chunk")
        .cogroup(entries.groupBy("k", "chunk"))
        .applyInPandas(mark_chunk, T.StructType([field("k", key_type), field("t")]))
    )


def sessions(times: DataFrame, interval: int, span: int) -> DataFrame:
    """(k, t) with ``session``, the first moment of its session, and ``n``, the moments of that session.

    Rows of one (entity, chunk of time) are ordered together; what a chunk needs of those before it is their last
    moment and the last session begun there, one row a chunk."""
    key = ["k", "chunk"]
    chunked = times.withColumn("chunk", F.floor(F.col("t") / F.lit(span)).cast("long"))
    within = Window.partitionBy(*key).orderBy("t")
    earlier = Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    # Where a session begins inside of the chunk; its first moment depends on the chunk before.
    before = F.lag("t").over(within)
    rows = chunked.withColumns({"before": before}).withColumn(
        "own", F.max(F.when(F.col("t") > F.col("before") + interval, F.col("t"))).over(
            within.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy(*key).agg(F.min("t").alias("first"), F.max("t").alias("last"), F.max("own").alias("begun"))
    gap = F.col("first") > F.coalesce(F.max("last").over(earlier), F.lit(NEVER)) + interval
    ends = ends.withColumn("opens", F.when(gap, F.col("first")))
    inherited = F.last(F.coalesce("begun", "opens"), True).over(earlier)
    ends = ends.select(*key, F.coalesce("opens", inherited).alias("inherited"))
    placed = rows.join(ends, key).select("k", "t", F.coalesce("own", "inherited").alias("session"))
    return placed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k", "session")))


def _folded(short: DataFrame, interval: int) -> DataFrame:
    """(k, t) of the moments at which something is sent, of sessions that fit an array."""
    times = short.groupBy("k", "session").agg(F.array_sort(F.collect_list("t")).alias("times"))
    none = F.struct(F.lit(NEVER).cast("long").alias("last"), F.array().cast("array<bigint>").alias("sent"))

    def step(state, t):
        return F.when(t > state["last"] + interval, F.struct(
            t.alias("last"), F.array_append(state["sent"], t).alias("sent"))).otherwise(state)

    return times.select("k", F.explode(F.aggregate("times", none, step)["sent"]).alias("t"))


def mark_sent(
    alerts: DataFrame,
    entity: str,
    ts: str,
    interval_seconds: int = INTERVAL_SECONDS,
    chunk_intervals: int = CHUNK_INTERVALS,
) -> DataFrame:
    """``alerts`` with a boolean ``sent``; rows without an entity or a time are not sent."""
    interval = interval_seconds * 1_000_000
    stamped = alerts.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    # Copies of a moment collapse before the shuffle.
    times = stamped.select(F.col(entity).alias("k"), F.col("_t").alias("t")).dropna().distinct()
    span = interval * chunk_intervals
    # Written once: read by the search for long sessions and by both ways to mark.
    placed = materialized(sessions(times, interval, span), "alert-sessions")
    sent = _folded(placed.where(F.col("n") <= SESSION_ROWS), interval)
    long = placed.where(F.col("n") > SESSION_ROWS).select("k", "t")
    if not long.isEmpty():
        sent = sent.unionByName(_sent_moments(long, interval, span))
    flags = sent.select(F.col("k").alias(entity), F.col("t").alias("_t"), F.lit(True).alias("_sent"))
    return (
        stamped.join(flags, [entity, "_t"], "left")
        .withColumn("sent", F.coalesce("_sent", F.lit(False)))
        .select(*alerts.columns, "sent")
    )


def digest(sent: DataFrame, ts: str, risk: str, threshold: float, columns: list[str]) -> DataFrame:
    """Rows of the notification of each tick, with the count of that tick."""
    tick = F.date_trunc("hour", F.col(ts))
    rows = sent.withColumn("tick", tick)
    counts = rows.groupBy("tick").agg(F.count(F.lit(1)).alias("alert_count"))
    return rows.join(counts, "tick").select(
        "tick",
        "alert_count",
        F.lit(float(threshold)).alias("threshold"),
        F.extract(F.lit("YEAROFWEEK"), "tick").cast("int").alias("iso_year"),
        F.weekofyear("tick").alias("iso_week"),
        *columns,
        risk,
        F.when(F.col(risk) >= 80, F.lit("#6f0000")).otherwise(F.lit("#dc3545")).alias("color"),
    )
