"""Alert suppression as a stream: the last sent time is durable state per entity."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panelcast.operators.suppression import INTERVAL_SECONDS
from panelcast.session import send_code

send_code(__name__)

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastSent(StatefulProcessor):
    """Emits the alerts of a batch that are due, oldest first."""

    def __init__(self, interval_seconds: int) -> None:
        self.interval = interval_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last_sent", "t bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else None
        for row in sorted(rows, key=lambda x: x["t"]):
            if last is None or row["t"] - last > self.interval:
                last = row["t"]
                yield Row(entity=key[0], t=last)
        if last is not None:
            self.last.update((last,))

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Choose the state store that this needs; for a session to call before it starts the stream."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def due_alerts(
    alerts: DataFrame, entity: str, ts: str, interval_seconds: int = INTERVAL_SECONDS
) -> DataFrame:
    """(entity, ts) of the alerts to send, from a stream of alerts in time order.

    A task holds the moments that one entity has in one micro-batch: bound those by the source's
    ``maxFilesPerTrigger``. The state is one number per entity."""
    slim = alerts.select(
        F.col(entity).alias("entity"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t")
    )
    out = T.StructType(
        [T.StructField("entity", alerts.schema[entity].dataType), T.StructField("t", T.LongType())]
    )
    sent = slim.groupBy("entity").transformWithState(
        statefulProcessor=LastSent(interval_seconds),
        outputStructType=out,
        outputMode="append",
        timeMode="None",
    )
    return sent.select(F.col("entity").alias(entity), F.timestamp_micros("t").alias(ts))


class SettledSent(StatefulProcessor):
    """Keeps an entity's moments until the watermark has passed them, then emits those that are due."""

    def __init__(self, interval_seconds: int) -> None:
        self.interval = interval_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last_sent", "t bigint")
        self.pending = handle.getMapState("pending", "t bigint", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            # A moment that comes again, from a repeated file or another alert, is there already.
            if not self.pending.containsKey((row["t"],)):
                self.pending.updateValue((row["t"],), (1,))
                self.handle.registerTimer(row["t"] // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        due = sorted(t for (t,) in self.pending.keys() if t // 1000 + 1 <= now)
        last = self.last.get()[0] if self.last.exists() else None
        for t in due:
            self.pending.removeKey((t,))
            if last is None or t - last > self.interval:
                last = t
                yield Row(entity=key[0], t=t)
        if due:
            self.last.update((last,))

    def close(self) -> None:
        pass


def settled_alerts(
    alerts: DataFrame, entity: str, ts: str, delay: str, interval_seconds: int = INTERVAL_SECONDS
) -> DataFrame:
    """(entity, ts) of the alerts to send, from a stream that may be out of order by up to ``delay`` and repeat itself.

    An alert is decided on when no earlier one can come any more, so the result is that of the batch operator. What is
    later than ``delay`` is dropped. The state of an entity is its moments within the delay and one number."""
    slim = alerts.select(F.col(entity).alias("entity"), F.col(ts).cast("timestamp").alias("at")).withWatermark("at", delay)
    slim = slim.select("entity", "at", F.unix_micros("at").alias("t"))
    out = T.StructType(
        [T.StructField("entity", alerts.schema[entity].dataType), T.StructField("t", T.LongType())]
    )
    sent = slim.groupBy("entity").transformWithState(
        statefulProcessor=SettledSent(interval_seconds), outputStructType=out, outputMode="append", timeMode="EventTime",
    )
    return sent.select(F.col("entity").alias(entity), F.timestamp_micros("t").alias(ts))


def tick_counts(sent: DataFrame, ts: str) -> DataFrame:
    """(tick, alert_count) of the notification of every hour, from the stream of a log that ``settled_alerts`` fills.

    The log grows in the order of time but for the rows of one batch, so a tick is complete as soon as a later batch
    begins; its count is then emitted, once."""
    hours = sent.withWatermark(ts, "0 seconds").groupBy(F.window(ts, "1 hour")).agg(F.count(F.lit(1)).alias("alert_count"))
    return hours.select(F.col("window.start").alias("tick"), "alert_count")
