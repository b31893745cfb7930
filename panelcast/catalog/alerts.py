"""Alert suppression in batch and as a stream, and the notification digest."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.catalog import bindings as B
from panelcast.catalog.registry import query
from panelcast.operators.suppression import digest, mark_sent
from panelcast.session import materialized, scratch_path
from panelcast.streaming.alerts import due_alerts, settled_alerts, tick_counts, use_state_store

ALERT = "event_type = 'error' and value >= 65"

_CHAIN = f"""with recursive a as (select event_id, user_id, ts, value from events where {ALERT}),
  chain(user_id, ts) as (select user_id, min(ts) from a group by 1
    union all select c.user_id, min(a.ts) from chain c join a on a.user_id = c.user_id
      and a.ts > c.ts + interval 21600 second group by c.user_id, c.ts)"""


def alerts(spark, sf):
    return B.table(spark, sf, "events").where(ALERT).select("event_id", "user_id", "ts", "value")


@query(
    "alert_suppression",
    f"""{_CHAIN} select event_id, a.user_id, value, c.ts is not null as sent
    from a left join chain c on c.user_id = a.user_id and c.ts = a.ts""",
)
def alert_suppression(spark, sf):
    return mark_sent(alerts(spark, sf), "user_id", "ts").select("event_id", "user_id", "value", "sent")


_DENSE = _CHAIN.replace(f"where {ALERT}", "").replace("user_id", "event_type")


@query(
    "event_suppression",
    f"""{_DENSE} select event_id, a.event_type, c.ts is not null as sent
    from a left join chain c on c.event_type = a.event_type and c.ts = a.ts""",
)
def event_suppression(spark, sf):
    """All events, entity = event type: few entities with dense alerts."""
    rows = B.table(spark, sf, "events").select("event_id", "event_type", "ts")
    return mark_sent(rows, "event_type", "ts").select("event_id", "event_type", "sent")


@query(
    "alert_digest",
    f"""{_CHAIN} select cast(date_trunc('hour', a.ts) as varchar) as tick, cast(extract(isoyear from a.ts) as int) as iso_year,
    cast(extract(week from a.ts) as int) as iso_week, count(*) over (partition by date_trunc('hour', a.ts)) as alert_count,
    65.0::double as threshold, event_id, a.user_id, value, case when value >= 80 then '#6f0000' else '#dc3545' end as color
    from a join chain c on c.user_id = a.user_id and c.ts = a.ts""",
)
def alert_digest(spark, sf):
    # Marked once; the digest reads it for the counts and for the rows.
    sent = materialized(mark_sent(alerts(spark, sf), "user_id", "ts").where("sent"), "sent")
    made = digest(sent, "ts", "value", 65.0, ["event_id", "user_id"])
    return made.withColumn("tick", F.date_format("tick", "yyyy-MM-dd HH:mm:ss")).orderBy(
        "tick", F.desc("value"), "event_id"
    )


@query(
    "alert_stream",
    f"{_CHAIN} select user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as sent_at from chain where ts is not null",
)
def alert_stream(spark, sf):
    """Sent alerts from a stream over the landed files."""
    use_state_store(spark)
    landed = B.stream(spark, sf, "events")
    target = scratch_path(spark, "alerts")
    run = (
        due_alerts(landed.where(ALERT), "user_id", "ts")
        .writeStream.format("parquet")
        .option("path", f"{target}/sent")
        .option("checkpointLocation", f"{target}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    made = spark.read.parquet(f"{target}/sent")
    return made.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("sent_at"))


def _landed(spark, sf) -> str:
    """The alerts in five files of six days; every seventh comes one file later, one file comes twice, and a last one
    holds two moments far ahead: they tell that nothing earlier will follow, in the alerts and in the log of those sent."""
    folder = scratch_path(spark, "landed")
    rows = materialized(alerts(spark, sf).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")), "alerts")
    day = F.datediff(F.col("ts"), F.lit("2024-01-01"))
    place = F.least(F.floor(day / 6), F.lit(4)) + (F.col("event_id") % 7 == 0).cast("int")
    far = rows.limit(1).select(F.lit(-1).cast(rows.schema["user_id"].dataType).alias("user_id"),
                               F.explode(F.array(*[F.lit(d).cast("timestamp") for d in ("2024-03-01", "2024-06-01")])).alias("ts"))
    for part in (0, 1, 1, 2, 3, 4, 5):
        rows.where(place == part).select("user_id", "ts").coalesce(1).write.mode("append").parquet(folder)
    far.coalesce(1).write.mode("append").parquet(folder)
    return folder


def _run(made, target, **options):
    """A stream written as files until all that has landed is worked off."""
    made.writeStream.format("parquet").option("path", f"{target}/out").option(
        "checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return f"{target}/out"


@query(
    "digest_stream",
    f"""{_CHAIN} select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as tick, count(*) as alert_count
    from chain where ts is not null group by date_trunc('hour', ts)""",
)
def digest_stream(spark, sf):
    """The notification's counts as a stream over late and repeated files: suppression into a log, ticks from it."""
    use_state_store(spark)
    landed = spark.readStream.schema(spark.read.parquet(folder := _landed(spark, sf)).schema).option(
        "maxFilesPerTrigger", 1).parquet(folder)
    sent = _run(settled_alerts(landed, "user_id", "ts", "7 days"), scratch_path(spark, "settled"))
    log = spark.readStream.schema(spark.read.parquet(sent).schema).parquet(sent)
    ticks = spark.read.parquet(_run(tick_counts(log, "ts"), scratch_path(spark, "ticks")))
    return ticks.select(F.date_format("tick", "yyyy-MM-dd HH:mm:ss").alias("tick"), "alert_count")
