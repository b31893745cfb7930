"""Upload validation and upsert, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.catalog import bindings as B
from panelcast.catalog.cleaning import UPLOADS_SQL, uploads
from panelcast.catalog.registry import query
from panelcast.operators import validate as V
from panelcast.session import scratch_path
from panelcast.sources.readers import parse_json
from panelcast.streaming import uploads as S

_RULES = [
    ("year_range", "year between 2000 and 2100"),
    ("week_range", "week between 1 and 53"),
    ("cases_nonnegative", "cases >= 0"),
]


@query(
    "json_ingest",
    """select event_id, cast(regexp_extract(props, '[0-9]+') as int) as week, 'NATION_' || (user_id % 30) as province
    from events""",
)
def json_ingest(spark, sf):
    """Records that arrive as JSON text; the text is put together from the event."""
    province = F.concat(F.lit("NATION_"), (F.col("user_id") % 30).cast("string"))
    week = F.from_json("props", "k int")["k"]
    text = F.to_json(F.struct(province.alias("province"), week.alias("week")))
    parsed = B.table(spark, sf, "events").select("event_id", text.alias("text")).withColumn(
        "u", parse_json(F.col("text"))
    )
    return parsed.select("event_id", "u.week", "u.province")


@query(
    "row_constraints",
    f"with {UPLOADS_SQL} select event_id, week, cases, "
    + " || ".join(f"case when {c} then '' else '{n};' end" for n, c in _RULES)
    + " as failed from uploads",
)
def row_constraints(spark, sf):
    df = uploads(spark, sf)
    checked = V.with_failures(df, V.upload_rules(df))
    text = F.concat_ws("", F.transform("failed", lambda x: F.concat(x, F.lit(";"))))
    return checked.select("event_id", "week", "cases", text.alias("failed"))


@query(
    "rule_counts",
    f"with {UPLOADS_SQL} "
    + " union all ".join(f"select '{n}' as rule, count(*) as n from uploads where not ({c}) having count(*) > 0" for n, c in _RULES),
)
def rule_counts(spark, sf):
    df = uploads(spark, sf)
    return V.failures_per_rule(df, V.upload_rules(df))


_DOMAIN = """domain as (select n_name as province from nation join region on n_regionkey = r_regionkey
  where r_name <> 'MIDDLE EAST')"""


def domain(spark, sf):
    return B.region_nations(spark, sf, F.col("r_name") != "MIDDLE EAST")


@query(
    "domain_violations",
    f"""with {UPLOADS_SQL}, {_DOMAIN} select province, count(*) as n from uploads
    where province not in (select province from domain) group by 1""",
)
def domain_violations(spark, sf):
    return V.unknown_entities(uploads(spark, sf), domain(spark, sf))


_VALID = f"""valid as (select * from uploads where province in (select province from domain)
  and {' and '.join(c for _, c in _RULES)})"""

_UPSERT = f"""with {UPLOADS_SQL}, {_DOMAIN}, {_VALID}
  select province, year, week, event_id, cases from (select *,
  row_number() over (partition by province, year, week order by ts desc, event_id desc) as rn from valid) where rn = 1"""


@query("upload_upsert", _UPSERT)
def upload_upsert(spark, sf):
    """Later uploads replace earlier ones of the same key."""
    good, _ = S.check_batch(uploads(spark, sf), domain(spark, sf))
    half = F.lit("2024-01-16").cast("date")
    early, late = good.where(F.col("ts") < half), good.where(F.col("ts") >= half)
    made = S.upsert(early, late, ["ts", "event_id"])
    return made.select("province", "year", "week", "event_id", "cases")


@query(
    "quarantine",
    f"""with {UPLOADS_SQL}, {_DOMAIN}, {_VALID} select province, count(*) as n from uploads
    where event_id not in (select event_id from valid) group by 1""",
)
def quarantine(spark, sf):
    _, bad = S.check_batch(uploads(spark, sf), domain(spark, sf))
    return bad.groupBy("province").agg(F.count(F.lit(1)).alias("n"))


@query("upload_stream", _UPSERT)
def upload_stream(spark, sf):
    """The same result from a stream over the landed files."""
    landed = B.stream(spark, sf, "events")
    rows = landed.select(
        "event_id",
        F.concat(F.lit("NATION_"), (F.col("user_id") % 30).cast("string")).alias("province"),
        F.year("ts").alias("year"),
        F.from_json("props", "k int")["k"].alias("week"),
        (F.floor("value") - 5).alias("cases"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    target = scratch_path(spark, "uploads")
    S.start_ingestion(rows, domain(spark, sf), target, f"{target}/checkpoint").awaitTermination()
    made = S.current_panel(spark, target, ["ts", "event_id"])
    return made.select("province", "year", "week", "event_id", "cases")
