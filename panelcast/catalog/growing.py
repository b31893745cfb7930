"""Statistics and features over inputs that grow with the data; the weekly panel is bounded by its calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.catalog import bindings as B
from panelcast.catalog.registry import query
from panelcast.catalog.sql import r
from panelcast.catalog.windows import _CM
from panelcast.functions.numeric import half_up
from panelcast.operators import cleaning as C
from panelcast.operators import reports as P
from panelcast.operators import windows as W
from panelcast.operators.blocks import Blocks
from panelcast.operators.gram import wide_correlation
from panelcast.operators.ranking import global_rank
from panelcast.operators.scans import carry_scan
from panelcast.session import materialized

text = lambda c: F.col(c).cast("string").alias(c)
ITEM_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "customer_winsorize",
    f"""with {_CM}, caps as (select quantile_cont(cast(cases as double), 0.995) as a, quantile_cont(rainfall_mm, 0.995) as b
      from p)
    select entity, cast(date as varchar) as date, {r('least(cast(cases as double), a)', 4)} as cases,
      {r('least(rainfall_mm, b)', 4)} as rainfall_mm from p, caps""",
)
def customer_winsorize(spark, sf):
    panel = materialized(B.customer_months(spark, sf), "customers")
    names = ("cases", "rainfall_mm")
    made = C.apply_caps(panel, C.fit_caps(panel, names))
    return made.select("entity", text("date"), *[half_up(c, 4).alias(c) for c in names])


@query(
    "item_describe",
    "\nunion all ".join(
        f"""select '{c}' as "column", count({c}) as count, {r(f'avg({c})', 3)} as mean, {r(f'stddev_samp({c})', 3)} as std,
        min({c}) as min, {', '.join(f"{r(f'quantile_cont({c}, 0.{q})', 4)} as q{q}" for q in (25, 50, 75))},
        max({c}) as max from lineitem"""
        for c in ITEM_COLUMNS
    ),
)
def item_describe(spark, sf):
    """Exact quartiles of every order item."""
    made = P.describe(B.table(spark, sf, "lineitem").select(*ITEM_COLUMNS), ITEM_COLUMNS)
    return made.select(
        "column", "count", *[half_up(c, 3).alias(c) for c in ("mean", "std")], "min",
        *[half_up(c, 4).alias(c) for c in ("q25", "q50", "q75")], "max",
    )


@query(
    "item_correlation",
    "\nunion all ".join(
        f"select '{a}' as column_a, '{b}' as column_b, {r(f'corr({a}, {b})', 4)} as r from lineitem"
        for a in ITEM_COLUMNS for b in ITEM_COLUMNS
    ),
)
def item_correlation(spark, sf):
    made = P.correlation_matrix(B.table(spark, sf, "lineitem"), ITEM_COLUMNS)
    return made.select("column_a", "column_b", half_up("r", 4).alias("r"))


@query(
    "item_boxstats",
    f"""with q as (select l_returnflag as flag, quantile_cont(l_extendedprice, 0.25) as q1,
      quantile_cont(l_extendedprice, 0.5) as median, quantile_cont(l_extendedprice, 0.75) as q3 from lineitem group by 1),
    x as (select *, l_extendedprice between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside
      from lineitem join q on flag = l_returnflag)
    select flag, {', '.join(f'{r(c, 4)} as {c}' for c in ('q1', 'median', 'q3'))}, count(l_extendedprice) as n,
      min(l_extendedprice) filter (where inside) as whisker_low, max(l_extendedprice) filter (where inside) as whisker_high,
      count(*) filter (where not inside) as outliers from x group by flag, q1, median, q3""",
)
def item_boxstats(spark, sf):
    """Box statistics of three groups that hold all items: nothing is shuffled by group."""
    items = B.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    made = P.box_stats(items, "flag", "l_extendedprice")
    return made.select(
        "flag", *[half_up(c, 4).alias(c) for c in ("q1", "median", "q3")], "n", "whisker_low", "whisker_high", "outliers"
    )


GRAM_COLUMNS = ["cases", "rainfall_mm", *[f"{c}_lag{k}w" for c in ("cases", "rainfall_mm") for k in W.LAGS]]


@query(
    "lag_correlation",
    f"with {_CM}, wide as (select cases, rainfall_mm, "
    + ", ".join(f"lag({c}, {k}) over w as {c}_lag{k}w" for c in GRAM_COLUMNS[:2] for k in W.LAGS)
    + " from p window w as (partition by entity order by date))\n"
    + "\nunion all ".join(f"select '{a}' as column_a, '{b}' as column_b, {r(f'corr({a}, {b})', 4)} as r from wide"
                          for a in GRAM_COLUMNS for b in GRAM_COLUMNS),
)
def lag_correlation(spark, sf):
    """Every customer's months against their lags, which have holes: all pairs from one set of matrix products."""
    panel = materialized(B.customer_months(spark, sf), "customers")
    wide = W.add_lags(panel, B.CUSTOMER_SPEC, GRAM_COLUMNS[:2])
    return wide_correlation(wide, GRAM_COLUMNS).select("column_a", "column_b", half_up("r", 4).alias("r"))


@query(
    "order_ranking",
    "select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) as place from orders",
)
def order_ranking(spark, sf):
    """The place of every order by its price: a rank over all rows without one task that sorts them."""
    orders = B.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return global_rank(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], "place").select("o_orderkey", "place")


_HOT = "case when event_id % 3 = 0 then 'every third' else event_type end"


@query(
    "event_carry",
    f"""select event_id, last_value(case when value >= 60 then value end ignore nulls) over w as last_high,
      cast(sum(cast(floor(value * 100 + 0.5) as bigint)) over w as bigint) as hundredths
    from (select *, {_HOT} as series from events)
    window w as (partition by series order by ts, event_id rows between unbounded preceding and current row)""",
)
def event_carry(spark, sf):
    """The last high value and the running total of few, very long series, one with a third of all rows."""
    events = B.table(spark, sf, "events").select("event_id", F.expr(_HOT).alias("series"), "ts", "value")
    blocks = Blocks(chunk=F.date_trunc("hour", F.col("ts").cast("timestamp")), rows=512)
    made = carry_scan(
        events, "series", ["ts", "event_id"], blocks, {"last_high": F.when(F.col("value") >= 60, F.col("value"))},
        {"hundredths": F.floor(F.col("value") * 100 + 0.5)},
    )
    return made.select("event_id", "last_high", "hundredths")


@query(
    "customer_tail",
    f"""with {_CM}, t as (select *, row_number() over (partition by entity order by date desc) as b from p)
    select entity, max(cast(date as varchar)) as date, cast(least(count(*), 12) as int) as observed,
      {r('sum(rainfall_mm) + (12 - count(*)) * max(rainfall_mm) filter (where b = n)', 2)} as total
    from (select *, count(*) over (partition by entity) as n from t where b <= 12) group by entity""",
)
def customer_tail(spark, sf):
    """The last twelve months of every customer, short series filled up with their earliest row."""
    made = W.tail_sequence(B.customer_months(spark, sf), ["cases", "rainfall_mm"], B.CUSTOMER_SPEC)
    total = F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x[1])
    return made.select("entity", text("date"), "observed", half_up(total, 2).alias("total"))
