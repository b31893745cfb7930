"""Window and time-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.catalog import bindings as B
from panelcast.catalog.registry import query
from panelcast.catalog.sql import over_panel, over_sources, r
from panelcast.functions.numeric import half_up
from panelcast.operators import windows as W
from panelcast.operators.blocks import Blocks, apply_in_blocks
from panelcast.operators.incremental import refreshed
from panelcast.session import materialized
from panelcast.spec import PanelSpec

text = lambda c: F.col(c).cast("string").alias(c)
KEY = ("province", "date")
KEY_SQL = "province, cast(date as varchar) as date"


def over_w(select: str, ctes: str = "") -> str:
    return over_panel(f"{select} from panel window w as (partition by province order by date)", ctes)


def rounded(df, names, digits=4):
    return df.select("province", text("date"), *[half_up(n, digits).alias(n) for n in names])


@query(
    "lag_features",
    over_w(
        f"select {KEY_SQL}, "
        + ", ".join(f"lag({c}, {k}) over w as {c}_lag{k}w" for c in W.LAG_COLUMNS for k in W.LAGS)
    ),
)
def lag_features(spark, sf):
    made = W.add_lags(B.panel(spark, sf))
    return made.select("province", text("date"), *[f"{c}_lag{k}w" for c in W.LAG_COLUMNS for k in W.LAGS])


def _rolling_sql(fn: str, name: str) -> str:
    cells = []
    for c in W.ROLLING_COLUMNS:
        for n in W.ROLLING_WINDOWS:
            x = f"coalesce({fn}({c}) over (w rows between {n-1} preceding and current row), 0)"
            cells.append(f"{r(x, 4)} as {c}_roll{n}w_{name}")
    return over_w(f"select {KEY_SQL}, " + ", ".join(cells))


@query("rolling_mean", _rolling_sql("avg", "mean"))
def rolling_mean(spark, sf):
    panel = B.panel(spark, sf)
    made = W.rolling_mean_columns(B.SPEC.window(panel), W.ROLLING_COLUMNS)
    return rounded(panel.withColumns(made), made)


@query("rolling_std", _rolling_sql("stddev_samp", "std"))
def rolling_std(spark, sf):
    panel = B.panel(spark, sf)
    made = W.rolling_std_columns(B.SPEC.window(panel), W.ROLLING_COLUMNS)
    return rounded(panel.withColumns(made), made)


@query(
    "lead_targets",
    over_panel(
        f"select * from (select {KEY_SQL}, "
        + ", ".join(f"lead(outbreak_risk_index, {h}) over w as target_week_{h}" for h in range(1, 5))
        + " from panel window w as (partition by province order by date)) where target_week_4 is not null"
    ),
)
def lead_targets(spark, sf):
    made = W.add_targets(B.panel(spark, sf))
    return made.select("province", text("date"), *[f"target_week_{h}" for h in range(1, 5)])


@query(
    "lead_targets_hold",
    over_w(
        f"select {KEY_SQL}, "
        + ", ".join(
            f"coalesce(lead(outbreak_risk_index, {h}) over w, last_value(outbreak_risk_index) over "
            f"(w rows between unbounded preceding and unbounded following), 0) as target_week_{h}"
            for h in range(1, 5)
        )
    ),
)
def lead_targets_hold(spark, sf):
    made = W.add_targets(B.panel(spark, sf), tail="hold")
    return made.select("province", text("date"), *[f"target_week_{h}" for h in range(1, 5)])


@query(
    "forward_fill",
    over_sources(
        f"""select {KEY_SQL}, last_value(k.cases ignore nulls) over (partition by province order by date
        rows between unbounded preceding and current row) as cases
        from climate c left join cases k using (province, year, week)"""
    ),
)
def forward_fill(spark, sf):
    """Weeks without a report take the last reported count."""
    open_join = B.climate_weeks(spark, sf).join(B.case_weeks(spark, sf), B.SPEC.key, "left")
    return W.forward_fill(open_join, ["cases"]).select("province", text("date"), "cases")


@query(
    "cumulative_year",
    over_panel(
        f"""select {KEY_SQL}, cast(sum(cases) over (partition by province, year order by date
        rows between unbounded preceding and current row) as bigint) as cases_cumulative_year from panel"""
    ),
)
def cumulative_year(spark, sf):
    made = W.cumulative_in_year(B.panel(spark, sf), "cases", "cases_cumulative_year")
    return made.select("province", text("date"), "cases_cumulative_year")


@query(
    "densify",
    over_panel(
        """select s.province, cast(s.date as varchar) as date, p.cases, p.outbreak_risk_index,
        lag(p.cases, 1) over (partition by s.province order by s.date) as cases_lag1w, p.date is null as is_filled
        from spans s left join panel p on p.province = s.province and p.date = s.date""",
        """spans as (select province, cast(unnest(generate_series(min(date), max(date), interval 7 day)) as date) as date
        from panel group by province)""",
    ),
)
def densify(spark, sf):
    dense = W.densify(B.panel(spark, sf))
    return W.add_lags(dense, columns=("cases",), lags=(1,)).select(
        "province", text("date"), "cases", "outbreak_risk_index", "cases_lag1w", "is_filled"
    )


SEQUENCE_FEATURES = ["cases", "rainfall_mm", "temp_avg_c"]


@query(
    "sequences",
    over_panel(
        """select e.province, cast(e.date as varchar) as date, cast(s.rn - e.rn + 12 as int) as step,
        cast(s.cases as double) as cases, s.rainfall_mm, s.temp_avg_c, e.y1, e.y2, e.y3, e.y4
        from x e join x s on s.province = e.province and s.rn between e.rn - 11 and e.rn
        where e.rn >= 12 and e.rn + 4 <= e.n""",
        """x as (select province, date, cases, rainfall_mm, temp_avg_c, row_number() over w as rn,
        count(*) over (partition by province) as n,
        """
        + ", ".join(f"lead(outbreak_risk_index, {h}) over w as y{h}" for h in range(1, 5))
        + " from panel window w as (partition by province order by date))",
    ),
)
def sequences(spark, sf):
    made = W.sequences(B.panel(spark, sf), SEQUENCE_FEATURES)
    steps = made.select("province", text("date"), "targets", F.posexplode("sequence").alias("i", "x"))
    return steps.select(
        "province", "date", (F.col("i") + 1).cast("int").alias("step"),
        *[F.col("x")[i].alias(c) for i, c in enumerate(SEQUENCE_FEATURES)],
        *[F.col("targets")[h].alias(f"y{h + 1}") for h in range(4)],
    )


@query(
    "latest_row",
    over_panel(
        f"""select {KEY_SQL}, year, week, cases, outbreak_risk_index from (
        select *, row_number() over (partition by province order by date desc) as rn from panel) where rn = 1"""
    ),
)
def latest_row(spark, sf):
    return W.latest_row(B.panel(spark, sf)).select(
        "province", text("date"), "year", "week", "cases", "outbreak_risk_index"
    )


ACTIVE = PanelSpec(entity="custkey")


def _active_months(spark, sf):
    """Months in which a customer ordered: many series shorter than twelve."""
    orders = B.table(spark, sf, "orders")
    return orders.groupBy(
        F.col("o_custkey").alias("custkey"),
        F.trunc(F.col("o_orderdate").cast("date"), "month").alias("date"),
    ).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))


def _tail_sql(pad_n: str, pad_top: str) -> str:
    return f"""with m as (select o_custkey as custkey, cast(date_trunc('month', o_orderdate) as date) as date,
      count(*) as n, max(o_totalprice) as top from orders group by 1, 2),
    t as (select *, row_number() over (partition by custkey order by date desc) as back,
      count(*) over (partition by custkey) as size, max(date) over (partition by custkey) as last from m),
    k as (select * from t where back <= 12),
    e as (select custkey, last, least(size, 12) as observed, n as n0, top as top0 from k where back = least(size, 12))
    select e.custkey, cast(e.last as varchar) as date, cast(e.observed as int) as observed, cast(s.step as int) as step,
      cast(coalesce(k.n, {pad_n}) as double) as n, coalesce(k.top, {pad_top}) as top
    from e cross join (select unnest(generate_series(1, 12)) as step) s
    left join k on k.custkey = e.custkey and k.back = 13 - s.step"""


def _tail(spark, sf, pad):
    made = W.tail_sequence(_active_months(spark, sf), ["n", "top"], ACTIVE, pad=pad)
    return made.select(
        "custkey", text("date"), "observed", F.posexplode("sequence").alias("i", "x")
    ).select(
        "custkey", "date", "observed", (F.col("i") + 1).cast("int").alias("step"),
        F.col("x")[0].alias("n"), F.col("x")[1].alias("top"),
    )


@query("tail_sequence_pad_edge", _tail_sql("e.n0", "e.top0"))
def tail_sequence_pad_edge(spark, sf):
    return _tail(spark, sf, "edge")


@query("tail_sequence_pad_zero", _tail_sql("0", "0"))
def tail_sequence_pad_zero(spark, sf):
    return _tail(spark, sf, "zero")


@query(
    "event_windows",
    "select event_id, event_type, lag(value, 1) over w as value_lag1w, lag(value, 12) over w as value_lag12w, "
    + r("avg(value) over (w rows between 11 preceding and current row)", 4)
    + " as value_roll12w_mean, lead(value, 4) over w as target_week_4 "
    "from events window w as (partition by event_type order by ts, event_id)",
)
def event_windows(spark, sf):
    """Lags and rolling means over few, very long series, cut into blocks."""
    events = B.table(spark, sf, "events").select("event_id", "event_type", "ts", "value")

    def build(w):
        lags = W.lag_columns(w, ["value"], (1, 12))
        mean = W.rolling_mean_columns(w, ["value"], (12,))
        target = {"target_week_4": F.lead("value", 4).over(w)}
        return lags | mean | target

    blocks = Blocks(chunk=F.date_trunc("hour", F.col("ts").cast("timestamp")), rows=512)
    made = apply_in_blocks(events, "event_type", ["ts", "event_id"], build, blocks, back=12, ahead=4)
    return made.select(
        "event_id", "event_type", "value_lag1w", "value_lag12w",
        half_up("value_roll12w_mean", 4).alias("value_roll12w_mean"), "target_week_4",
    )


_CM = """cm as (
  select o_custkey as entity, cast(date_trunc('month', o_orderdate) as date) as date, count(*) as n, sum(o_totalprice) as amount
  from orders group by 1, 2),
g as (select entity, cast(unnest(generate_series(min(date), max(date), interval 1 month)) as date) as date from cm group by entity),
p as (select g.entity, g.date, coalesce(n, 0) as cases, """ + r("coalesce(amount, 0)/1000", 2) + """ as rainfall_mm
  from g left join cm using (entity, date))"""


def _customer_sql() -> str:
    cells = [f"lag({c}, {k}) over w as {c}_lag{k}w" for c in ("cases", "rainfall_mm") for k in W.LAGS]
    for c in ("cases", "rainfall_mm"):
        for n in W.ROLLING_WINDOWS:
            frame = f"(w rows between {n-1} preceding and current row)"
            cells.append(f"{r(f'avg({c}) over {frame}', 4)} as {c}_roll{n}w_mean")
            cells.append(f"{r(f'coalesce(stddev_samp({c}) over {frame}, 0)', 4)} as {c}_roll{n}w_std")
    return (
        f"with {_CM} select entity, cast(date as varchar) as date, " + ", ".join(cells)
        + " from p window w as (partition by entity order by date)"
    )


@query("customer_features", _customer_sql())
def customer_features(spark, sf):
    """All lags and rolling statistics on the panel that grows with the data."""
    names = ["cases", "rainfall_mm"]
    panel = W.add_lags(B.customer_months(spark, sf), B.CUSTOMER_SPEC, names)
    made = W.add_rolling(panel, B.CUSTOMER_SPEC, names)
    rolls = [c for c in made.columns if "_roll" in c]
    lags = [c for c in made.columns if "_lag" in c]
    return made.select("entity", text("date"), *lags, *[half_up(c, 4).alias(c) for c in rolls])


# Every 97th month of a customer is corrected, every 101st is taken back.
_FIX, _OUT = "(entity * 31 + date_diff) % 97 = 0", "(entity * 31 + date_diff) % 101 = 0"
_MONTHS = "(extract(year from date) * 12 + extract(month from date))"


def _corrected_sql() -> str:
    place = lambda x: x.replace("date_diff", _MONTHS)
    cells = [f"lag(cases, {k}) over w as cases_lag{k}w" for k in W.LAGS]
    cells += [f"{r(f'avg(cases) over (w rows between {n - 1} preceding and current row)', 4)} as cases_roll{n}w_mean"
              for n in W.ROLLING_WINDOWS]
    return (
        f"with {_CM}, q as (select entity, date, cases + case when {place(_FIX)} then 5 else 0 end as cases from p"
        f" where not {place(_OUT)}) select entity, cast(date as varchar) as date, " + ", ".join(cells)
        + " from q window w as (partition by entity order by date)"
    )


@query("corrected_features", _corrected_sql())
def corrected_features(spark, sf):
    """Stored features after corrections and removals: only rows that a change reaches are computed again."""
    spec, names = B.CUSTOMER_SPEC, ["cases"]

    def build(df):
        w = spec.window(df)
        return df.withColumns(W.lag_columns(w, names) | W.rolling_mean_columns(w, names))

    months = F.year("date") * 12 + F.month("date")
    old = B.customer_months(spark, sf).select("entity", "date", "cases").withColumn("date_diff", months)
    old = materialized(old.selectExpr("entity", "date", "cases", f"{_FIX} as fixed", f"{_OUT} as out"), "customers")
    stored = materialized(build(old.select("entity", "date", "cases")), "features")
    now = old.where("not out").selectExpr("entity", "date", "cases + if(fixed, 5, 0) as cases")
    made = refreshed(stored, now, old.where("fixed or out"), build, max(*W.LAGS, *W.ROLLING_WINDOWS), spec)
    return made.select("entity", text("date"), *[c for c in made.columns if "_lag" in c],
                       *[half_up(c, 4).alias(c) for c in made.columns if "_roll" in c])
