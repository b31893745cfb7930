"""Lags, rolling statistics, targets, sequences, latest rows.

Builders return ``{name: Column}`` for a given window, so that any number of
them can share one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelcast.functions.sqltext import quoted
from panelcast.spec import PanelSpec, present

# Source columns, lags, window lengths, sequence shape.
LAG_COLUMNS = ("cases", "outbreak_risk_index", "rainfall_mm", "temp_avg_c")
LAGS = (1, 2, 3, 4, 8, 12)
ROLLING_COLUMNS = ("cases", "rainfall_mm", "temp_avg_c", "humidity_pct")
ROLLING_WINDOWS = (4, 8, 12)
SEQUENCE_LENGTH = 12
HORIZON = 4


def filled_array(columns: list[str]) -> Column:
    """Numeric columns of a row as an array of doubles, nulls as 0."""
    return F.expr(f"array({', '.join(f'coalesce(cast({quoted(c)} as double), 0.0D)' for c in columns)})")


def lag_columns(w: WindowSpec, columns, lags=LAGS) -> dict[str, Column]:
    """``<c>_lag<k>w``: the value k rows earlier."""
    return {f"{c}_lag{k}w": F.lag(c, k).over(w) for c in columns for k in lags}


def rolling_mean_columns(w: WindowSpec, columns, windows=ROLLING_WINDOWS) -> dict[str, Column]:
    return {
        f"{c}_roll{n}w_mean": F.avg(c).over(w.rowsBetween(-(n - 1), 0))
        for c in columns
        for n in windows
    }


def rolling_std_columns(w: WindowSpec, columns, windows=ROLLING_WINDOWS) -> dict[str, Column]:
    """Sample deviation; 0 where a single value leaves it undefined."""
    return {
        f"{c}_roll{n}w_std": F.coalesce(
            F.stddev_samp(c).over(w.rowsBetween(-(n - 1), 0)), F.lit(0.0)
        )
        for c in columns
        for n in windows
    }


def target_columns(
    w: WindowSpec, target: str, horizon: int = HORIZON, tail: str = "drop"
) -> dict[str, Column]:
    """``target_week_<h>``: the value h rows on.

    Past the end it is null with ``tail="drop"``; ``"hold"`` repeats the
    entity's last value, and 0 where there is none.
    """
    out = {}
    for h in range(1, horizon + 1):
        ahead = F.lead(target, h).over(w)
        if tail == "hold":
            whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            ahead = F.coalesce(ahead, F.last(target, ignorenulls=True).over(whole), F.lit(0.0))
        out[f"target_week_{h}"] = ahead
    return out


def add_lags(df: DataFrame, spec: PanelSpec = PanelSpec(), columns=LAG_COLUMNS, lags=LAGS) -> DataFrame:
    return df.withColumns(lag_columns(spec.window(df), present(df, columns), lags))


def _merge(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """Count, mean and squared deviations of two blocks taken together."""
    n = a["n"] + b["n"]
    gap = b["mean"] - a["mean"]
    share = F.coalesce(F.try_divide(b["n"], n), F.lit(0.0))
    return {
        "n": n,
        "mean": a["mean"] + gap * share,
        "m2": a["m2"] + b["m2"] + gap * gap * a["n"] * share,
    }


def add_rolling(
    df: DataFrame, spec: PanelSpec = PanelSpec(), columns=ROLLING_COLUMNS, windows=ROLLING_WINDOWS
) -> DataFrame:
    """Rolling means and sample deviations of several lengths.

    Where all lengths are multiples of the shortest, only that one slides over
    the rows; the longer ones merge its value here with its values further back.
    Same shuffle and sort, a fraction of the updates per row.
    """
    names, w, step = present(df, columns), spec.window(df), min(windows)
    if any(n % step for n in windows):
        return df.withColumns(
            rolling_mean_columns(w, names, windows) | rolling_std_columns(w, names, windows)
        )
    frame = w.rowsBetween(-(step - 1), 0)
    blocks = df.withColumns(
        {
            f"_{c}_0": F.struct(
                F.count(c).over(frame).cast("double").alias("n"),
                F.avg(c).over(frame).alias("mean"),
                F.var_pop(c).over(frame).alias("var"),
            )
            for c in names
        }
    )
    count = max(windows) // step
    earlier = {f"_{c}_{i}": F.lag(f"_{c}_0", i * step).over(w) for c in names for i in range(1, count)}
    made = {}
    for c in names:
        total = None
        for i in range(count):
            zero = lambda part: F.coalesce(F.col(f"_{c}_{i}.{part}"), F.lit(0.0))  # noqa: B023, E731
            block = {"n": zero("n"), "mean": zero("mean"), "m2": zero("var") * zero("n")}
            total = block if total is None else _merge(total, block)
            length = (i + 1) * step
            if length in windows:
                some = total["n"] > 0
                made[f"{c}_roll{length}w_mean"] = F.when(some, total["mean"])
                made[f"{c}_roll{length}w_std"] = F.coalesce(
                    F.sqrt(F.try_divide(F.greatest(total["m2"], F.lit(0.0)), total["n"] - 1)), F.lit(0.0)
                )
    helpers = [f"_{c}_{i}" for c in names for i in range(count)]
    return blocks.withColumns(earlier).withColumns(made).drop(*helpers)


def add_targets(
    df: DataFrame, spec: PanelSpec = PanelSpec(), horizon: int = HORIZON, tail: str = "drop"
) -> DataFrame:
    out = df.withColumns(target_columns(spec.window(df), spec.target, horizon, tail))
    if tail == "drop":
        out = out.dropna(subset=[f"target_week_{h}" for h in range(1, horizon + 1)])
    return out


def forward_fill(df: DataFrame, columns: list[str], spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Last known value so far, within the entity."""
    upto = spec.window(df).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in columns})


def cumulative_in_year(
    df: DataFrame, column: str, name: str, spec: PanelSpec = PanelSpec()
) -> DataFrame:
    w = Window.partitionBy(spec.entity, spec.year).orderBy(*spec.order(df))
    return df.withColumn(name, F.sum(column).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def densify(df: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """One row per entity and week from its first to its last date.

    Row lags shift silently over a missing week; on the dense panel they do not.
    Each row emits the weeks up to the next one, so a gap costs what it spans.
    """
    w = spec.window(df)
    day = F.col(spec.date)
    # An entity's last row spans only itself.
    until = F.coalesce(F.date_sub(F.lead(spec.date).over(w), 7), day)
    weeks = F.explode(F.sequence(day, F.greatest("_until", day), F.expr("interval 7 days")))
    other = [c for c in df.columns if c not in (spec.entity, spec.date)]
    spread = df.withColumn("_until", until).select(
        spec.entity, day.alias("_own"), *other, weeks.alias(spec.date)
    )
    own = F.col("_own") == F.col(spec.date)
    return spread.select(
        spec.entity, spec.date, *[F.when(own, F.col(c)).alias(c) for c in other], (~own).alias("is_filled")
    )


def sequences(
    df: DataFrame,
    features: list[str],
    spec: PanelSpec = PanelSpec(),
    length: int = SEQUENCE_LENGTH,
    horizon: int = HORIZON,
) -> DataFrame:
    """Every window of ``length`` rows with the ``horizon`` target values after it.

    ``sequence`` is an array of feature arrays, ``targets`` an array of doubles;
    the date is that of the last row of the window.
    """
    w = spec.window(df)
    row = F.array(*[F.col(c).cast("double") for c in features])
    ahead = [F.lead(spec.target, h).over(w) for h in range(1, horizon + 1)]
    built = df.select(
        spec.entity,
        spec.date,
        F.collect_list(row).over(w.rowsBetween(-(length - 1), 0)).alias("sequence"),
        F.array(*ahead).alias("targets"),
        # Position from the end tells whether all target rows exist.
        F.lead(F.lit(1), horizon).over(w).alias("_whole"),
    )
    return built.where((F.size("sequence") == length) & F.col("_whole").isNotNull()).drop("_whole")


def latest_row(df: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """The last row of each entity, as an aggregate with map-side combine."""
    rest = [c for c in df.columns if c != spec.entity]
    last = df.groupBy(spec.entity).agg(
        F.max_by(F.struct(*rest), F.struct(*spec.order(df))).alias("_row")
    )
    return last.selectExpr(
        *[quoted(c) if c == spec.entity else f"_row.{quoted(c)} as {quoted(c)}" for c in df.columns]
    )


def tail_rows(df: DataFrame, n: int, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """The last ``n`` rows of each entity; ``_back`` is 1 for the latest.

    Spark limits each group before the shuffle, so an entity sends at most
    ``n`` rows per map task.
    """
    w = Window.partitionBy(spec.entity).orderBy(*[F.desc(c) for c in spec.order(df)])
    return df.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= n)


def tail_sequence(
    df: DataFrame,
    features: list[str],
    spec: PanelSpec = PanelSpec(),
    length: int = SEQUENCE_LENGTH,
    pad: str = "edge",
) -> DataFrame:
    """The last ``length`` rows of each entity as one array of feature arrays.

    Short series are filled in front with their earliest row (``edge``) or with
    zeros (``zero``). Nulls count as 0.
    """
    row = filled_array(features)
    tail = tail_rows(df, length, spec).groupBy(spec.entity).agg(
        # At most ``length`` items.
        F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("p"), row.alias("x")))).alias("s"),
        F.max(spec.date).alias(spec.date),
    )
    seq = F.transform("s", lambda e: e["x"])
    front = (
        F.element_at(seq, 1)
        if pad == "edge"
        else F.array(*[F.lit(0.0) for _ in features])
    )
    missing = F.lit(length) - F.size("s")
    return tail.select(
        spec.entity,
        spec.date,
        F.concat(F.array_repeat(front, missing), seq).alias("sequence"),
        F.size("s").cast("int").alias("observed"),
    )
