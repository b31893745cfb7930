"""Checks on uploaded rows and on response ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.spec import PanelSpec

REQUIRED_COLUMNS = ("province", "year", "week", "cases")


def require_columns(df: DataFrame, columns=REQUIRED_COLUMNS) -> DataFrame:
    """``df`` itself; a missing column is an error."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def upload_rules(df: DataFrame) -> dict[str, Column]:
    """Rule name -> condition that a valid row fulfils, for the columns present.

    Optional values may be null; required ones may not.
    """
    c = F.col
    required = {
        "year_range": ("year", lambda: c("year").between(2000, 2100)),
        "week_range": ("week", lambda: c("week").between(1, 53)),
        "cases_nonnegative": ("cases", lambda: c("cases") >= 0),
    }
    optional = {
        "deaths_nonnegative": ("deaths", lambda: c("deaths") >= 0),
        "rainfall_nonnegative": ("rainfall_mm", lambda: c("rainfall_mm") >= 0),
        "humidity_range": ("humidity_pct", lambda: c("humidity_pct").between(0, 100)),
    }
    rules = {n: F.coalesce(f(), F.lit(False)) for n, (col, f) in required.items() if col in df.columns}
    rules |= {n: F.coalesce(f(), F.lit(True)) for n, (col, f) in optional.items() if col in df.columns}
    return rules


def forecast_rules(weeks: list[str], peak_week: str) -> dict[str, Column]:
    """Ranges of a served forecast."""
    rules = {f"{w}_range": F.coalesce(F.col(w).between(0, 100), F.lit(False)) for w in weeks}
    rules["peak_week_range"] = F.coalesce(F.col(peak_week).between(1, 4), F.lit(False))
    return rules


def with_failures(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``failed``: names of the rules a row breaks, in rule order."""
    names = [F.when(~ok, F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("failed", F.array_compact(F.array(*names)))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, broken rows with their ``failed`` list)."""
    checked = with_failures(df, rules)
    good = F.size("failed") == 0
    return checked.where(good).drop("failed"), checked.where(~good)


def failures_per_rule(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return (
        with_failures(df, rules)
        .select(F.explode("failed").alias("rule"))
        .groupBy("rule")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def unknown_entities(df: DataFrame, domain: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Entities that are not in the domain, with the rows they bring.

    Counted first, so the anti join sees one row per entity.
    """
    counted = df.groupBy(spec.entity).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(domain.select(spec.entity), spec.entity, "left_anti")


def split_domain(
    df: DataFrame, domain: DataFrame, spec: PanelSpec = PanelSpec()
) -> tuple[DataFrame, DataFrame]:
    """(rows of known entities, rows of unknown ones)."""
    names = domain.select(spec.entity)
    return df.join(names, spec.entity, "left_semi"), df.join(names, spec.entity, "left_anti")


def check_domain(
    df: DataFrame, domain: DataFrame, mode: str = "reject", spec: PanelSpec = PanelSpec()
) -> DataFrame:
    """Known rows only; with ``reject`` one unknown entity refuses the whole upload, and all are named.

    ``unknown_entities`` gives them as a table, for uploads that may hold very many."""
    if mode == "reject":
        names = unknown_entities(df, domain, spec).select(spec.entity).collect()
        if names:
            raise ValueError(f"unknown entities: {sorted(str(r[0]) for r in names)}")
        return df
    return split_domain(df, domain, spec)[0]
