"""Incidence, the composite risk index, and what is read off it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.numeric import clamp, half_up

# Terms of the index as (column, start, span, weight, clipped).
RISK_TERMS = (
    ("incidence_rate_100k", 0.0, 100.0, 40.0, True),
    ("rainfall_mm", 0.0, 300.0, 25.0, True),
    ("temp_avg_c", 20.0, 15.0, 20.0, True),
    ("humidity_pct", 50.0, 50.0, 10.0, True),
    ("poverty_index", 0.0, 100.0, 5.0, False),
)

# Lower bounds of the classes, inclusive, in ascending order.
RISK_CLASSES = (
    ("Bajo", None),
    ("Moderado", 25.0),
    ("Alto", 50.0),
    ("Epidemia", 65.0),
    ("Critico", 80.0),
)
NO_DATA = "Sin datos"
EPIDEMIC_THRESHOLD = 65.0
ALERT_THRESHOLD = 80.0


def incidence(cases: Column, population: Column, digits: int | None = None) -> Column:
    """Cases per 100,000 people; 0 where it cannot be computed."""
    rate = F.coalesce(
        F.try_divide(cases.cast("double"), population) * F.lit(100000.0), F.lit(0.0)
    )
    return rate if digits is None else half_up(rate, digits)


def risk_index(df: DataFrame, terms=RISK_TERMS, digits: int | None = 2) -> Column:
    """Weighted 0-100 index over those of the terms whose column exists.

    A null value makes the index null; a missing column only drops its term.
    """
    total = None
    for name, start, span, weight, clipped in terms:
        if name not in df.columns:
            continue
        share = (F.col(name) - F.lit(start)) / F.lit(span)
        part = (clamp(share, 0.0, 1.0) if clipped else share) * F.lit(weight)
        total = part if total is None else total + part
    total = clamp(F.lit(0.0) if total is None else total, 0.0, 100.0)
    return total if digits is None else half_up(total, digits)


def risk_class(risk: Column, classes=RISK_CLASSES) -> Column:
    """Class label of a risk value; null for null."""
    out = F.lit(classes[0][0])
    for label, floor in classes[1:]:
        out = F.when(risk >= F.lit(floor), F.lit(label)).otherwise(out)
    return F.when(risk.isNotNull(), out)


def class_order(label: Column, classes=RISK_CLASSES, unknown: int = 9) -> Column:
    """1-based position of a class label, ``unknown`` for any other."""
    out = F.lit(unknown)
    for i, (name, _) in enumerate(classes, 1):
        out = F.when(label == F.lit(name), F.lit(i)).otherwise(out)
    return out


def is_epidemic(risk: Column) -> Column:
    return risk >= F.lit(EPIDEMIC_THRESHOLD)


def is_alert(risk: Column) -> Column:
    return risk >= F.lit(ALERT_THRESHOLD)


def alert_type(risk: Column) -> Column:
    return F.when(is_alert(risk), F.lit("Critico")).otherwise(F.lit("Epidemia"))


def trend_label(values: list[Column], up: float = 2.0, down: float = -2.0) -> Column:
    """Label of the least-squares slope of ``values`` against their position."""
    n = len(values)
    if n < 2:
        return F.lit("Estable")
    centre = (n - 1) / 2.0
    spread = sum((i - centre) ** 2 for i in range(n))
    slope = None
    for i, value in enumerate(values):
        part = value * F.lit((i - centre) / spread)
        slope = part if slope is None else slope + part
    return (
        F.when(slope > F.lit(up), F.lit("Ascendente"))
        .when(slope < F.lit(down), F.lit("Descendente"))
        .otherwise(F.lit("Estable"))
    )
