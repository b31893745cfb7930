"""Calendar expressions: epidemiological weeks, week dates, cyclic encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cycle lengths and the weeks of the rainy season.
WEEKS_PER_CYCLE = 52
MONTHS_PER_CYCLE = 12
RAINY_SEASON = (18, 44)


def week_start(date: Column) -> Column:
    """Monday of the week of ``date``."""
    return F.date_sub(date, F.weekday(date))


def iso_year(date: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), date).cast("int")


def iso_week(date: Column) -> Column:
    return F.weekofyear(date).cast("int")


def week_to_date(year: Column, week: Column) -> Column:
    """Monday of week ``week`` where week 1 holds the first Monday of the year."""
    first_monday = F.next_day(F.make_date(year - 1, F.lit(12), F.lit(31)), "MON")
    return F.date_add(first_monday, ((week - 1) * 7).cast("int"))


def iso_week_to_date(year: Column, week: Column) -> Column:
    """Monday of ISO week ``week``; week 1 is the week of January 4."""
    return F.date_add(
        week_start(F.make_date(year, F.lit(1), F.lit(4))), ((week - 1) * 7).cast("int")
    )


def cyclic(x: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of the position of ``x`` in a cycle of ``period``."""
    angle = x * F.lit(2.0 * math.pi) / F.lit(period)
    return F.sin(angle), F.cos(angle)


def temporal_features(week: Column, date: Column) -> dict[str, Column]:
    """The calendar columns derived from a week number and a date."""
    month = F.month(date)
    week_sin, week_cos = cyclic(week, WEEKS_PER_CYCLE)
    month_sin, month_cos = cyclic(month, MONTHS_PER_CYCLE)
    return {
        "week_sin": week_sin,
        "week_cos": week_cos,
        "is_rainy_season": week.between(*RAINY_SEASON).cast("int"),
        "month": month,
        "month_sin": month_sin,
        "month_cos": month_cos,
    }


def forecast_date(as_of: Column, horizon: Column) -> Column:
    """The date ``horizon`` weeks after the run date."""
    return F.date_add(as_of, (horizon * 7).cast("int"))
