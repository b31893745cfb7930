"""Display texts: colours, symbols, badges, number formats, short names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelcast.functions.numeric import half_up
from panelcast.sources.reference_data import SHORT_NAMES

# Display text of each class.
COLORS = {
    "Bajo": "#28a745", "Moderado": "#ffc107", "Alto": "#fd7e14",
    "Epidemia": "#dc3545", "Critico": "#6f0000", "Sin datos": "#6c757d",
}
EMOJIS = {
    "Bajo": "🟢", "Moderado": "🟡", "Alto": "🟠",
    "Epidemia": "🔴", "Critico": "⚫", "Sin datos": "⚪",
}
MARKER_COLORS = {
    "Bajo": "green", "Moderado": "yellow", "Alto": "orange",
    "Epidemia": "red", "Critico": "darkred",
}
ACCENTED = {"Critico": "Crítico"}
BADGE = '<span style="background:%s;color:white;padding:2px 8px;border-radius:4px;">%s (%s)</span>'


def lookup(key: Column, table: Mapping[str, str], default: Column | str) -> Column:
    """Entry of a small fixed table, ``default`` for any other key."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    fallback = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.try_element_at(entries, key), fallback)


def color(level: Column) -> Column:
    return lookup(level, COLORS, "#6c757d")


def emoji(level: Column) -> Column:
    return lookup(level, EMOJIS, "⚪")


def marker_color(level: Column) -> Column:
    return lookup(level, MARKER_COLORS, "gray")


def display_level(level: Column) -> Column:
    return lookup(level, ACCENTED, level)


def fixed(x: Column, digits: int = 1) -> Column:
    """Decimal text with ``digits`` places."""
    return F.format_string(f"%.{digits}f", half_up(x, digits))


def badge(risk: Column, level: Column) -> Column:
    return F.format_string(BADGE, color(level), display_level(level), fixed(risk, 1))


def short_number(x: Column, digits: int = 1) -> Column:
    """Millions as M, thousands as K."""
    x = x.cast("double")
    return (
        F.when(x >= 1_000_000, F.concat(fixed(x / 1_000_000, digits), F.lit("M")))
        .when(x >= 1_000, F.concat(fixed(x / 1_000, digits), F.lit("K")))
        .otherwise(fixed(x, digits))
    )


def short_name(name: Column, table: Mapping[str, str] = SHORT_NAMES) -> Column:
    out = name
    for long, short in table.items():
        out = F.replace(out, F.lit(long), F.lit(short))
    return out


def first_token(name: Column) -> Column:
    return F.get(F.split(F.trim(name), r"\s+"), F.lit(0))
