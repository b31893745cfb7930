"""Joins that build the panel, and lookups against the entity dimension.

No side is broadcast by hint: Spark broadcasts a side whose size, from file
statistics or measured at run time, is under its threshold, and sort-merges
otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.risk import NO_DATA, incidence, risk_index
from panelcast.spec import PanelSpec

# What an entity outside the dimension gets.
DEFAULT_CODE = "RD00"
DEFAULT_LATITUDE = 18.7
DEFAULT_LONGITUDE = -70.2


def join_cases(climate: DataFrame, cases: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Climate is the spine; a period without reports counts 0."""
    counts = [c for c in cases.columns if c not in spec.key]
    joined = climate.join(cases, spec.key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})


def join_dimension(df: DataFrame, dim: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    return df.join(dim, spec.entity, "left")


def join_monthly(df: DataFrame, monthly: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Attach a (calendar year, month) series through the date of each row."""
    keyed = monthly.withColumnsRenamed({"year": "_cal_year", "month": "month"})
    return (
        df.withColumn("month", F.month(spec.date))
        .withColumn("_cal_year", F.year(spec.date))
        .join(keyed, ["_cal_year", "month"], "left")
        .drop("_cal_year")
    )


def derive_demographics(dim: DataFrame, digits: int | None = None) -> DataFrame:
    """Population density and the sanitation proxy."""
    from panelcast.functions.numeric import half_up

    density = F.try_divide(F.col("population").cast("double"), F.col("area_km2"))
    sanitation = F.lit(100.0) - F.col("poverty_index") * F.lit(0.6)
    if digits is not None:
        density, sanitation = half_up(density, digits), half_up(sanitation, digits)
    return dim.withColumns({"population_density_km2": density, "sanitation_index": sanitation})


def assemble_panel(
    climate: DataFrame,
    cases: DataFrame,
    demographics: DataFrame,
    monthly: DataFrame | None = None,
    spec: PanelSpec = PanelSpec(),
    incidence_digits: int | None = None,
) -> DataFrame:
    """Climate + cases + demographics + monthly index + incidence + risk."""
    panel = join_dimension(join_cases(climate, cases, spec), demographics, spec)
    if monthly is not None:
        panel = join_monthly(panel, monthly, spec)
    panel = panel.withColumn(
        "incidence_rate_100k",
        incidence(F.col("cases"), F.col("population"), incidence_digits),
    )
    return panel.withColumn(spec.target, risk_index(panel))


def with_entity_lookup(df: DataFrame, dim: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Code and coordinates of each entity, defaults for unknown ones."""
    known = dim.select(spec.entity, "province_code", "latitude", "longitude")
    return df.join(known, spec.entity, "left").withColumns(
        {
            "province_code": F.coalesce("province_code", F.lit(DEFAULT_CODE)),
            "latitude": F.coalesce("latitude", F.lit(DEFAULT_LATITUDE)),
            "longitude": F.coalesce("longitude", F.lit(DEFAULT_LONGITUDE)),
        }
    )


def map_layer(
    df: DataFrame, dim: DataFrame, risk: str, color: Column, spec: PanelSpec = PanelSpec()
) -> DataFrame:
    """Markers of the entities that have coordinates."""
    placed = dim.where(F.col("latitude").isNotNull()).select(spec.entity, "latitude", "longitude")
    return df.join(placed, spec.entity, "inner").select(
        spec.entity,
        "latitude",
        "longitude",
        risk,
        F.greatest(F.lit(10.0), F.col(risk) * F.lit(0.4)).alias("marker_size"),
        color.alias("color"),
    )


def complete_entities(
    dim: DataFrame, predictions: DataFrame, defaults: dict[str, object], spec: PanelSpec = PanelSpec()
) -> DataFrame:
    """Every entity of the dimension; those without a prediction get the empty record."""
    filled = {
        c: F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()
    }
    joined = dim.select(spec.entity).join(predictions, spec.entity, "left")
    return joined.select(*[filled.get(c, F.col(c)) for c in joined.columns])


# The record of an entity without a forecast.
EMPTY_RECORD = {
    "risk_index": 0.0, "risk_level": NO_DATA, "week_1": 0.0, "week_2": 0.0, "week_3": 0.0, "week_4": 0.0,
    "peak_risk": 0.0, "peak_week": 1, "is_epidemic": False, "is_alert": False, "trend": NO_DATA,
}


def normalize_entity(df: DataFrame, dim: DataFrame, raw: str, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Match free-text names to the dimension, ignoring case and outer blanks.

    Unmatched names get a null entity. Title-casing instead would lose names
    with a lower-case particle in the middle.
    """
    names = dim.select(
        F.col(spec.entity), F.lower(F.trim(spec.entity)).alias("_match")
    )
    return (
        df.withColumn("_match", F.lower(F.trim(raw)))
        .join(names, "_match", "left")
        .drop("_match")
    )


def lookup_entity(df: DataFrame, name: str, dim: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Rows of one entity given by free text; an unknown name is an error."""
    match = dim.where(F.lower(F.trim(spec.entity)) == name.strip().lower()).select(spec.entity)
    found = match.first()
    if found is None:
        raise LookupError(f"unknown entity: {name}")
    return df.where(F.col(spec.entity) == found[0])
