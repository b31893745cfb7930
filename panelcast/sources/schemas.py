"""Explicit schemas of the landed files."""

from __future__ import annotations

CASES = "province string, week int, cases bigint, deaths bigint, severe_cases bigint"

CLIMATE = (
    "date date, rainfall_mm double, temp_max_c double, temp_min_c double, "
    "temp_avg_c double, humidity_pct double, wind_speed_kmh double"
)

DEMOGRAPHICS = (
    "province string, population bigint, area_km2 int, urban_pct double, poverty_index double"
)

PANEL = (
    "province string, date date, year int, week int, month int, "
    "rainfall_mm double, temp_max_c double, temp_min_c double, temp_avg_c double, "
    "humidity_pct double, wind_speed_kmh double, enso_index double, "
    "cases bigint, deaths bigint, incidence_rate_100k double, "
    "population bigint, area_km2 int, urban_pct double, poverty_index double, "
    "population_density_km2 double, sanitation_index double, outbreak_risk_index double"
)

UPLOAD = (
    "province string, year int, week int, cases bigint, deaths bigint, "
    "rainfall_mm double, temp_avg_c double, humidity_pct double"
)
