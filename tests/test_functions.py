import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelcast.functions import labels as L
from panelcast.functions import risk as R
from panelcast.functions import temporal as T
from panelcast.functions.numeric import clamp, half_up, nan_to_null
from panelcast.operators.forecast import check_weights


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    "risk, label",
    [
        (10, "Bajo"), (35, "Moderado"), (55, "Alto"), (70, "Epidemia"), (90, "Critico"), (0, "Bajo"),
        (25, "Moderado"), (100, "Critico"), (24.999, "Bajo"), (50, "Alto"), (65, "Epidemia"), (80, "Critico"),
    ],
)
def test_risk_class(spark, risk, label):
    assert one(spark, R.risk_class(F.lit(float(risk))))[0] == label


def test_risk_class_of_null_is_null(spark):
    assert one(spark, R.risk_class(F.lit(None).cast("double")))[0] is None


@pytest.mark.parametrize(
    "values, label",
    [
        ([30, 40, 55, 70], "Ascendente"), ([70, 55, 40, 30], "Descendente"),
        ([45, 46, 44, 45], "Estable"), ([45], "Estable"),
    ],
)
def test_trend(spark, values, label):
    assert one(spark, R.trend_label([F.lit(float(v)) for v in values]))[0] == label


def test_weights():
    check_weights({"rf": 0.6, "mlp": 0.4})
    with pytest.raises(ValueError):
        check_weights({"rf": 0.7, "mlp": 0.5})


def test_week_dates(spark):
    week, iso = T.week_to_date(F.lit(2024), F.lit(1)), T.iso_week_to_date(F.lit(2025), F.lit(2))
    assert one(spark, week)[0] == dt.date(2024, 1, 1)
    assert one(spark, T.week_to_date(F.lit(2025), F.lit(2)))[0] == dt.date(2025, 1, 13)
    assert one(spark, iso)[0] == dt.date(2025, 1, 6)


def test_week_dates_equal_the_calendar(spark):
    rows = spark.range(1990, 2041).select(F.col("id").cast("int").alias("y")).crossJoin(
        spark.range(1, 53).select(F.col("id").cast("int").alias("w"))
    )
    for r in rows.select("y", "w", T.week_to_date(F.col("y"), F.col("w")).alias("d")).collect():
        assert r.d == dt.datetime.strptime(f"{r.y}-W{r.w:02d}-1", "%Y-W%W-%w").date()


def test_iso_week(spark):
    d = F.lit("2024-12-30").cast("date")
    assert tuple(one(spark, T.iso_year(d), T.iso_week(d))) == (2025, 1)


def test_forecast_date(spark):
    assert one(spark, T.forecast_date(F.lit("2024-01-01").cast("date"), F.lit(4)))[0] == dt.date(2024, 1, 29)


def test_rounding_and_limits(spark):
    assert one(spark, half_up(F.lit(1.005), 2))[0] == 1.01
    assert one(spark, half_up(F.lit(-2.5), 0))[0] == -2.0
    assert one(spark, half_up(F.lit(1e12 + 0.25), 1), half_up(F.lit(1e16), 4), half_up(F.lit(-3e300), 2)) == (
        1e12 + 0.3, 1e16, -3e300
    )
    nan, inf, null = one(spark, half_up(F.lit(float("nan")), 2), half_up(F.lit(float("inf")), 2), half_up(F.lit(None), 2))
    assert nan != nan and inf == float("inf") and null is None
    assert one(spark, clamp(F.lit(None).cast("double"), 0.0, 1.0))[0] is None
    assert one(spark, clamp(F.lit(7.0), 0.0, 1.0))[0] == 1.0
    assert one(spark, nan_to_null(F.lit(float("nan"))))[0] is None


def test_risk_index_bounds_and_missing_columns(spark):
    high = spark.createDataFrame(
        [(500.0, 900.0, 50.0, 100.0, 100.0), (0.0, 0.0, 0.0, 0.0, 0.0)],
        "incidence_rate_100k double, rainfall_mm double, temp_avg_c double, humidity_pct double, poverty_index double",
    )
    assert [r[0] for r in high.select(R.risk_index(high)).collect()] == [100.0, 0.0]
    fewer = high.select("rainfall_mm")
    assert [r[0] for r in fewer.select(R.risk_index(fewer)).collect()] == [25.0, 0.0]


def test_incidence(spark):
    i = lambda c, p: one(spark, R.incidence(F.lit(c).cast("long"), F.lit(p).cast("long")))[0]
    assert i(5, 100000) == 5.0
    assert i(5, 0) == 0.0
    assert i(None, 10) == 0.0


def test_labels(spark):
    level = F.lit("Critico")
    assert one(spark, L.color(level))[0] == "#6f0000"
    assert one(spark, L.color(F.lit("x")))[0] == "#6c757d"
    assert one(spark, L.emoji(F.lit("x")))[0] == "⚪"
    assert one(spark, L.badge(F.lit(81.26), level))[0] == (
        '<span style="background:#6f0000;color:white;padding:2px 8px;border-radius:4px;">Crítico (81.3)</span>'
    )
    number = lambda n: one(spark, L.short_number(F.lit(n)))[0]
    assert (number(2374000), number(1500), number(12)) == ("2.4M", "1.5K", "12.0")
    assert one(spark, L.short_name(F.lit("San Pedro de Macorís")))[0] == "S.P. Macorís"
    assert one(spark, L.first_token(F.lit(" Monte Plata")))[0] == "Monte"
