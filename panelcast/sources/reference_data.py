"""Built-in entity dimension, used where no demographics file has landed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The entity domain in order (the code is the position), with
# population, area in km2, urban share and poverty index, latitude, longitude.
ENTITIES = (
    ("Azua", 210000, 2532, 44.5, 48.3, 18.45, -70.73),
    ("Bahoruco", 93000, 1282, 35.6, 62.8, 18.48, -71.42),
    ("Barahona", 179000, 1739, 47.8, 46.1, 18.20, -71.10),
    ("Dajabón", 63000, 1021, 42.1, 58.4, 19.55, -71.71),
    ("Duarte", 293000, 1605, 51.2, 38.4, 19.20, -70.02),
    ("Elías Piña", 63000, 1426, 30.2, 70.4, 18.88, -71.70),
    ("El Seibo", 89000, 1786, 36.4, 52.1, 18.77, -69.05),
    ("Espaillat", 232000, 839, 48.7, 41.2, 19.62, -70.28),
    ("Hato Mayor", 88000, 1329, 39.8, 47.2, 18.77, -69.25),
    ("Hermanas Mirabal", 94000, 427, 47.3, 42.1, 19.35, -70.05),
    ("Independencia", 52000, 2006, 32.1, 67.3, 18.52, -71.85),
    ("La Altagracia", 338000, 3010, 55.8, 27.3, 18.62, -68.72),
    ("La Romana", 282000, 654, 75.2, 24.1, 18.43, -68.97),
    ("La Vega", 395000, 2286, 58.3, 33.8, 19.22, -70.53),
    ("María Trinidad Sánchez", 135000, 1272, 44.9, 43.8, 19.47, -69.98),
    ("Monseñor Nouel", 168000, 992, 50.4, 36.5, 18.92, -70.38),
    ("Monte Cristi", 109000, 1924, 40.3, 55.2, 19.87, -71.65),
    ("Monte Plata", 184000, 2602, 31.2, 54.7, 18.80, -69.78),
    ("Pedernales", 32000, 2075, 38.9, 65.1, 18.04, -71.75),
    ("Peravia", 188000, 792, 46.3, 37.9, 18.28, -70.33),
    ("Puerto Plata", 339000, 1853, 53.4, 35.6, 19.80, -70.68),
    ("Samaná", 100000, 854, 42.6, 44.3, 19.20, -69.33),
    ("San Cristóbal", 661000, 1265, 65.4, 31.2, 18.42, -70.12),
    ("San José de Ocoa", 63000, 853, 35.4, 55.6, 18.55, -70.50),
    ("San Juan", 244000, 3569, 43.1, 49.8, 18.81, -71.23),
    ("San Pedro de Macorís", 333000, 1254, 62.7, 29.5, 18.46, -69.30),
    ("Sánchez Ramírez", 151000, 1196, 43.2, 44.7, 19.05, -70.15),
    ("Santiago", 1100000, 2836, 72.1, 28.6, 19.45, -70.70),
    ("Santiago Rodríguez", 59000, 1112, 33.7, 61.3, 19.47, -71.35),
    ("Santo Domingo", 2374000, 1296, 95.3, 22.4, 18.45, -69.97),
    ("Valverde", 158000, 823, 51.8, 38.7, 19.57, -71.07),
    ("Distrito Nacional", 1078000, 91, 99.5, 18.2, 18.48, -69.90),
)

# Abbreviations of long entity names.
SHORT_NAMES = {
    "San Pedro de Macorís": "S.P. Macorís",
    "María Trinidad Sánchez": "M.T. Sánchez",
    "Santiago Rodríguez": "Stgo. Rodríguez",
    "Hermanas Mirabal": "H. Mirabal",
}


def entity_dimension(spark: SparkSession) -> DataFrame:
    """province, province_code, population .. longitude."""
    rows = [(i, *entity) for i, entity in enumerate(ENTITIES, 1)]
    dim = spark.createDataFrame(
        rows,
        "i int, province string, population bigint, area_km2 int, urban_pct double, "
        "poverty_index double, latitude double, longitude double",
    )
    return dim.withColumn("province_code", F.format_string("RD%02d", "i")).drop("i")
