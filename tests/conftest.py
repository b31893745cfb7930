import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from panelcast.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session("4", "tests", "4g", spark_checkpoint_dir=shared)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def series(spark):
    """Two entities, 103 and 15 weeks, values by a rule."""
    rows = []
    for entity, weeks in (("a", 103), ("b", 15)):
        for i in range(weeks):
            rows.append((entity, i, float((i * 7) % 23), float((i * 5) % 17)))
    df = spark.createDataFrame(rows, "province string, i int, cases double, outbreak_risk_index double")
    return df.selectExpr(
        "province", "date_add(date'2020-01-06', 7 * i) as date", "cases", "outbreak_risk_index"
    ).selectExpr("*", "int(extract(yearofweek from date)) as year", "weekofyear(date) as week")
