import pytest

from tracemark.session import build_session
from tracemark.sources.views import Tables


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", app="tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark, "/root/testdata/sf0.001")
