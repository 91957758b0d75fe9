import os
import sys

import pytest
from pyspark.sql import SparkSession

_TESTS = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(_TESTS))
# the Python workers import the package and the test modules too
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(_TESTS), _TESTS, os.environ.get("PYTHONPATH", "")])

BASE = 1_735_689_600  # 2025-01-01T00:00:00Z


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """Rows with `t`, seconds after the base instant, in place of `ts`."""

    def make(schema, *values):
        return spark.createDataFrame(list(values), schema).selectExpr(
            "*", f"timestamp_micros(cast(round((t + {BASE}) * 1000000) as bigint)) AS ts"
        ).drop("t")

    return make


@pytest.fixture(scope="session")
def second():
    """A timestamp column as seconds after the base instant."""
    return lambda name: f"unix_micros({name}) / 1000000 - {BASE} AS {name}"
