"""Every registered query against its SQL on the smallest sample."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as driver

SAMPLE = os.environ.get("SAMPLE_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SAMPLE), reason="no sample tables")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for file in os.listdir(SAMPLE):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SAMPLE}/{file}'")
    yield connection
    connection.close()


def comparable(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return repr(value)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_equals_its_sql(spark, sql, name):
    df = driver.queries()[name](spark, SAMPLE)
    names = sorted(df.columns)
    cursor = sql.execute(driver.oracle_sql()[name])
    sql_names = [column[0] for column in cursor.description]
    assert sorted(sql_names) == names
    places = [sql_names.index(n) for n in names]
    expected = sorted(tuple(comparable(row[i]) for i in places) for row in cursor.fetchall())
    assert sorted(tuple(comparable(row[n]) for n in names) for row in df.collect()) == expected


def test_flagship_has_rows(spark):
    assert driver.entry(spark).count() > 0
