"""Every registered query against its SQL statement on the smallest generic tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from ordermill import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="generic tables are absent")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for file in sorted(os.listdir(FOLDER)):  # every table that is there, as the driver has them
        if file.endswith(".parquet"):
            connection.execute(f"create view {file.removesuffix('.parquet')} as select * from '{FOLDER}/{file}'")
    return connection


def plain(value):
    """One comparable form for the values of both engines."""
    if isinstance(value, (bool, int)):
        return int(value)
    if isinstance(value, (decimal.Decimal, float)):
        return None if math.isnan(value) else float(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, database, name):
    df = entry.queries()[name](spark, FOLDER)
    cursor = database.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = table_of(names, cursor.fetchall())
    got = table_of(df.columns, df.collect())
    assert len(got) == len(want)
    assert got == want


def test_registry():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    # of these queries only model fits have no SQL
    assert set(catalog.QUERIES) - set(entry.oracle_sql()) == {
        "model_compare", "risk_top", "feature_importance", "attribution_linear", "attribution_trees",
        "attribution_permutation"}


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["order_month", "orders", "revenue", "mom_growth_pct"]
    assert df.count() > 0
