"""Every registered query against its DuckDB statement on the smallest tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as driver
from radiokpi.plans.registry import ALL

DIRECTORY = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events").split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{DIRECTORY}/{table}.parquet'")
    return connection


def bag(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(str(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, duck, name):
    frame = driver.queries()[name](spark, DIRECTORY)
    rows = [tuple(r) for r in frame.collect()]
    statement = ALL[name].statement()
    if statement is None:
        assert rows
        return
    result = duck.execute(statement)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert bag(frame.columns, rows) == bag(names, result.fetchall())


def test_stream_dedupe_counts_every_file(spark):
    """The query SQL has no twin for: its statuses add up to those of the batch summary."""
    batch = ALL["ingest_summary"].run(spark, DIRECTORY).groupBy("status").count().collect()
    stream = ALL["stream_dedupe"].run(spark, DIRECTORY).collect()
    assert sum(r.files for r in stream) == sum(r["count"] for r in batch)


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
