"""Every registered query against its SQL counterpart in DuckDB, on whole tables."""

import os
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

#: Operators for training data have tests of their own, where SQL is not up to them.
ORACLES = entry.oracle_sql()
QUERIES = {
    name: query for name, query in entry.queries().items()
    if name in ORACLES or not re.match(r"op\d+_|pipeline$", name)
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([row[i] for i in order]) for row in rows)


def test_every_query_has_a_counterpart():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF_DIR)
    wanted = duck.execute(ORACLES[name])
    columns = [d[0] for d in wanted.description]
    assert _sorted_rows(found.columns, map(tuple, found.collect())) == _sorted_rows(
        columns, wanted.fetchall()
    )


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["doc_id", "url", "title", "snippet"]
    ids = [row["doc_id"] for row in found.collect()]
    assert len(ids) == 31 and ids == sorted(ids)
