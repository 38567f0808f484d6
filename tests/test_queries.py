"""Every registered query against its independent SQL on the smallest tables."""

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry
from tokenloom.plans.catalog import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float):
            return round(v, 6)
        return v

    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    assert _rows(got.columns, got.collect()) == _rows(columns, cursor.fetchall())


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["source", "rows", "tokens"]
    assert out.count() > 0
