"""Every query against its SQL in DuckDB: rows, names and values."""

import duckdb
import pytest

from ravelin import queries, surface

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


QUERIES, ORACLES = queries.QUERIES | surface.QUERIES, queries.ORACLES | surface.ORACLES


@pytest.fixture(scope="module")
def db(data):
    made = duckdb.connect()
    for t in TABLES:
        made.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return made


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, data, db, name):
    got = QUERIES[name](spark, data)
    want = db.sql(ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    mine = sorted((tuple(r) for r in got.select(cols).collect()), key=key)
    theirs = sorted(want.project(", ".join(f'"{c}"' for c in cols)).fetchall(), key=key)
    assert len(mine) == len(theirs)
    assert mine == theirs


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
