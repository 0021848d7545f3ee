"""The operators that SQL can express against DuckDB."""

import duckdb
import pytest

from ravelin.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_operator(spark, data, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = queries.QUERIES[name](spark, data)
    want = db.sql(queries.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    mine = sorted(tuple(r) for r in got.select(cols).collect())
    assert mine == sorted(want.project(", ".join(cols)).fetchall())
