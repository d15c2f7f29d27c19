"""Text queries that SQL can express agree with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from terralith.llm import queries

DATA = "/root/testdata/sf0.001"


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "conversations"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    frame = queries.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted(tuple(map(plain, r)) for r in frame.select(*columns).collect())
    found = con.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns and got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
