"""Every query of the package that has SQL gives DuckDB's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from millrace.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, oracle, name):
    frame = queries.QUERIES[name](spark, DATA)
    names = sorted(frame.columns)
    cur = oracle.execute(f"select {', '.join(names)} from ({queries.SQL[name]})")
    want = sorted(map(tuple, cur.fetchall()), key=str)
    assert sorted((tuple(r) for r in frame.select(*names).collect()), key=str) == want and want
