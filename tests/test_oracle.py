"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from millrace import queries as core

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def canonical(v):
    if isinstance(v, float):
        return f"{v:.6g}" if not math.isnan(v) else "nan"
    return str([canonical(x) for x in v]) if isinstance(v, list) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [sorted(columns)], sorted(tuple(canonical(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, oracle, name):
    df = core.QUERIES[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in core.SQL:
        assert got[1]
        return
    cur = oracle.execute(core.SQL[name])
    assert got == rows([x[0] for x in cur.description], cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 15
