"""The operators' queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tidewire.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda frame: sorted(map(tuple, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()), key=str)
    assert rows(got) == rows(want)
