"""Every query that has SQL gives the same rows as DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools_oracle import table

SF = "/root/testdata/sf0.001"
SQL = {k: v for m in entry._modules() if "llm" not in m.__name__ for k, v in m.SQL.items()}
QUERIES = {k: v for m in entry._modules() if "llm" not in m.__name__ for k, v in m.QUERIES.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    r = duck.execute(SQL[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert table(df.columns, df.collect()) == table(cols, r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
