"""Every query that SQL can express gives the rows DuckDB gives, on the smallest tables."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tools.compare import alike, rows_of

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(pathlib.Path(SMALL).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert all(alike(f.dataType.simpleString(), types[f.name]) for f in df.schema.fields)
    assert rows_of(df.columns, df.collect()) == rows_of(names, want)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 5
