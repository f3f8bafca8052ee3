"""The corpus queries that have SQL, against it, on the smallest tables."""

import os

import duckdb
import pytest

from recollect.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    df, found = QUERIES[name](spark, DATA), con.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)

    def rows(values, names):
        order = [names.index(c) for c in columns]
        return sorted(tuple(repr(round(float(r[i]), 6)) if isinstance(r[i], float) else repr(r[i]) for i in order) for r in values)

    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(found.fetchall(), list(found.columns))


def test_all_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(QUERIES) | {"pipeline"} <= names and {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
