"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from recollect.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(float(r[i]), 6)) if isinstance(r[i], float) else repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    found = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(found.fetchall(), found.columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["session_sla", "subject_health", "compile_memories", "conflict_pairs", "lineage_siblings", "episode_scores"])
def test_plans_are_built_in(spark, name):
    text = plan(registry.QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "Python" not in text and "Pandas" not in text


def test_scan_reads_only_what_is_needed(spark):
    text = plan(registry.QUERIES["uncompiled_capped"](spark, DATA))
    assert "props" not in text
