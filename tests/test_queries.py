"""Every query with SQL against DuckDB over the smallest tables."""

import os

import duckdb
import pytest

from tidemark.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def shown(row):
    return tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in row)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, FOLDER)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    expected = want.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(shown, got.select(columns).collect())) == sorted(map(shown, expected))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_tasks_of_runs_grow_with_the_snapshots(spark, monkeypatch):
    from tidemark.sources import bindings

    monkeypatch.setattr(bindings, "TASK_ROWS", 500)
    t = bindings.Tables(spark, FOLDER)
    n = -(-t.raw("lineitem").count() // 500)
    assert n > 10
    assert t.run_snapshots().rdd.getNumPartitions() == n
    health = registry.queries()["q4_health"](spark, FOLDER)
    assert health.rdd.getNumPartitions() == n
    # by account once, however its rows are grouped, counted along the months and named
    plan = health._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning(account_id") <= 2 and "hashpartitioning(run_id" not in plan.split("BroadcastExchange")[0]
