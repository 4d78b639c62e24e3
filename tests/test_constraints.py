"""Declared constraints: each rule of the store's tables broken by itself."""

from datetime import datetime

import pytest

from tidemark.operators import constraints as C

T = datetime(2024, 1, 1)
U = datetime(2024, 2, 1)
GOOD = {
    "clients": ("client_id long, name string", [(1, "a"), (2, "a")]),
    "providers": ("provider_id long, name string", [(1, "x"), (2, "y")]),
    "accounts": ("account_id long, platform_handle string, provider_id long", [(1, "h", 1), (2, "h", 2)]),
    "ownership": ("account_id long, client_id long, valid_from timestamp, valid_to timestamp", [(1, 1, T, U), (1, 2, U, None), (2, 1, T, None)]),
    "posts": ("post_id long, account_id long, platform_post_id string, provider_id long", [(1, 1, "p", 1), (2, 2, "p", 2)]),
    "runs": ("run_id long, provider_id long, started_at timestamp, status string", [(1, 1, T, "completed"), (2, 2, T, "running")]),
    "run_accounts": ("run_id long, account_id long", [(1, 1), (2, 1)]),
    "snapshots": ("post_id long, run_id long, scraped_at timestamp, views long, likes long, comments long, shares long", [(1, 1, T, 0, 0, 0, 0), (1, 1, T, 0, 0, 0, 0)]),
}
#: rule -> table, one more row; what else that row breaks
BREAKS = {
    "clients.name": ("clients", (3, None)), "client_key": ("clients", (1, "b")), "provider_name": ("providers", (3, "x")), "provider_key": ("providers", (1, "z")),
    "handle_of_provider": ("accounts", (3, "h", 1)), "account_key": ("accounts", (1, "new", 1)), "account_provider": ("accounts", (3, "k", 9)), "accounts.provider_id": ("accounts", (3, "k", None)),
    "period_forward": ("ownership", (2, 2, U, U)), "one_open_owner": ("ownership", (2, 2, U, None)), "owned_account": ("ownership", (9, 1, T, U)), "owning_client": ("ownership", (1, 9, T, U)), "ownership.client_id": ("ownership", (1, None, T, U)),
    "post_of_provider": ("posts", (3, 1, "p", 1)), "post_key": ("posts", (1, 1, "q", 1)), "post_account": ("posts", (3, 9, "q", 1)), "post_provider": ("posts", (3, 1, "q", 9)),
    "run_status": ("runs", (3, 1, T, "done")), "run_key": ("runs", (1, 1, T, "partial")), "run_provider": ("runs", (3, 9, T, "failed")), "runs.status": ("runs", (3, 1, T, None)),
    "account_of_run": ("run_accounts", (1, 1)), "counted_run": ("run_accounts", (9, 1)), "counted_account": ("run_accounts", (1, 9)),
    "views_not_negative": ("snapshots", (1, 1, T, -1, 0, 0, 0)), "shares_not_negative": ("snapshots", (1, 1, T, 0, 0, 0, -5)), "snapshots.likes": ("snapshots", (1, 1, T, 0, None, 0, 0)),
    "snapshot_post": ("snapshots", (9, 1, T, 0, 0, 0, 0)), "snapshot_run": ("snapshots", (1, 9, T, 0, 0, 0, 0)),
}


def tables(spark, **more):
    return {t: spark.createDataFrame(rows + more.get(t, []), schema) for t, (schema, rows) in GOOD.items()}


def found(df):
    return {r.rule: r.n for r in df.collect() if r.n}


def test_good_tables_break_nothing(spark):
    got = C.violations(tables(spark)).collect()
    assert {r.n for r in got} == {0}
    assert {r.rule for r in got} >= set(BREAKS)
    C.require(tables(spark))


def test_each_rule_by_itself(spark):
    """All broken rows at once break every rule of theirs once, and nothing more."""
    more = {}
    for t, row in BREAKS.values():
        more.setdefault(t, []).append(row)
    # rows that need an own key, so that only their rule is broken
    got = found(C.violations(tables(spark, **more)))
    assert set(BREAKS) <= set(got)
    for rule in ("period_forward", "owning_client", "views_not_negative", "one_open_owner"):
        t, row = BREAKS[rule]
        assert found(C.violations(tables(spark, **{t: [row]}))) == {rule: 1}
    t, row = BREAKS["snapshot_post"]
    with pytest.raises(C.BrokenConstraint, match="^snapshot_post: 1$"):
        C.require(tables(spark, **{t: [row]}))


def test_nulls_repeats_and_missing_tables(spark):
    some = tables(spark, posts=[(None, None, None, None)] * 2, snapshots=[(9, 1, T, 0, 0, 0, 0)] * 3 + [(None, 1, T, None, 0, 0, 0)])
    got = found(C.violations(some))
    assert got == {"posts.post_id": 2, "posts.account_id": 2, "posts.platform_post_id": 2, "posts.provider_id": 2, "snapshot_post": 3, "snapshots.post_id": 1, "snapshots.views": 1}
    alone = C.violations({"snapshots": some["snapshots"]})
    assert "snapshot_post" not in {r.rule for r in alone.collect()}


def test_empty_tables(spark):
    none = {t: df.limit(0) for t, df in tables(spark).items()}
    assert {r.n for r in C.violations(none).collect()} == {0}


def test_one_scan_a_table_and_one_shuffle_by_key(spark, tmp_path):
    read = {}
    for t, df in tables(spark).items():
        df.write.parquet(str(tmp_path / t))
        read[t] = spark.read.parquet(str(tmp_path / t))
    plan = C.violations(read)._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("== Initial Plan ==")[-1]
    assert initial.count("FileScan parquet") == len(read)
    assert initial.count("Exchange hashpartitioning") == 1


def test_own_rules(spark):
    rules = {"t": C.Rules(("a",), {"small": "a < 10"}, {"pair": C.Unique(("a", "b"), "a > 1")}, {"self": C.Reference(("b",), "t", ("a",))})}
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 1), (20, 5), (None, 2)], "a long, b long")
    assert found(C.violations({"t": df}, rules)) == {"t.a": 1, "small": 1, "pair": 1, "self": 1}


def test_a_key_costs_a_count_for_each_reference_to_it(spark):
    """Three tables name accounts by their key: four counts a key, however many rules there are."""
    plan = C.violations(tables(spark))._jdf.queryExecution().optimizedPlan().toString()
    per_key = next(line for line in plan.split("\n") if "Aggregate [space" in line)
    assert per_key.count("count(") + per_key.count("sum(") == 4


def test_keys_of_two_columns_never_look_alike(spark):
    rules = {"t": C.Rules(unique={"pair": C.Unique(("a", "b"))})}
    rows = [("1:x", "y"), ("1", "x:y"), ("", "1:xy"), ("x", "1:y"), ("1:x1", ":y"), ("é", "b"), (None, "b"), (None, "b")]
    assert found(C.violations({"t": spark.createDataFrame(rows, "a string, b string")}, rules)) == {}
    assert found(C.violations({"t": spark.createDataFrame(rows + [("é", "b"), ("é", "b")], "a string, b string")}, rules)) == {"pair": 1}
