"""Periods by time: merged joins, overlaps, many changes of owners at once."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, metrics, ownership, reconcile

T0 = datetime(2024, 1, 1)
HISTORY = "account_id long, client_id long, valid_from timestamp_ntz, valid_to timestamp_ntz"
hour = lambda n: None if n is None else T0 + timedelta(hours=n)


def periods(spark, rows):
    return spark.createDataFrame([(a, c, hour(s), hour(e)) for a, c, s, e in rows], HISTORY)


def posts(spark, rows):
    return spark.createDataFrame([(i, a, hour(h)) for i, a, h in rows], "post_id long, account_id long, published_at timestamp_ntz")


def covering(rows, spans):
    """(post, client) by a loop."""
    return sorted((i, c) for i, a, h in rows for b, c, s, e in spans if a is not None and a == b and None not in (h, s) and s <= h and (e is None or h < e))


@pytest.fixture
def history():
    """Gaps, backward, empty and null periods, equal rows, and one account whose periods overlap."""
    r = random.Random(4)
    spans = [(a, 10 * a + i, 10 * i + r.randint(0, 4), 10 * i + r.randint(5, 10)) for a in range(1, 6) for i in range(30)]
    spans += [(6, 600 + i, r.randint(0, 200), r.choice([None, r.randint(100, 300)])) for i in range(40)]
    spans += [(1, 900, 50, 20), (2, 901, 60, 60), (3, 902, None, 70), (None, 903, 0, None), (5, 904, 400, None), (4, 905, 350, 360), (7, 906, 0, None)]
    rows = [(i, r.choice([1, 1, 1, 2, 3, 4, 5, 6, 7, 8]), r.randint(0, 420)) for i in range(400)]
    rows += [(500, None, 5), (501, 1, None), (0, rows[0][1], rows[0][2])]
    return rows, spans


@pytest.mark.parametrize("few", [0, 35, 1000])
def test_all_ways_give_the_same_rows(spark, history, few):
    rows, spans = history
    got = asof.holding(posts(spark, rows), periods(spark, spans), "account_id", "published_at", few=few)
    assert sorted((r.post_id, r.client_id) for r in got.collect()) == covering(rows, spans)
    kept = asof.holding(posts(spark, rows), periods(spark, spans), "account_id", "published_at", "left", few=few)
    met = {i for i, _ in covering(rows, spans)}
    lone = [(i, None) for i, *_ in rows if i not in met]
    assert sorted(((r.post_id, r.client_id) for r in kept.collect()), key=repr) == sorted(covering(rows, spans) + lone, key=repr)


def test_account_of_a_hundred_thousand_periods(spark):
    n = 100_000
    at = lambda c: (F.lit(T0).cast("timestamp_ntz") + F.make_interval(mins=c.cast("int")))
    spans = spark.range(n).select(F.lit(1).cast("long").alias("account_id"), F.col("id").alias("client_id"), at(F.col("id") * 10).alias("valid_from"), at(F.col("id") * 10 + 9).alias("valid_to"))
    rows = spark.range(n).select(F.col("id").alias("post_id"), F.lit(1).cast("long").alias("account_id"), at(F.col("id") * 7).alias("published_at"))
    got = metrics.owned(rows, spans)
    right = got.agg(F.count("*"), F.count_if(F.floor(F.col("post_id") * 7 / 10) == F.col("client_id"))).first()
    want = sum(1 for i in range(n) if i * 7 % 10 < 9)
    assert tuple(right) == (want, want)


def test_first_owner_of_long_histories(spark, history, monkeypatch):
    rows, spans = history
    spans = [s for s in spans if s[0] != 6]
    a = spark.createDataFrame([(x[0], i, f"c{x[1]}", hour(x[2]), hour(x[3])) for i, x in enumerate(spans)], "account_id long, ord long, client string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    plain = {tuple(r) for r in metrics.first_owner(posts(spark, rows), a).collect()}
    monkeypatch.setattr(asof.holding, "__defaults__", ("inner", 3))
    assert {tuple(r) for r in metrics.first_owner(posts(spark, rows), a).collect()} == plain and len(plain) > 300


def test_nothing_to_join(spark):
    none = posts(spark, [])
    for few in (0, 64):
        assert asof.holding(none, periods(spark, [(1, 1, 0, None)]), "account_id", "published_at", few=few).collect() == []
        assert asof.holding(posts(spark, [(1, 1, 1)]), periods(spark, []), "account_id", "published_at", few=few).collect() == []


def test_overlaps(spark):
    spans = [(1, 1, 0, 10), (1, 2, 10, 20), (1, 3, 15, 16), (1, 4, 18, None), (1, 5, 30, 40), (2, 6, 0, None), (2, 6, 0, None), (3, 7, 5, 4), (3, 8, 4, 5), (4, 9, 0, 100), (4, 10, 1, 2), (4, 11, 50, 60)]
    got = {(r.account_id, r.client_id): r.until for r in asof.overlapping(periods(spark, spans)).collect()}
    end = datetime(9999, 12, 31, 23, 59, 59, 999999)
    assert got == {(1, 3): hour(20), (1, 4): hour(20), (1, 5): end, (2, 6): end, (4, 10): hour(100), (4, 11): hour(100)}


def test_overlaps_of_one_key_across_partitions(spark):
    r = random.Random(9)
    spans = [(r.choice([1, 1, 1, 2]), i, s := r.randint(0, 5000), s + r.randint(1, 6)) for i in range(3000)]
    want = set()
    for a in (1, 2):
        latest = -1
        for _, c, s, e in sorted((x for x in spans if x[0] == a), key=lambda x: (x[2], x[3], x[1])):
            want |= {c} if s < latest else set()
            latest = max(latest, e)
    assert {x.client_id for x in asof.overlapping(periods(spark, spans)).collect()} == want


def merged(spark, history, changes):
    before = periods(spark, history)
    timeline, refused = ownership.merged(before, spark.createDataFrame([(a, c, hour(h)) for a, c, h in changes], "account_id long, client_id long, at timestamp_ntz"))
    assert ownership.broken_history(before, timeline).collect() == []
    back = lambda t: None if t is None else int((t - T0).total_seconds() // 3600)
    return sorted(((r.account_id, r.client_id, back(r.valid_from), back(r.valid_to)) for r in timeline.collect()), key=repr), sorted(((r.account_id, r.client_id, back(r["at"]), r.reason, r.n) for r in refused.collect()), key=repr)


def test_many_changes_at_once(spark):
    history = [(1, 7, 0, 10), (1, 8, 10, None), (2, 7, 0, None), (3, 7, 0, 10)]
    changes = [(1, 9, 30), (1, 5, 20), (1, 5, 20), (1, 8, 5), (1, 3, 10), (2, 1, 40), (2, 2, 40), (2, 7, 50), (3, 4, 5), (3, 7, 10), (4, 6, 1), (4, 6, 2), (4, 5, 3), (4, 6, 4), (None, 1, 1), (5, None, 3), (5, 1, None)]
    timeline, refused = merged(spark, history, changes)
    assert timeline == sorted([(1, 7, 0, 10), (1, 8, 10, 20), (1, 5, 20, 30), (1, 9, 30, None), (2, 7, 0, None), (3, 7, 0, 10), (3, 7, 10, None), (4, 6, 1, 3), (4, 5, 3, 4), (4, 6, 4, None)], key=repr)
    assert refused == sorted([(1, 5, 20, "repeated", 1), (1, 8, 5, "late", 1), (1, 3, 10, "late", 1), (2, 1, 40, "contradictory", 1), (2, 2, 40, "contradictory", 1), (2, 7, 50, "unchanged", 1), (3, 4, 5, "late", 1), (4, 6, 2, "unchanged", 1), (None, 1, 1, "incomplete", 1), (5, None, 3, "incomplete", 1), (5, 1, None, "incomplete", 1)], key=repr)


def test_merged_changes_leave_no_overlap_and_one_open_period(spark):
    r = random.Random(6)
    history = [(a, r.randint(1, 3), 0, None) for a in range(20)]
    timeline, refused = merged(spark, history, [(r.randint(0, 25), r.randint(1, 3), r.randint(0, 30)) for _ in range(400)])
    frame = periods(spark, timeline)
    assert asof.overlapping(frame).isEmpty()
    assert frame.where("valid_to is null").groupBy("account_id").count().where("count > 1").isEmpty()
    assert {x[3] for x in refused} == {"late", "contradictory", "repeated", "unchanged"}


def test_broken_history(spark):
    before = periods(spark, [(1, 1, 0, 5), (1, 2, 5, None), (2, 1, 0, 5), (2, 1, 0, 5), (3, 1, 0, None)])
    after = periods(spark, [(1, 1, 0, 6), (1, 2, 5, 9), (2, 1, 0, 5), (3, 2, 0, None)])
    got = sorted((r.account_id, r.client_id, r.rule) for r in ownership.broken_history(before, after).collect())
    assert got == [(1, 1, "closed_period_altered"), (2, 1, "closed_period_altered"), (3, 1, "open_period_lost")]


def test_share_groups_are_components(spark):
    """Ids reached from two accounts tie rows of both; nothing else does."""
    row = lambda o, account, id_: ("A", o, account, id_)
    rows = [row(0, "@a", "1"), row(1, "@b", "1"), row(1, "@b", "2"), row(2, "@a", "2"), row(3, "@a", "3"), row(3, "@a", "4"), row(4, "@c", "5"), ("B", 4, "@c", "5"), row(5, "@c", "6"), row(6, "@c", "7"), row(6, "@c", "7")]
    found = spark.createDataFrame(rows, "share_vendor string, share_ord long, account string, candidate string")
    grp = {}
    for r in reconcile.walk_groups(found).collect():
        grp.setdefault(r.grp, set()).add((r.share_vendor, r.share_ord))
    assert sorted(map(sorted, grp.values())) == [[("A", 0), ("A", 1), ("A", 2)], [("A", 4), ("B", 4)]]


def test_one_id_that_all_rows_reach_for(spark):
    url = "https://www.tiktok.com/@x/video/{}"
    rows = [("A", i, None, "vm.tiktok.com/s", 1, 1, 1, "same", "2024-01-01 00:00:00", f"@a{i % 50}") for i in range(2000)]
    rows += [("B", i, "1" if i < 50 else str(i), url.format(i), 1, 1, 1, "same", "2024-01-01 00:10:00", f"@a{i % 50}") for i in range(0, 51)]
    schema = "vendor string, ord long, id string, url string, views long, likes long, comments long, caption string, at string, account string"
    df = spark.createDataFrame(rows, schema).withColumn("posted_at", F.col("at").cast("timestamp")).drop("at")
    # account 0 also has id 50, so its rows see two free ids until the first row of account 1 has taken id 1
    got = {(r.share_ord, r.candidate) for r in reconcile.matches(reconcile.classified(df)).collect()}
    assert got == {(1, "1"), (50, "50")}
