"""Streams that are restarted: windows with late rows, and failure streaks kept as state."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import health
from tidemark.streaming import monitor, replay

T0 = datetime(2024, 1, 1)
EVENT = "account_id long, ord long, ts timestamp, failed boolean, clear boolean, part int"
at = lambda h: T0 + timedelta(hours=h)


def looped(events, quiet):
    """(ord, streak, flagged, skipped) of each job, and the last state of each account."""
    out, state = [], {}
    for a, o, ts, failed, clear, _ in sorted(events, key=lambda e: (e[0], e[1], not e[4])):
        run, flagged, seen = state.get(a, (0, False, None))
        if seen is not None and ts - seen > quiet:
            run = 0
        if clear:
            state[a] = (0, False, ts)
            continue
        skipped, run = flagged, run + 1 if failed else 0
        flagged = flagged or run >= health.STREAK
        state[a] = (run, flagged, ts)
        out.append((a, o, failed, run, flagged, skipped))
    return sorted(out), state


@pytest.fixture
def events():
    r, hours, rows = random.Random(8), 0.0, []
    for o in range(400):
        hours += r.choice([0.1, 0.5, 1, 3])
        rows.append((r.randint(1, 12), o, at(hours), r.random() < 0.7, r.random() < 0.08, o // 100))
    # an unflag and a job of one ord, and an account that is quiet for long
    rows += [(20, 401, at(hours), True, False, 3), (20, 401, at(hours), False, True, 3), (21, 0, at(0), True, False, 0), (21, 402, at(hours), True, False, 3)]
    return rows


def test_watch_equals_a_loop(spark, events):
    quiet = timedelta(hours=20)
    want, _ = looped(events, quiet)
    again = [(*e[:5], e[5] + 1) for e in events if e[1] % 100 > 95 and e[5] < 3]
    monitor.with_rocksdb(spark)
    df = spark.createDataFrame(events + again, EVENT)
    got = replay.replayed(df, F.col("part"), 4, lambda rows: monitor.watched(rows, None, "20 hours", "30 days"))
    assert sorted(map(tuple, got.collect())) == want
    assert any(f for *_, f, _ in want) and any(s for *_, s in want)


def test_watch_goes_on_from_a_table(spark, events):
    quiet = timedelta(hours=20)
    first = [e for e in events if e[5] == 0]
    before = health.last_states(spark.createDataFrame(first, EVENT), "20 hours")
    _, state = looped(first, quiet)
    assert {r.account_id: (r.run, r.flagged, r.seen) for r in before.collect()} == state
    rest = spark.createDataFrame([e for e in events if e[5] > 0], EVENT)
    monitor.with_rocksdb(spark)
    got = replay.replayed(rest, F.col("part") - 1, 3, lambda rows: monitor.watched(rows, before, "20 hours", "30 days"))
    done = {(e[0], e[1]) for e in first}
    assert sorted(map(tuple, got.collect())) == [w for w in looped(events, quiet)[0] if w[:2] not in done]


def test_quiet_accounts_are_forgotten_and_flagged_ones_kept(spark, tmp_path):
    """The timers run by the watermark: what is left in the state store are the flagged accounts."""
    rows = [(1, 0, at(0), True, False, 0), (2, 1, at(0), True, False, 0), (2, 2, at(0.1), True, False, 0), (2, 3, at(0.2), True, False, 0), (3, 4, at(200), True, False, 1), (3, 5, at(300), True, False, 2)]
    monitor.with_rocksdb(spark)
    folder = str(tmp_path)
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[5] == part], EVENT).write.mode("append").parquet(f"{folder}/in")
        stream = monitor.watched(spark.readStream.schema(EVENT).parquet(f"{folder}/in"), None, "10 hours", "1 hour")
        monitor.drained(stream, f"{folder}/out", f"{folder}/checkpoint")
    state = spark.read.format("statestore").option("stateVarName", "now").load(f"{folder}/checkpoint")
    assert {r.key.account_id for r in state.select("key").collect()} == {2, 3}
    assert {(r.account_id, r.ord, r.consecutive_failures) for r in spark.read.parquet(f"{folder}/out").collect()} == {(1, 0, 1), (2, 1, 1), (2, 2, 2), (2, 3, 3), (3, 4, 1), (3, 5, 1)}


def test_windows_lose_only_what_is_late(spark):
    """An hour's watermark: the row of part 1 for the first window comes in time, that of part 2 doesn't."""
    rows = [(at(0.5), "a", 0), (at(1.2), "a", 0), (at(0.6), "a", 1), (at(5.5), "a", 1), (at(0.7), "a", 2), (at(5.6), "a", 2), (at(0.8), "b", 2), (at(9.0), "a", 2)]
    df = spark.createDataFrame([(t, e, 1.0, p) for t, e, p in rows], "ts timestamp, event_type string, value double, part int")
    counted = lambda d: monitor.windowed_counts(d, "1 hour", None, "1 hour")
    closed = replay.replayed(df, F.col("part"), 3, counted)
    out = replay.with_lost(closed, counted(df), ["start", "end", "event_type"], F.lit(at(8.0)).cast("timestamp"))
    got = {(int((r.start - T0).total_seconds() // 3600), r.event_type): (r.n, r.lost) for r in out.collect()}
    assert got == {(0, "a"): (2, 1), (1, "a"): (1, 0), (5, "a"): (2, 0), (0, "b"): (0, 1)}


def test_empty_streams(spark):
    none = spark.createDataFrame([], EVENT)
    monitor.with_rocksdb(spark)
    assert replay.replayed(none, F.col("part"), 2, lambda rows: monitor.watched(rows)).collect() == []
    assert health.last_states(none, "1 day").collect() == []


def test_state_is_read_and_written_once_a_batch():
    """However many events an account has in a batch, its state is one read and one write."""
    from collections import Counter
    from types import SimpleNamespace

    calls, held = Counter(), {}

    class Value:
        def exists(self):
            calls["read"] += 1
            return "now" in held

        def get(self):
            calls["read"] += 1
            return held.get("now")

        def update(self, v):
            calls["write"] += 1
            held["now"] = v

    handle = SimpleNamespace(getValueState=lambda *_: Value(), registerTimer=lambda _: calls.update(["timer"]), deleteTimer=lambda _: calls.update(["timer"]))
    watch = monitor.FailureWatch(health.STREAK, 10_000)
    watch.init(handle)
    row = lambda o: SimpleNamespace(ord=o, clear=False, failed=o % 5 > 0, ms=o * 100)
    first = list(watch.handleInputRows((1,), map(row, range(301)), None))
    assert len(first) == 301 and calls["read"] <= 1 and calls["write"] == 1
    # those within quiet of the last event are known when they come again
    assert [r.ord for r in watch.handleInputRows((1,), map(row, range(200, 310)), None)] == list(range(301, 310))
