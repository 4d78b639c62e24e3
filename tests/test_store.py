"""The store's event log, batches of streams, and its maintained view."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import constraints, metrics, store, versions

SNAPSHOT = "post_id long, views long, likes long, comments long, shares long"


def snapshots(spark, rows):
    return spark.createDataFrame([(p, v, v % 7, v % 5, v % 3) for p, v in rows], SNAPSHOT)


def broken(s, run, **tables):
    """A publication that ends before its last event."""
    whole, s.event = s.event, lambda run, status, *more: whole(run, status, *more) if status != "completed" else (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        s.publish(run, "2024-01-01 00:00:00", **tables)
    s.event = whole


def test_view_equals_recomputation_and_reads_only_new_attempts(spark, tmp_path):
    s, r = store.RunStore(spark, str(tmp_path / "s")), random.Random(2)
    view = versions.MaintainedMarks(s)
    assert view.read() is None and view.refresh() == 0
    for run in range(6):
        rows = snapshots(spark, [(r.randint(0, 20), r.randint(0, 1000)) for _ in range(30)])
        if run == 3:
            broken(s, run, snapshots=snapshots(spark, [(1, 10**9)]))
        s.publish(run, f"2024-01-0{run + 1} 00:00:00", snapshots=rows)
        new = view.pending()
        assert [n for n, _ in new] == [run]
        files = view.changes(new).inputFiles()
        assert files and all(f"run_id={run}/attempt={new[0][1]}" in f for f in files)
        assert view.refresh() == 1 and view.pending() == [] and view.refresh() == 0
        want = {tuple(x) for x in metrics.high_water(s.read("snapshots")).collect()}
        assert {tuple(x) for x in view.read().collect()} == want and max(x[1] for x in want) < 10**9
    assert len(view.marks.numbers()) == view.KEPT


def test_view_catches_up_in_steps_and_after_a_broken_refresh(spark, tmp_path, monkeypatch):
    s = store.RunStore(spark, str(tmp_path / "s"))
    view = versions.MaintainedMarks(s)
    for run in range(5):
        tables = {"snapshots": snapshots(spark, [(run % 2, run)])} if run != 2 else {"other": snapshots(spark, [(9, 9)])}
        s.publish(run, f"2024-01-0{run + 1} 00:00:00", **tables)
    monkeypatch.setattr(versions.MaintainedMarks, "MOST_ATTEMPTS", 2)
    # the marks are written, but not the list that points to them
    write = versions.Versions.write
    monkeypatch.setattr(versions.Versions, "write", lambda self, rows: (_ for _ in ()).throw(OSError("lost")) if "merged" in self.folder else write(self, rows))
    with pytest.raises(OSError):
        view.refresh()
    assert view.read() is None
    monkeypatch.setattr(versions.Versions, "write", write)
    assert view.refresh() == 5
    assert {(r.post_id, r.max_views) for r in view.read().collect()} == {(0, 4), (1, 3)}


def test_half_a_version_is_not_seen(spark, tmp_path):
    table = versions.Versions(spark, str(tmp_path / "t"))
    assert table.current() is None and table.read() is None
    table.write(spark.range(3))
    (tmp_path / "t" / "v=2").mkdir()
    assert table.current() == 1 and table.read().count() == 3
    assert table.write(table.read().union(spark.range(2))) == 2 and table.read().count() == 5


def test_compaction_keeps_every_event_once(spark, tmp_path):
    s = store.RunStore(spark, str(tmp_path / "s"))
    for run in range(4):
        s.publish(run, "2024-01-01 00:00:00", snapshots=snapshots(spark, [(run, 1)]))
    before = sorted(map(tuple, s.events().collect()))
    s.compact()
    assert sorted(map(tuple, s.events().collect())) == before and len(s._files()) == 8
    s.event(9, "running", "2024-01-02 00:00:00")
    s.compact()
    assert len(s._files()) == 1 and len(s.events().collect()) == 9
    s.event(9, "failed", "2024-01-03 00:00:00")
    assert {r.run_id: r.status for r in s.states().collect()} == {0: "completed", 1: "completed", 2: "completed", 3: "completed", 9: "failed"}
    assert s.read("snapshots").count() == 4
    assert s.gathered.read().rdd.getNumPartitions() == 1


def test_publication_compacts_when_there_are_many_events(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store.RunStore, "LOOSE_EVENTS", 3)
    s = store.RunStore(spark, str(tmp_path / "s"))
    for run in range(5):
        s.publish(run, "2024-01-01 00:00:00", snapshots=snapshots(spark, [(run, 1)]))
    assert s.gathered.current() and len(s._files()) < 10 and s.read("snapshots").count() == 5


def test_killed_and_repeated_batches_leave_each_row_once(spark, tmp_path):
    source = str(tmp_path / "in")
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(source)
    s = store.RunStore(spark, str(tmp_path / "s"))
    given = []

    def run(write):
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
        q = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    sink = s.sink("rows", 1000, "2024-01-01 00:00:00")

    def dies(rows, batch):
        """The second batch is published, but the stream dies before it knows; before, half of it was written."""
        given.append(batch)
        if batch == 1 and given.count(1) == 1:
            broken(s, 1001, rows=rows)
            sink(rows, batch)
            raise RuntimeError("killed")
        sink(rows, batch)

    with pytest.raises(Exception, match="killed"):
        run(dies)
    run(dies)
    assert given == [0, 1, 1, 2]
    assert sorted(r.id for r in s.read("rows").collect()) == list(range(30))
    assert spark.read.parquet(f"{s.folder}/rows").count() == 40


def test_rules_hold_across_publications(spark, tmp_path):
    s = store.RunStore(spark, str(tmp_path / "s"))
    make = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    post = lambda *rows: make("post_id long, account_id long, platform_post_id string, provider_id long", *rows)
    shot = lambda *posts: make("post_id long, scraped_at timestamp_ntz, views long, likes long, comments long, shares long", *[(p, datetime(2024, 1, 1), v, 0, 0, 0) for p, v in posts])
    known = {"accounts": make("account_id long, platform_handle string, provider_id long", (1, "h", 1)), "providers": make("provider_id long, name string", (1, "x"))}
    s.publish_checked(1, "2024-01-01 00:00:00", known, posts=post((1, 1, "p", 1)), snapshots=shot((1, 5)))
    refused = {
        "post_of_provider: 1": dict(posts=post((2, 1, "p", 1))), "post_key: 1": dict(posts=post((1, 1, "q", 1))), "post_account: 1": dict(posts=post((2, 9, "q", 1))),
        "snapshot_post: 1": dict(snapshots=shot((7, 5))), "views_not_negative: 1": dict(snapshots=shot((1, -5)), posts=post((3, 1, "r", 1))),
    }
    for rule, more in refused.items():
        with pytest.raises(constraints.BrokenConstraint, match=f"^{rule}$"):
            s.publish_checked(2, "2024-01-02 00:00:00", known, **more)
    assert s.read("posts").count() == 1 and s.read("snapshots").count() == 1
    s.publish_checked(2, "2024-01-02 00:00:00", known, posts=post((2, 1, "q", 1)), snapshots=shot((1, 6), (2, 7)))
    assert s.read("posts").count() == 2 and s.read("snapshots").count() == 3
