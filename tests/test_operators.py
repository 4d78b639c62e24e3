import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import health, metrics, reconcile, rollout, rules, store, uilog
from tidemark.sources import files
from tidemark.streaming import monitor


def test_streaks_and_pauses_match_a_loop(spark):
    r = random.Random(3)
    jobs = [(r.randint(1, 12), i, r.random() < 0.4, i % 7) for i in range(900)]
    df = spark.createDataFrame(jobs, "account_id long, ord long, failed boolean, batch int")
    run, flag, want, skip = {}, {}, {}, {}
    for a, o, f, _ in jobs:
        skip[o] = flag.get(a, False)
        run[a] = run.get(a, 0) + 1 if f else 0
        flag[a] = flag.get(a, False) or run[a] >= 3
        want[o] = (run[a], flag[a])
    assert {x["ord"]: (x["consecutive_failures"], x["flagged"]) for x in health.streaks(df).collect()} == want
    assert {x["ord"]: x["skipped"] for x in health.skipped(df).collect()} == skip
    stop = {}
    for b in range(7):
        mine, bad = [j for j in jobs if j[3] == b], 0
        for n, (_, o, f, _) in enumerate(mine, 1):
            bad += f
            if f and n >= max(5, int(len(mine) * 0.1)) and bad / n > 0.2:
                stop[b] = o
                break
    assert {x["batch"]: x["pause_ord"] for x in health.paused(df).collect()} == stop
    assert health.attempted(df).count() == sum(1 for j in jobs if j[3] not in stop or j[1] <= stop[j[3]])


def test_streaming_streak_equals_batch(spark, tmp_path):
    jobs = [(i % 3, i, (i * 7) % 5 < 3) for i in range(60)]
    df = spark.createDataFrame(jobs, "account_id long, ord long, failed boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = monitor.streaks(stream).writeStream.format("memory").queryName("streaks").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.sql("select account_id, ord, consecutive_failures, flagged from streaks").collect()}
    assert got == {(r["account_id"], r["ord"], r["consecutive_failures"], r["flagged"]) for r in health.streaks(df).collect()}


def test_windowed_counts(spark):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "view", 1.0), ("2024-01-01 00:50:00", "view", 2.0), ("2024-01-01 01:00:00", "view", 4.0)], "t string, event_type string, value double").withColumn("ts", F.col("t").cast("timestamp"))
    assert sorted((r["n"], r["total"]) for r in monitor.windowed_counts(rows).collect()) == [(1, 4.0), (2, 3.0)]
    assert monitor.windowed_counts(rows, "1 hour", "30 minutes").count() == 4
    assert monitor.sessions(rows.withColumn("user_id", F.lit(1)), "15 minutes").count() == 2


def test_late_events_drop(spark, tmp_path):
    """A row behind the watermark of the batches before it is not counted; one within it is."""
    schema = "ts timestamp, event_type string, value double"
    batches = [["2024-01-01 00:10:00"], ["2024-01-01 03:00:00"], ["2024-01-01 00:20:00", "2024-01-01 02:55:00"], ["2024-01-01 06:00:00"]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = monitor.windowed_counts(stream).writeStream.format("memory").queryName("late").outputMode("append").start()
    for times in batches:
        spark.createDataFrame([(t, "view", 1.0) for t in times], "t string, event_type string, value double").select(F.col("t").cast("timestamp").alias("ts"), "event_type", "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    q.stop()
    assert {(str(r["start"]), r["n"]) for r in spark.sql("select * from late").collect()} == {("2024-01-01 00:00:00", 1), ("2024-01-01 02:00:00", 1), ("2024-01-01 03:00:00", 1)}


def test_wave_sizes(spark):
    devices = spark.range(1, 201).select(F.col("id").alias("device_id"), (8 + F.col("id") % 4).alias("version"), F.when(F.col("id") <= 30, "offline").otherwise("good").alias("connection"), F.lit(None).cast("string").alias("task"))
    sizes = {r["wave"]: r["count"] for r in rollout.plan(devices).groupBy("wave").count().collect()}
    assert sizes == {1: 5, 2: 20, 3: 40, 4: 80, 5: 25}
    assert rollout.plan(devices.where("version <> 9")).count() == 0


def test_rollout_outcomes(spark):
    tries = spark.createDataFrame([(1, 1, "disconnected"), (1, 2, "succeeded"), *[(2, i, "disconnected") for i in range(1, 6)]], "device_id long, attempt int, result string")
    assert {r[0]: r[1] for r in rollout.outcome(tries).collect()} == {1: "succeeded", 2: "interrupted"}
    done = spark.createDataFrame([(1, "succeeded", True, True), (2, "failed", False, True), (3, "interrupted", True, True)], "device_id long, status string, has_snapshot boolean, restored_ok boolean")
    assert {r["device_id"]: r["status"] for r in rollout.rolled_back(done).collect()} == {1: "rolled_back", 2: "failed", 3: "interrupted"}
    gates = spark.createDataFrame([("succeeded",), ("succeeded",), ("interrupted",)], "status string")
    assert gates.agg(health.failure_rate(F.col("status"))).first()[0] == 0
    assert gates.union(spark.createDataFrame([("failed",)], "status string")).agg(health.failure_rate(F.col("status"))).first()[0] == pytest.approx(1 / 3)


def sample(spark):
    url = "https://www.tiktok.com/@creator/video/{}"
    post = lambda id, u, v, l, c, cap, at: {"id": id, "url": u, "views": v, "likes": l, "comments": c, "caption": cap, "posted_at": at, "account": "@creator"}
    a = [post(None, "https://vm.tiktok.com/ZMabc/", 45000, 1800, 90, "A walk through the old town at night", "2025-03-14T15:30:00Z"), post("732", url.format(732), 12000, 450, 25, "Morning coffee and a long talk", "2025-03-14T09:00:00Z")]
    b = [post("721", url.format(721), 44800, 1850, 94, "A walk through the old...", "2025-03-14T10:30:00-05:00"), post("732", url.format(732), 11900, 440, 28, "Morning coffee...", "2025-03-14T09:00:00Z")]
    snap = [{"platform_id": "721", "views": 46000, "likes": 1700, "scraped_at": "2025-03-13T00:00:00Z"}, {"platform_id": "720", "views": 22400, "likes": 900, "scraped_at": "2025-03-13T00:00:00Z"}]
    own = [{"account": "@creator", "client": "client_a", "from": "2025-01-01T00:00:00Z", "to": "2025-03-14T15:00:00Z"}, {"account": "@creator", "client": "client_b", "from": "2025-03-14T15:00:00Z", "to": ""}]
    return files.posts(spark, a, "A").unionByName(files.posts(spark, b, "B")), files.snapshots(spark, snap), files.assignments(spark, own)


def test_reconciliation_end_to_end(spark):
    report = reconcile.reconciled(*sample(spark))
    posts = {r["post_id"]: (r["status"], r["views"], r["likes"], r["comments"], r["client"]) for r in report.posts.collect()}
    assert posts == {"732": ("active", 12000, 450, 28, "client_a"), "721": ("active", 46000, 1850, 94, "client_b"), "720": ("missing", 22400, 900, 0, "unknown")}
    kinds = sorted(r["kind"] for r in report.anomalies.collect())
    assert kinds.count("metric_conflict") == 6 and kinds.count("view_decrease") == 2 and kinds.count("caption_truncation_match") == 2
    assert kinds.count("unresolved_share_url") == 1 and kinds.count("disappeared_post") == 1 and "possible_outage" not in kinds and len(kinds) == 12
    assert report.unresolved.count() == 0


def test_contested_shares_walk_in_order(spark):
    u = "https://www.tiktok.com/@c/video/{}"
    row = lambda v, i, id, url, cap, at: (v, i, id, url, 1, 1, 1, cap, f"2024-01-01 {at}", "@c")
    rows = [row("A", 0, None, "vm.tiktok.com/a", "same", "10:00:00"), row("A", 1, None, "vm.tiktok.com/b", "same", "10:10:00"), row("B", 0, "1", u.format(1), "same", "10:05:00"), row("B", 1, "2", u.format(2), "same", "11:05:00")]
    df = spark.createDataFrame(rows, "vendor string, ord long, id string, url string, views long, likes long, comments long, caption string, posted_at string, account string").withColumn("posted_at", F.col("posted_at").cast("timestamp"))
    assert {(r["share_ord"], r["candidate"]) for r in reconcile.matches(reconcile.classified(df)).collect()} == {(0, "1"), (1, "2")}


def _post_frame(spark, rows):
    schema = "vendor string, ord long, id string, url string, views long, likes long, comments long, caption string, at string, account string"
    return spark.createDataFrame(rows, schema).withColumn("posted_at", F.col("at").cast("timestamp")).drop("at")


def test_walk_equals_a_loop(spark):
    """Random accounts with contested, ambiguous and free shared rows, and one id under two accounts."""
    r, rows = random.Random(11), []
    for i in range(260):
        at, account = f"2024-01-0{r.randint(1, 3)} {r.randint(0, 23):02d}:{r.choice([0, 20, 40]):02d}:00", f"@a{r.randint(0, 3)}"
        if r.random() < 0.45:
            rows.append(("A", i, r.choice([None, "", f"s{i}"]), r.choice(["vm.tiktok.com/x", "vt.tiktok.com/y"]), 1, 1, 1, r.choice(["c", "d"]), at, account))
        else:
            n = r.choice([i, r.randint(0, 40)])
            rows.append((r.choice("AB"), i, None if r.random() < 0.5 else str(n), f"https://www.tiktok.com/@x/video/{n}", 1, 1, 1, r.choice(["c", "d"]), at, account))
    clock = lambda x: (int(x[8:10]) * 24 + int(x[11:13])) * 60 + int(x[14:16])
    order = sorted(rows, key=lambda x: (x[0], x[1]))
    taken, want = set(), set()
    for s in order:
        if "/video/" in s[3]:
            continue
        free = [c for c in order if "/video/" in c[3] and (c[2] or c[3].split("/")[-1]) not in taken and c[9] == s[9] and abs(clock(c[8]) - clock(s[8])) <= 60 and c[7] == s[7]]
        if len(free) == 1:
            taken.add(free[0][2] or free[0][3].split("/")[-1])
            want.add((s[0], s[1], free[0][2] or free[0][3].split("/")[-1]))
    got = reconcile.matches(reconcile.classified(_post_frame(spark, rows)))
    assert {tuple(x) for x in got.select("share_vendor", "share_ord", "candidate").collect()} == want and len(want) > 10


def test_unknown_links_and_other_ids(spark):
    link = "https://www.tiktok.com/@c/video/{}"
    rows = [
        ("A", 0, None, "https://other.example/x", 3, 1, 1, "lost", "2025-03-14 16:00:00", "@creator"), ("A", 1, "9", "https://other.example/y", 4, 1, 1, "kept", "2025-03-14 16:00:00", "@creator"),
        ("A", 2, "100", link.format(200), 5, 1, 1, "two ids", "2025-03-14 16:00:00", "@creator"), ("A", 3, None, "vm.tiktok.com/s", 6, 1, 1, "twin", "2025-03-14 10:00:00", "@creator"),
        ("A", 4, None, "vm.tiktok.com/s", 7, 1, 1, "alone", "2025-03-14 10:00:00", "@creator"), ("B", 0, "300", link.format(300), 8, 1, 1, "twin", "2025-03-14 10:30:00", "@creator"),
    ]
    _, _, owners = sample(spark)
    snap = files.snapshots(spark, [{"platform_id": i, "views": v, "likes": 1, "scraped_at": "2025-03-13T00:00:00Z"} for i, v in (("200", 1), ("100", 2), ("100", 3))])
    report = reconcile.reconciled(_post_frame(spark, rows), snap, owners)
    posts = report.posts.collect()
    assert sorted((r["post_id"], r["views"], r["client"]) for r in posts if r["status"] == "active") == [("200", 5, "client_b"), ("300", 8, "client_a"), ("9", 4, "client_b")]
    # the row that was matched is reported again, since another row of its link was not
    assert sorted((r["post_id"], r["views"], r["client"]) for r in posts if r["status"] == "unresolved") == [(None, 3, "client_b"), (None, 6, "client_a"), (None, 7, "client_a")]
    assert [(r["post_id"], r["views"]) for r in posts if r["status"] == "missing"] == [("100", 3), ("100", 3)]
    assert {r["post_id"]: r["canonical_url"] for r in posts if r["status"] == "active"}["300"] == "https://www.tiktok.com/@c/video/300"
    views = next(p for r in posts if r["post_id"] == "200" for p in r["provenance"] if p["metric"] == "views")
    assert (views["provider_a"], views["provider_b"], views["snapshot"], views["resolved"]) == (5, None, 1, 5)
    assert sorted(r["url"] for r in report.unresolved.collect()) == ["https://other.example/x", "vm.tiktok.com/s"]


def test_outage(spark):
    posts, _, owners = sample(spark)
    snap = files.snapshots(spark, [{"platform_id": str(i), "views": 1, "likes": 1, "scraped_at": "2025-01-01T00:00:00Z"} for i in range(5)])
    kinds = [r["kind"] for r in reconcile.reconciled(posts.limit(0), snap, owners).anomalies.collect()]
    assert kinds.count("disappeared_post") == 5 and kinds.count("possible_outage") == 1
    with pytest.raises(KeyError):
        files.posts(spark, [{"url": "x"}], "A")


def test_rules(spark):
    ok = {"getprop persist.sys.locale": "en-US"}
    rows = [
        (1, "locale", ok, {}), (1, "timezone", {"getprop persist.sys.timezone": "America/Chicago", "settings get global auto_time_zone": "0"}, {}), (1, "sim_mcc", {"getprop gsm.sim.state": "ABSENT"}, {}),
        (2, "locale", {**ok, "getprop ro.product.locale": "de_DE"}, {}), (2, "sim_mcc", {"getprop gsm.sim.state": "ready", "getprop gsm.sim.operator.numeric": "26201"}, {}), (2, "wifi", {"wifi_on": "0"}, {"saved_networks": ["a", "b", "c", "d"]}),
        (2, "ip_validation", {"public_ip": "10.0.0.1"}, {}), (2, "other", {}, {}), (2, "screen_lock", {"locksettings get-disabled": "", "settings get secure lockscreen.password_type": ""}, {}),
        (2, "app_state", {"pm_list": "package:com.example.app", "version_name": "versionName=0.9.1", "shared_prefs": "account.xml\nother.xml"}, {}), (2, "usb_debugging", {"settings get global adb_enabled": "1"}, {}), (2, "gps_location", {"location_mode": "3"}, {}),
    ]
    df = spark.createDataFrame([(str(d), c, r, l) for d, c, r, l in rows], rules.SCHEMA)
    got = {(r["device_id"], r["check"]): (r["status"], r["failures"], r["warnings"], r["passed"]) for r in rules.verdicts(df).collect()}
    assert got[("1", "locale")] == ("pass", 0, 0, True) and got[("1", "timezone")][0] == "pass" and got[("1", "sim_mcc")] == ("warn", 0, 1, True)
    assert got[("2", "locale")][0] == "warn" and got[("2", "sim_mcc")][0] == "fail" and got[("2", "wifi")][0] == "fail" and got[("2", "ip_validation")][0] == "fail"
    assert got[("2", "other")][0] == "warn" and got[("2", "screen_lock")][0] == "warn" and got[("2", "app_state")][1] == 2 and got[("2", "usb_debugging")][0] == "warn" and got[("2", "gps_location")] == ("fail", 1, 0, False)


def test_screens(spark):
    screens = spark.createDataFrame([("a", '<hierarchy><node text="For you" class="x"/><node text="Following"/></hierarchy>'), ("b", '<hierarchy><node text="For you"/><node resource-id="id/dialog_1"/></hierarchy>'), ("c", "<broken"), ("d", "<hierarchy/>")], "screen string, xml string")
    signs = [("home_feed", 0, 0, "text", "(?i)for you"), ("home_feed", 0, 1, "text", "(?i)following"), ("profile", 1, 0, "text", "(?i)following"), ("popup", 6, 0, "resource_id", "(?i)dialog")]
    assert {r[0]: r[1] for r in uilog.scored(screens, signs).collect()} == {"a": "home_feed", "b": "popup", "c": "unknown", "d": "unknown"}
    uilog.register(spark)
    screens.createOrReplaceTempView("dumps")
    assert [tuple(r) for r in spark.sql("select screen, n.nth, n.text from dumps, lateral ui_nodes(xml) n where screen = 'a' order by nth").collect()] == [("a", 0, "For you"), ("a", 1, "Following")]


def test_log_and_check_files(spark, tmp_path):
    (tmp_path / "log").write_text(json.dumps({"timestamp": "t", "level": "INFO", "action": "x", "result": "ok"}) + "\nnot json\n")
    rows = files.log_lines(spark, str(tmp_path / "log")).collect()
    assert rows[0]["action"] == "x" and rows[1]["level"] is None
    (tmp_path / "checks.json").write_text(json.dumps([{"device_id": "1", "check": "wifi", "raw_output": {"wifi_on": "1", "saved_networks": ["n"]}, "commands_run": []}], indent=1))
    assert rules.findings(files.check_results(spark, str(tmp_path / "checks.json"))).count() == 2


def test_reports(spark):
    rows = [("1", "wifi", {"wifi_on": "1"}, {}), ("1", "odd", {}, {}), ("2", "wifi", {"wifi_on": "0"}, {})]
    out = rules.reports(spark.createDataFrame(rows, rules.SCHEMA))
    got = {r["device_id"]: (r["passed"], json.loads(r["report"])) for r in out.collect()}
    assert got["1"][1]["pass"] is False and len(got["1"][1]["failures"]) == 1 and len(got["1"][1]["warnings"]) == 1 and list(got["1"][1]["details"]) == ["wifi"]
    assert got["2"] == (True, {"pass": True, "failures": [], "warnings": [], "details": {"wifi": {"failures": [], "warnings": [], "status": "pass"}}})
    assert rules.exit_code(out) == 1 and rules.exit_code(out.where("device_id = '2'")) == 0


def test_recorded_responses(spark, tmp_path):
    whole = {"job_id": 1, "attempt": 2, "vendor": "A", "account": "@a", "fetched_at": 1.5, "is_complete": True, "posts": [{"platform_post_id": "p", "views": 1, "likes": 2, "comments": 3, "shares": 4, "published_at": "2024-01-01T00:00:00Z"}]}
    lines = [{"job_id": 1, "attempt": 1, "vendor": "A", "account": "@a", "outcome": "rate_limited", "retry_after": 9}, {**whole, "attempt": 3, "is_complete": False}, whole]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)))
    attempts, posts = files.responses(spark, str(tmp_path / "r.jsonl"))
    assert {(r["attempt"], r["outcome"], r["retry_after"]) for r in attempts.collect()} == {(1, "rate_limited", 9.0), (2, "complete", None), (3, "partial", None)}
    assert [(r["platform_post_id"], r["views"], r["attempt"]) for r in posts.collect()] == [("p", 1, 2)]
    files.report(posts, str(tmp_path / "out"))
    assert json.loads(next((tmp_path / "out").glob("*.json")).read_text())["platform_post_id"] == "p"


def test_retries(spark):
    rows = [(1, 1, "rate_limited", 7.0, 0.5), (1, 2, "rate_limited", None, 0.5), (1, 3, "complete", None, 0.5), (2, 1, "refused", None, 0.0), (2, 2, "complete", None, 0.0), *[(3, i, "timeout", None, 0.0) for i in range(1, 7)]]
    df = spark.createDataFrame(rows, "job_id long, attempt long, outcome string, retry_after double, jitter double")
    assert {r[0]: tuple(r)[1:] for r in health.retried(df).collect()} == {1: ("accepted", 3, 9.5), 2: ("raised", 1, 0.0), 3: ("exhausted", 4, 7.0)}


def test_unflagging_starts_anew(spark):
    jobs = spark.createDataFrame([(1, i, True) for i in range(1, 8)], "account_id long, ord long, failed boolean")
    off = spark.createDataFrame([(1, 5)], "account_id long, ord long")
    got = [(r["consecutive_failures"], r["flagged"], r["skipped"]) for r in health.streaks(jobs, off).orderBy("ord").collect()]
    assert got == [(1, False, False), (2, False, False), (3, True, False), (4, True, True), (1, False, False), (2, False, False), (3, True, False)]


def test_publication_is_atomic_and_can_be_repeated(spark, tmp_path):
    s = store.RunStore(spark, str(tmp_path / "store"))
    posts = spark.createDataFrame([("a", "2024-01-01 00:00:00", 5, 1, 1, 1), ("b", "2024-01-01 00:00:00", 6, 1, 1, 1)], "platform_post_id string, at string, views long, likes long, comments long, shares long").withColumn("published_at", F.col("at").cast("timestamp_ntz")).drop("at")
    whole, s.event = s.event, lambda run, status, *more: whole(run, status, *more) if status != "completed" else (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        s.publish_batch(1, 10, 2, posts, "2024-01-01 00:00:00")
    s.event = whole
    assert s.states().first()["status"] == "running" and s.read("snapshots").count() == 0
    s.publish_batch(1, 10, 2, posts, "2024-01-02 00:00:00")
    s.publish_batch(2, 10, 2, posts.withColumn("views", F.col("views") + 1), "2024-01-03 00:00:00")
    assert s.read("snapshots").count() == 4 and s.read("posts").count() == 2 and s.read("run_accounts").count() == 2
    assert {r["platform_post_id"]: sorted(r["v"]) for r in s.posts().join(s.read("snapshots").select("post_id", "views"), "post_id").groupBy("platform_post_id").agg(F.collect_list("views").alias("v")).collect()} == {"a": [5, 6], "b": [6, 7]}
    for broken in (posts.withColumn("views", F.lit(-1).cast("long")), posts.unionByName(posts), posts.withColumn("likes", F.lit(None).cast("long"))):
        with pytest.raises(store.BrokenRule):
            s.publish_batch(3, 10, 2, broken, "2024-01-04 00:00:00")
    with pytest.raises(store.BrokenRule):
        s.publish_batch(2, 10, 2, posts, "2024-01-04 00:00:00")
    for refused in (s.update, s.delete, s.overwrite):
        with pytest.raises(store.AppendOnly):
            refused("snapshots")
    assert store.changed_rows(posts, posts.where("views = 5")).count() == 1 and store.changed_rows(posts, posts).count() == 0


def test_store(spark, tmp_path):
    s = store.RunStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(1, 5)], "post_id long, views long")
    s.publish(1, "2024-01-01 00:00:00", snapshots=rows)
    s.event(2, "running", "2024-01-02 00:00:00")
    rows.withColumn("run_id", F.lit(2)).withColumn("attempt", F.lit("x")).write.mode("append").partitionBy("run_id", "attempt").parquet(f"{s.folder}/snapshots")
    assert s.read("snapshots").count() == 1 and {r[0]: r[1] for r in s.states().collect()} == {1: "completed", 2: "running"}
    with pytest.raises(ValueError):
        s.event(3, "done", "2024-01-01 00:00:00")


def test_ownership_change_and_first_owner(spark):
    own = spark.createDataFrame([(1, 10, "2024-01-01 00:00:00", None)], "account_id long, client_id long, valid_from string, valid_to string").select("account_id", "client_id", F.col("valid_from").cast("timestamp_ntz"), F.col("valid_to").cast("timestamp_ntz"))
    moved = store.close_and_open(own, 1, 20, "2024-06-01 00:00:00")
    assert moved.where("valid_to is null").first()["client_id"] == 20 and moved.count() == 2
    with pytest.raises(ValueError):
        store.close_and_open(own, 1, 20, "2023-06-01 00:00:00")
    posts = spark.createDataFrame([(1, 1, "2024-05-31 23:59:59"), (2, 1, "2024-06-01 00:00:00"), (3, 2, "2024-06-01 00:00:00")], "post_id long, account_id long, at string").select("post_id", "account_id", F.col("at").cast("timestamp_ntz").alias("published_at"))
    a = moved.select("account_id", F.col("client_id").cast("string").alias("client"), "valid_from", "valid_to", F.col("client_id").alias("ord"))
    assert {r[0]: r[1] for r in metrics.first_owner(posts, a).collect()} == {1: "10", 2: "20", 3: "unattributed"}
