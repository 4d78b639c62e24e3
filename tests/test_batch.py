"""A recorded batch against a loop over its jobs."""

import random

from tidemark.operators import batch, health

ATTEMPT = "job_id long, vendor string, attempt int, outcome string, retry_after double, jitter double, took double"
POST = "job_id long, vendor string, platform_post_id string, views long, likes long, comments long, shares long"


def called(tries):
    """(status, seconds) of one vendor's call."""
    spent = 0.0
    for attempt, outcome, after, jitter, took in tries[:4]:
        spent += took
        if outcome == "complete":
            return "accepted", spent
        if outcome not in health.RETRIED:
            return "raised", spent
        if attempt < 4:
            spent += after if outcome == "rate_limited" and after is not None else min(30.0, 2.0 ** (attempt - 1) + jitter)
    return "exhausted", spent


def looped(jobs, tries, posts, limit):
    run, flagged, counts, paused, known = {}, set(), {}, set(), {}
    total = {b: sum(1 for j in jobs if j[3] == b) for b in {j[3] for j in jobs}}
    results, shots = {}, []
    for job, account, ord_, b in sorted(jobs, key=lambda j: j[2]):
        if b in paused:
            results[job] = ("not_run", None, None)
            continue
        if account in flagged:
            results[job] = ("skipped", None, None)
            continue
        ends = {v: called(tries[job, v]) for v in batch.VENDORS if (job, v) in tries}
        if len(ends) < 2:
            reason, at = "exhausted", 0.0
        else:
            bad = sorted((s, status) for status, s in ends.values() if status != "accepted")
            last = max(s for _, s in ends.values())
            reason, at = (bad[0][1], bad[0][0]) if bad and bad[0][0] <= limit else ("timeout", limit) if last > limit else (None, last)
        done, failed = counts.get(b, (0, 0))
        counts[b] = done, failed = done + 1, failed + (reason is not None)
        run[account] = run.get(account, 0) + 1 if reason else 0
        if run[account] >= health.STREAK:
            flagged.add(account)
        if reason:
            results[job] = ("failure", reason, at)
            if done >= max(5, int(total[b] * 0.1)) and failed / done > 0.2:
                paused.add(b)
            continue
        mine = {}
        for v, p, views in posts.get(job, []):
            sides, best = mine.get(p, (set(), 0))
            mine[p] = (sides | {v}, max(best, views))
        fresh = [p for p in mine if (account, p) not in known]
        known |= {(account, p): 1 for p in mine}
        shots += [(job, p, best) for p, (_, best) in mine.items()]
        side = lambda v: sum(v in s for s, _ in mine.values())
        results[job] = ("success", None, at, side("A"), side("B"), len(mine), sum(len(s) == 2 for s, _ in mine.values()), len(fresh))
    return results, sorted(shots)


def test_batches_equal_a_loop(spark):
    r, jobs, tries, posts = random.Random(13), [], {}, {}
    for job in range(400):
        account = r.randint(0, 60)
        jobs.append((job, account, job, account % 5))
        for v in batch.VENDORS:
            if r.random() < 0.01:
                continue
            said = r.choice([["complete"]] * 16 + [["timeout", "complete"], ["rate_limited", "partial", "complete"], ["refused", "complete"], ["timeout"] * 4 + ["complete"], ["partial", "unavailable", "refused"]])
            tries[job, v] = [(i + 1, o, r.choice([None, 7.0]) if o == "rate_limited" else None, r.random(), r.choice([1.0, 30.0, 250.0])) for i, o in enumerate(said)]
        posts[job] = [(v, f"{account}-{r.randint(0, 6)}", r.randint(0, 99)) for v in "AB" for _ in range(r.randint(0, 4))]
    for job in range(400, 520):  # a batch that goes on though one of its accounts always fails
        account = 100 if job % 20 == 3 else 101 + job % 9
        jobs.append((job, account, job, 9))
        tries |= {(job, v): [(1, "refused" if account == 100 else "complete", None, 0.0, 1.0)] for v in batch.VENDORS}
    tries[460, "A"] = [(i + 1, o, None, 0.5, 250.0) for i, o in enumerate(["timeout", "timeout", "complete"])]
    want, shots = looped(jobs, tries, posts, 600)
    frame = spark.createDataFrame(jobs, "job_id long, account_id long, ord long, batch long")
    attempts = spark.createDataFrame([(j, v, *t) for (j, v), rows in tries.items() for t in rows], ATTEMPT)
    answers = spark.createDataFrame([(j, v, p, views, 0, 0, 0) for j, rows in posts.items() for v, p, views in rows], POST)
    results, snapshots = batch.run(frame, attempts, answers)
    counts = ("posts_a", "posts_b", "reconciled", "overlap", "new_posts")
    got = {x.job_id: (x.outcome, x.reason, None if x.ended is None else round(x.ended, 6), *([x[c] for c in counts] if x.outcome == "success" else [])) for x in results.collect()}
    assert got == {j: tuple(round(x, 6) if isinstance(x, float) else x for x in w) for j, w in want.items()}
    assert {w[0] for w in want.values()} == {"success", "failure", "skipped", "not_run"} and {w[1] for w in want.values()} >= {"timeout", "raised", "exhausted"}
    assert sorted((x.job_id, x.platform_post_id, x.views) for x in snapshots.collect()) == shots


def test_empty_batch(spark):
    jobs = spark.createDataFrame([], "job_id long, account_id long, ord long, batch long")
    results, snapshots = batch.run(jobs, spark.createDataFrame([], ATTEMPT), spark.createDataFrame([], POST))
    assert results.collect() == [] and snapshots.collect() == []
