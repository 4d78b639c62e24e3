"""Recorded responses through the data source: partitions, pushed filters, pages of a stream."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import recorded


def response(job, **more):
    return {"job_id": job, "attempt": 1, "vendor": "A", "fetched_at": 1.5, "is_complete": True, "posts": [{"platform_post_id": f"p{job}", "views": job, "likes": 1, "comments": 0, "shares": 0, "published_at": "2024-01-01T00:00:00Z"}], **more}


@pytest.fixture
def folder(tmp_path, spark):
    recorded.register(spark)

    def put(account, name, *lines):
        (tmp_path / "in" / f"account={account}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / f"account={account}" / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))

    put("@a", "page-0.json", response(1), response(2, is_complete=False), response(3, outcome="rate_limited", retry_after=9, posts=None))
    put("@a", "page-1.json", response(4), "", "not json")
    put("b%2Fc", "page-0.json", response(5), response(6, posts=[]))
    put("@z", "_hidden.json", response(9))
    put.path = str(tmp_path / "in")
    return put


def rows(df):
    return sorted((r.account, r.job_id or 0, r.outcome, [p.platform_post_id for p in r.posts]) for r in df.collect())


ALL = [("@a", 0, "unreadable", []), ("@a", 1, "complete", ["p1"]), ("@a", 2, "partial", []), ("@a", 3, "rate_limited", []), ("@a", 4, "complete", ["p4"]), ("b/c", 5, "complete", ["p5"]), ("b/c", 6, "complete", [])]


def test_batch(spark, folder):
    read = lambda: spark.read.format("recorded_responses").option("path", folder.path).load()
    assert rows(read()) == ALL and read().rdd.getNumPartitions() == 2
    small = spark.read.format("recorded_responses").option("path", folder.path).option("partitionBytes", 10).load()
    assert rows(small) == ALL and small.rdd.getNumPartitions() == 3
    assert [r.retry_after for r in read().where("outcome = 'rate_limited'").collect()] == [9.0]
    nothing = spark.read.format("recorded_responses").option("path", folder.path + "/none").load()
    assert nothing.collect() == [] and nothing.columns == read().columns


def test_filters_on_the_account_are_pushed(spark, folder):
    read = spark.read.format("recorded_responses").option("path", folder.path).load()
    one = read.where("account = '@a' and job_id > 1")
    assert rows(one) == [r for r in ALL if r[0] == "@a" and r[1] > 1] and one.rdd.getNumPartitions() == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    condition = next((x for x in plan.split("\n") if "Filter" in x and "job_id" in x), "")
    assert "job_id" in condition and "@a" not in condition
    assert rows(read.where(F.col("account").isin("b/c", "x"))) == ALL[-2:]
    assert rows(read.where("account = '@a' and account = 'b/c'")) == []
    # what can't be answered by the listing is left to Spark
    assert rows(read.where("account like 'b%'")) == ALL[-2:]


def test_stream_of_pages_goes_on_after_a_restart(spark, folder, tmp_path):
    def drain():
        stream = spark.readStream.format("recorded_responses").option("path", folder.path).load()
        q = stream.select("account", "job_id", "outcome").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
        return sorted((r.account, r.job_id or 0) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert drain() == [r[:2] for r in ALL]
    folder("@a", "page-2.json", response(7))
    folder("@new", "page-2.json", response(8))
    assert drain() == sorted([r[:2] for r in ALL] + [("@a", 7), ("@new", 8)])
    assert drain() == sorted([r[:2] for r in ALL] + [("@a", 7), ("@new", 8)])


def test_very_many_accounts_share_files_and_partitions(spark, tmp_path):
    recorded.register(spark)
    n = recorded.APART * 2
    own = tmp_path / "own"
    for i in range(n):
        (own / f"account=a{i}").mkdir(parents=True)
        (own / f"account=a{i}" / "page-0.json").write_text(json.dumps(response(i)))
    made = spark.range(n).selectExpr("concat('a', id) account", "id job_id", "true is_complete", "array(named_struct('platform_post_id', concat('p', id))) posts")
    made = made.unionByName(spark.sql("select cast(null as string) account, 9999 job_id, true is_complete, array(named_struct('platform_post_id', 'p9999')) posts"))
    recorded.write(made, str(tmp_path / "grouped"), 100)
    want = {(f"a{i}", i, f"p{i}") for i in range(n)}
    for folder, more in ((own, set()), (tmp_path / "grouped", {(None, 9999, "p9999")})):
        read = spark.read.format("recorded_responses").option("path", str(folder)).load()
        got = [(r.account, r.job_id, r.posts[0].platform_post_id) for r in read.collect()]
        assert len(got) == len(want | more) and set(got) == want | more
        assert read.rdd.getNumPartitions() < 10
        some = read.where("account in ('a7', 'a70', 'none')")
        assert sorted((r.account, r.job_id) for r in some.collect()) == [("a7", 7), ("a70", 70)] and some.rdd.getNumPartitions() <= 3
        assert read.where("account is null").count() == len(more)
    assert len({p.parent.name for p in (tmp_path / "grouped").rglob("*.json")}) == 6
