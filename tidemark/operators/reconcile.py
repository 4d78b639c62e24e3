"""Two vendors' posts reconciled with the previous snapshot and the owners of accounts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators.asof import holding
from tidemark.operators.components import components
from tidemark.staging import staged

OUTAGE = 3
METRICS = ("views", "likes", "comments")
#: Named as in the vendors' own reports.
SOURCES = {"A": "provider_a", "B": "provider_b"}


@dataclass
class Report:
    posts: DataFrame
    anomalies: DataFrame
    unresolved: DataFrame


def classified(posts: DataFrame) -> DataFrame:
    """Adds kind, vid (the URL's id), given (the row's own id, else the URL's; null if empty),
    shared (rows without a known id: share links, and unknown links without an id) and turn,
    the order in which rows are read: all of A, then B."""
    turn = F.struct(F.when(F.col("vendor") == "A", 0).otherwise(1).alias("v"), F.col("ord").alias("o"))
    rows = posts.withColumn("kind", X.url_kind(F.col("url"))).withColumn("vid", X.video_id(F.col("url"))).withColumn("turn", turn)
    rows = rows.withColumn("given", F.nullif(F.coalesce("id", F.when(F.col("kind") == "canonical", F.col("vid"))), F.lit("")))
    return rows.withColumn("shared", (F.col("kind") == "share") | ((F.col("kind") == "unknown") & F.col("given").isNull()))


def candidates(posts: DataFrame) -> DataFrame:
    """Canonical rows of either vendor that a shared row could be: same account, within an hour, matching caption.

    The join is on account and hour bucket; a shared row looks in its hour and both
    neighbours, so an account with very many posts doesn't pair them all.
    """
    hour = F.floor(F.unix_timestamp(F.col("posted_at").cast("timestamp")) / X.CLOSE_SECONDS).cast("long")
    s = posts.where("shared").select("account", F.col("vendor").alias("share_vendor"), F.col("ord").alias("share_ord"), F.col("turn").alias("share_turn"), F.col("caption").alias("share_caption"), F.col("posted_at").alias("share_at"), F.explode(F.array(hour - 1, hour, hour + 1)).alias("hour"))
    c = posts.where("kind = 'canonical' and given is not null").select("account", "vendor", F.col("ord").alias("candidate_ord"), F.col("given").alias("candidate"), "turn", "caption", "posted_at", hour.alias("hour"))
    near = X.times_close(F.col("share_at"), F.col("posted_at")) & X.captions_match(F.col("share_caption"), F.col("caption"))
    return s.join(c, ["account", "hour"]).where(near).select("account", "share_vendor", "share_ord", "share_turn", "share_at", "vendor", "candidate_ord", "candidate", "turn")


WALKED = "share_vendor string, share_ord long, candidate string"


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shared rows in order of their group and turn; each takes its candidate if just one isn't taken yet.

    Rows arrive sorted, so a group needs no more memory than the ids taken in it; a
    shared row's candidates may be parted between two frames.
    """
    group, taken, now, free = None, set(), None, []

    def settled():
        if now is not None and len(free) == 1:
            taken.add(free[0])
            return [(now[1], now[2], free[0])]
        return []

    for frame in frames:
        out = []
        for g, at, vendor, ord_, candidate in frame[["grp", "at", "share_vendor", "share_ord", "candidate"]].itertuples(index=False):
            if (g, at, vendor, ord_) != (group, *(now or (None,) * 3)):
                out += settled()
                if g != group:
                    group, taken = g, set()
                now, free = (at, vendor, ord_), []
            if candidate not in taken:
                free.append(candidate)
        yield pd.DataFrame(out, columns=["share_vendor", "share_ord", "candidate"])
    yield pd.DataFrame(settled(), columns=["share_vendor", "share_ord", "candidate"])


def matches(posts: DataFrame) -> DataFrame:
    """share_vendor, share_ord, candidate: the id each shared row was matched with.

    A shared row with exactly one candidate row whose id no earlier shared row took is
    matched.  Where no candidate id is within reach of two shared rows that is a count.
    Only groups that hold a contested id are walked in order.  What two rows do only
    depends on each other if a chain of contested ids ties them: a group is a component
    (see ``walk_groups``), so unrelated ids are walked by different tasks.
    """
    found = staged(candidates(posts), "within-reach")  # read several times below
    shared = ["share_vendor", "share_ord"]
    rows = found.join(walk_groups(found), shared, "left")
    # a row of no group contests nothing: its candidates are its own
    alone = rows.where("grp is null").groupBy(*shared).agg(F.count("*").alias("c"), F.min("candidate").alias("candidate")).where("c = 1").drop("c")
    at = F.col("share_turn.v") * F.lit(1 << 60).cast("long") + F.col("share_turn.o")
    walked = rows.where("grp is not null").select("grp", at.alias("at"), *shared, "candidate")
    walked = walked.repartition("grp").sortWithinPartitions("grp", "at", *shared)
    return alone.unionByName(walked.mapInPandas(_walk, WALKED))


def walk_groups(found: DataFrame) -> DataFrame:
    """found: rows of ``candidates``.  share_vendor, share_ord, grp of each shared row that reaches for a contested id.

    Shared rows and the ids that two or more of them reach for are a graph; grp is the
    component.  Each id ties its rows to the first of them, so an id that very many rows
    reach for makes as many edges, not their square.
    """
    shared = ["share_vendor", "share_ord"]
    reach = found.select(*shared, "candidate").distinct()
    # vendors are A and B: the row's number, even for A
    node = F.col("share_ord") * 2 + F.when(F.col("share_vendor") == "A", 0).otherwise(1)
    reach = reach.withColumn("node", node.cast("long"))
    least = reach.groupBy("candidate").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").select("candidate", "first")
    tied = staged(reach.join(least, "candidate").select(*shared, "node", "first"), "contested")
    roots = components(tied.select(F.col("node").alias("a"), F.col("first").alias("b")), "ties")
    return tied.select(*shared, "node").distinct().join(roots.select(F.col("id").alias("node"), F.col("root").alias("grp")), "node").drop("node")


def _grouped(posts: DataFrame, matched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows under the id that they are reported by, and shared rows with their match, if any."""
    met = posts.where("shared").join(matched, (F.col("vendor") == F.col("share_vendor")) & (F.col("ord") == F.col("share_ord")), "left").drop("share_vendor", "share_ord")
    listed = posts.where("not shared").withColumn("post_id", F.coalesce("vid", "given")).withColumn("phase", F.lit(0))
    joined = met.where("candidate is not null").withColumn("post_id", F.col("candidate")).withColumn("phase", F.lit(1)).drop("candidate")
    return listed.unionByName(joined).withColumn("place", F.struct("phase", "turn")), met


def missing(posts: DataFrame, snapshot: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """Snapshot rows whose id no group of today has, every duplicate of them, with the last duplicate's values.

    posts: classified rows.  Seen ids are those that rows are grouped by: the URL's, else
    the row's own, and the ids that shared rows were matched with.
    """
    seen = posts.where("not shared").select(F.coalesce("vid", "given").alias("id"))
    if matched is not None:
        seen = seen.unionByName(matched.select(F.col("candidate").alias("id")))
    last = snapshot.groupBy("id").agg(F.max_by(F.struct(*[c for c in snapshot.columns if c not in ("id", "ord")]), "ord").alias("s"), F.count("*").alias("times"))
    lost = last.join(seen.distinct(), "id", "left_anti")
    return lost.select("id", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth"), "s.*").drop("nth")


def _owner(rows: DataFrame, key: str, account: str, at: str, owners: DataFrame) -> DataFrame:
    """Adds client: the first owner in input order whose period holds the time, else unattributed."""
    own = owners.select(F.col("account").alias(account), F.col("ord").alias("nth"), F.col("client").alias("owner"), "valid_from", "valid_to")
    first = holding(rows.select(key, account, at), own, account, at).groupBy(key).agg(F.min_by("owner", "nth").alias("client"))
    return rows.join(first, key, "left").withColumn("client", F.coalesce("client", F.lit("unattributed")))


def _detail(**c: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in c.items()]), {"ignoreNullFields": "false"})


def reconciled(posts: DataFrame, snapshot: DataFrame, owners: DataFrame, outage: int = OUTAGE) -> Report:
    """posts: vendor, ord, id, url, views, likes, comments, caption, posted_at, account.
    snapshot: ord, id, views, likes, scraped_at, source.  owners: account, ord, client, valid_from, valid_to.

    Rows are grouped under the id of their URL (else their own), matched shared rows
    behind them; the first row of each vendor gives the metrics, the first of all the
    time and account.  A metric is the highest of both vendors and the last snapshot.

    Report.posts: post_id, canonical_url, status, views, likes, comments, caption,
    posted_at, account, client, raw_urls, provenance (metric, provider_a, provider_b,
    snapshot, resolved).  Shared rows whose URL was left without a match anywhere are
    'unresolved', without an id.  The ids behind a possible outage are the
    disappeared_post rows; they are counted there, not gathered into one row.
    """
    p = classified(posts)
    # three reports are made of these two, so each is worked out once
    matched = staged(matches(p), "matches")
    rows, met = _grouped(p, matched)
    cut = X.is_truncated(F.col("caption"))
    first = lambda v: F.min_by(F.struct(*METRICS), F.when(F.col("vendor") == v, F.col("place")))
    order = F.struct((~cut).alias("whole"), F.length("caption").alias("n"), (-F.col("phase")).alias("p"), (-F.col("turn.v")).alias("v"), (-F.col("turn.o")).alias("o"))
    each = rows.groupBy("post_id").agg(
        first("A").alias("a"), first("B").alias("b"), F.min_by(F.struct("posted_at", "account"), "place").alias("head"), F.max_by("caption", order).alias("caption"),
        F.min_by(X.canonical_url(X.stripped(F.col("url"))), F.when(F.col("kind") == "canonical", F.col("place"))).alias("canonical_url"),
        F.sort_array(F.collect_set("url")).alias("raw_urls"), F.sort_array(F.collect_list(F.when(cut, F.struct("place", "caption")))).alias("cuts"), F.bool_or(~cut).alias("any_whole"),
    )
    snap = snapshot.groupBy(F.col("id").alias("snap_id")).agg(F.max_by(F.struct("views", "likes"), "ord").alias("s"))
    full = staged(each.join(snap, F.col("post_id") == F.col("snap_id"), "left").drop("snap_id"), "grouped")

    source = lambda m: F.col(f"s.{m}") if m != "comments" else F.lit(None).cast("long")
    value = lambda m: X.resolved_metric(F.col(f"a.{m}"), F.col(f"b.{m}"), source(m)).cast("long")
    traced = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"a.{m}").alias("provider_a"), F.col(f"b.{m}").alias("provider_b"), source(m).alias("snapshot"), value(m).alias("resolved")) for m in METRICS])
    head = full.withColumn("posted_at", F.col("head.posted_at")).withColumn("account", F.col("head.account")).withColumn("provenance", traced)
    shown = ["post_id", "canonical_url", "status", *METRICS, "caption", "posted_at", "account", "client", "raw_urls", "provenance"]
    active = _owner(head, "post_id", "account", "posted_at", owners).select("post_id", "canonical_url", F.lit("active").alias("status"), *[value(m).alias(m) for m in METRICS], "caption", "posted_at", "account", "client", "raw_urls", "provenance")

    # a URL that stayed without a match reports every shared row that has it
    lost = met.where("candidate is null")
    again = met.join(lost.select("url").distinct(), "url", "left_semi").withColumn("row", F.struct("vendor", "ord"))
    none = lambda kind: F.lit(None).cast(kind)
    nothing = F.array().cast(active.schema["provenance"].dataType)
    unresolved = _owner(again, "row", "account", "posted_at", owners).select(none("string").alias("post_id"), none("string").alias("canonical_url"), F.lit("unresolved").alias("status"), *METRICS, "caption", "posted_at", "account", "client", F.array("url").alias("raw_urls"), nothing.alias("provenance"))
    gone = missing(p, snapshot, matched)
    absent = gone.select(
        F.col("id").alias("post_id"), none("string").alias("canonical_url"), F.lit("missing").alias("status"), "views", "likes", F.lit(0).cast("long").alias("comments"), F.lit("").alias("caption"),
        F.col("scraped_at").alias("posted_at"), F.lit("").alias("account"), F.lit("unknown").alias("client"), F.array().cast("array<string>").alias("raw_urls"), nothing.alias("provenance"),
    )

    facts = head.select("post_id", F.inline("provenance"))
    conflict = facts.where("provider_a <> provider_b").select(F.lit("metric_conflict").alias("kind"), "post_id", _detail(metric=F.col("metric"), provider_a=F.col("provider_a"), provider_b=F.col("provider_b"), resolved_value=F.col("resolved")).alias("details"))
    side = facts.where("snapshot is not null").select("post_id", "metric", "snapshot", "resolved", F.inline(F.array(*[F.struct(F.lit(s).alias("source"), F.col(s).alias("v")) for s in SOURCES.values()])))
    drop = side.where("v < snapshot").select(F.lit("view_decrease").alias("kind"), "post_id", _detail(metric=F.col("metric"), source=F.col("source"), current_value=F.col("v"), snapshot_value=F.col("snapshot"), resolved_value=F.col("resolved")).alias("details"))
    caption = full.where("size(cuts) > 0 and any_whole").select(F.lit("caption_truncation_match").alias("kind"), "post_id", _detail(truncated_captions=F.col("cuts.caption"), full_caption=F.col("caption")).alias("details"))
    told = F.when(F.col("candidate").isNotNull(), _detail(share_url=F.col("url"), matched_video_id=F.col("candidate"), matching_signals=F.array(*[F.lit(x) for x in ("account", "timestamp", "caption_similarity")]))).otherwise(_detail(share_url=F.col("url"), account=F.col("account")))
    share = met.select(F.lit("unresolved_share_url").alias("kind"), F.col("candidate").alias("post_id"), told.alias("details"))
    vanished = gone.select(F.lit("disappeared_post").alias("kind"), F.col("id").alias("post_id"), _detail(last_views=F.col("views"), last_likes=F.col("likes"), last_scraped_at=F.date_format("scraped_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), last_source=F.col("source")).alias("details"))
    out = gone.agg(F.count("*").alias("n")).where(F.col("n") >= outage).select(F.lit("possible_outage").alias("kind"), none("string").alias("post_id"), _detail(missing=F.col("n")).alias("details"))
    anomalies = conflict
    for more in (drop, caption, share, vanished, out):
        anomalies = anomalies.unionByName(more)
    return Report(active.unionByName(unresolved).unionByName(absent).select(*shown), anomalies, lost.select("url"))
