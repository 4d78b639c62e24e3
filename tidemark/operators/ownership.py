"""Histories of owners: many changes merged at once, and what may never change in a history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.staging import staged

KEY = ("account_id", "client_id")


def _judged(ownership: DataFrame, changes: DataFrame) -> DataFrame:
    """One row for each account and time that changes name, with why they are refused, if they are."""
    opened = F.col("valid_to").isNull()
    now = ownership.groupBy("account_id").agg(
        F.max(F.when(opened, F.col("valid_from"))).alias("open_from"), F.max_by("client_id", F.when(opened, F.col("valid_from"))).alias("holder"), F.max("valid_to").alias("ended"),
    )
    told = changes.where(F.col("account_id").isNotNull() & F.col("client_id").isNotNull() & F.col("at").isNotNull())
    each = told.groupBy("account_id", "at").agg(F.min("client_id").alias("client_id"), F.max("client_id").alias("other"))
    late = (F.col("at") <= F.col("open_from")) | (F.col("open_from").isNull() & (F.col("at") < F.col("ended")))
    reason = F.when(F.coalesce(late, F.lit(False)), "late").when(F.col("client_id") != F.col("other"), "contradictory")
    each = each.join(now, "account_id", "left").withColumn("reason", reason)
    # a change is compared with the last good one before it; refused ones don't count
    line = W.partitionBy("account_id", F.col("reason").isNull()).orderBy("at")
    same = F.coalesce(F.lag("client_id").over(line), F.col("holder")) == F.col("client_id")
    each = each.withColumn("reason", F.coalesce("reason", F.when(same, "unchanged")))
    return each.select("account_id", "at", "client_id", "reason")


def merged(ownership: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(timeline, refused): the history after many changes, of many accounts, at once.

    ownership: account_id, client_id, valid_from, valid_to, at most one open period an account.
    changes: account_id, client_id, at; from then on the account is the client's.  A change
    ends the period before it, so all changes of an account split its open period, and only
    that one: closed periods stay as they are.  Changes come in any order; refused are, with a
    reason and their number n:

    late            it would begin before the open period has, or inside a closed one
    contradictory   changes of one account and time that name different clients; all of them
    repeated        equal changes; all but one
    unchanged       the account is the client's already
    incomplete      a null account, client or time
    """
    judged = staged(_judged(ownership, changes), "changes")
    good = judged.where("reason is null")
    following = F.lead("at").over(W.partitionBy("account_id").orderBy("at"))
    begun = good.select("account_id", "client_id", F.col("at").alias("valid_from"), following.alias("valid_to"))
    first = good.groupBy("account_id").agg(F.min("at").alias("ends"))
    shown = ["account_id", "client_id", "valid_from", "valid_to"]
    kept = ownership.select(*shown).join(first, "account_id", "left").withColumn("valid_to", F.when(F.col("valid_to").isNull(), F.col("ends")).otherwise(F.col("valid_to")))
    timeline = kept.select(*shown).unionByName(begun)

    rows = changes.groupBy("account_id", "client_id", "at").agg(F.count("*").alias("n"))
    why = judged.select("account_id", "at", F.col("client_id").alias("least"), "reason", F.lit(True).alias("told"))
    said = rows.join(why, ["account_id", "at"], "left").withColumn("reason", F.when(F.col("told").isNull() | F.col("client_id").isNull(), "incomplete").otherwise(F.col("reason")))
    # one of equal changes is good, or unchanged; the others repeat it
    one = F.col("reason").isNull() | (F.col("reason") == "unchanged")
    parts = F.array(F.struct(F.col("reason").alias("why"), F.when(one, 1).otherwise(F.col("n")).cast("long").alias("times")), F.struct(F.lit("repeated").alias("why"), F.when(one, F.col("n") - 1).otherwise(0).cast("long").alias("times")))
    told = said.select("account_id", "client_id", "at", F.inline(parts)).where("why is not null and times > 0")
    return timeline, told.select("account_id", "client_id", "at", F.col("why").alias("reason"), F.col("times").alias("n"))


def broken_history(before: DataFrame, after: DataFrame) -> DataFrame:
    """Periods of ``before`` that ``after`` lost or altered: closed ones as they were, open ones but for their end.

    Empty for any history that only grows and closes; repeated rows are counted.
    """
    begins, shown = ["account_id", "client_id", "valid_from"], ["account_id", "client_id", "valid_from", "valid_to"]
    closed = before.where("valid_to is not null").select(*shown).exceptAll(after.select(*shown))
    opened = before.where("valid_to is null").select(*begins).exceptAll(after.select(*begins))
    return closed.withColumn("rule", F.lit("closed_period_altered")).unionByName(opened.withColumn("valid_to", F.lit(None).cast(after.schema["valid_to"].dataType)).withColumn("rule", F.lit("open_period_lost")).select(*shown, "rule"))
