"""Values carried along an order, and joins of rows with the periods that hold their time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.staging import staged

#: A key with more periods than this is merged with its rows by time instead of paired with them.
FEW = 64


def carried(df: DataFrame, by: str, order: list[Column], values: dict[str, tuple[str, str]], strict: bool = False) -> DataFrame:
    """The rows with what their key has seen so far: for each new column (of, how), how being
    the last value that isn't null, or the max; without the row itself if strict.

    Rows are range-partitioned by key and order, so one key may fill many partitions; rows of
    equal key and order come to one partition, in any order.  Partitions are staged, each row is
    served within its own, and a key that goes on in the next partition takes its value along:
    that is two rows a partition at most, which are broadcast.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frozen = staged(df.repartitionByRange(parts, by, *order).withColumn("part", F.spark_partition_id()), "by-time")
    here = W.partitionBy("part", by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if strict else 0)
    parts_before = W.partitionBy(by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])

    def of_part(of: str, how: str) -> Column:
        return F.max(of) if how == "max" else F.max_by(of, F.when(F.col(of).isNotNull(), at))

    def seen(column: Column | str, how: str, window) -> Column:
        return F.max(column).over(window) if how == "max" else F.last(column, ignorenulls=True).over(window)

    # keys that lie in several partitions are the first or last of each of them
    held = frozen.groupBy(by, "part").agg(*[of_part(of, how).alias(name) for name, (of, how) in values.items()])
    wide = held.groupBy(by).agg(F.count("*").alias("n")).where("n > 1").select(by)
    before = held.join(wide, by, "left_semi").select(by, "part", *[seen(name, how, parts_before).alias(f"before_{name}") for name, (_, how) in values.items()])
    rows = frozen.select("*", *[seen(of, how, here).alias(name) for name, (of, how) in values.items()])
    rows = rows.join(F.broadcast(before), [by, "part"], "left")
    for name, (_, how) in values.items():
        both = (name, f"before_{name}")
        rows = rows.withColumn(name, F.greatest(*both) if how == "max" else F.coalesce(*both))
    return rows.drop("part", *[f"before_{name}" for name in values])


def overlapping(periods: DataFrame, by: str = "account_id") -> DataFrame:
    """Periods [valid_from, valid_to) that begin before an earlier one of their key has ended, with
    ``until``, the latest end before them; an open end counts as the end of time.

    A sweep: periods by start with the running maximum of the ends, whatever the number of a
    key's periods.  Empty and backward periods hold no time and are left out, so are those
    without a key or start.  Of equal periods all but one are found.
    """
    forever = F.to_timestamp_ntz(F.lit("9999-12-31 23:59:59.999999"))
    real = periods.where(F.col(by).isNotNull() & F.col("valid_from").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from"))))
    ends = real.withColumn("end", F.coalesce("valid_to", forever))
    # a whole order, so that of two equal starts one comes first
    order = [F.col(c) for c in ("valid_from", "end", *[c for c in periods.columns if c not in (by, "valid_from", "valid_to")])]
    swept = carried(ends, by, order, {"until": ("end", "max")}, strict=True)
    return swept.where(F.col("until") > F.col("valid_from")).select(*periods.columns, "until")


def holding(rows: DataFrame, periods: DataFrame, by: str, at: str, how: str = "inner", few: int = FEW) -> DataFrame:
    """Rows with every period of their key that holds their time; [valid_from, valid_to), an open end is null.

    periods: the key under the same name, valid_from, valid_to and other columns, which must not
    be called as columns of the rows; the result has the rows' columns and those.  A row in
    a gap, without a key or without a time is dropped, or kept with nulls if ``how`` is left.

    Keys of up to ``few`` periods are joined by the key with the interval as residual.  Keys
    of more would pair all their rows with all their periods: rows and period starts are
    merged in order of time, and each row takes the last start before it.  That needs
    periods without overlaps, as a history of owners has; a key that breaks this rule is joined
    by its key after all.
    """
    own = [c for c in periods.columns if c not in (by, "valid_from", "valid_to")]
    shown = [*rows.columns, *own]
    # F.col of a bare name stays ambiguous where rows and periods share ancestors, so the key is renamed
    p = periods.withColumnRenamed(by, "period_key")

    def paired(some: DataFrame, spans: DataFrame) -> DataFrame:
        inside = (F.col(by) == F.col("period_key")) & (F.col(at) >= F.col("valid_from")) & ((F.col(at) < F.col("valid_to")) | F.col("valid_to").isNull())
        return some.join(spans, inside, how).select(*shown)

    many = p.groupBy("period_key").agg(F.count("*").alias("periods")).where(F.col("periods") > few).select(F.col("period_key").alias("long_key"))
    if many.isEmpty():
        return paired(rows, p)
    many = staged(many, "long-histories")
    of = lambda df, key, kind: df.join(many, F.col(key) == F.col("long_key"), kind)
    spans = staged(of(p, "period_key", "left_semi"), "periods")
    clash = staged(overlapping(spans, "period_key").select("period_key").distinct().withColumnRenamed("period_key", "clash_key"), "overlaps")
    apart = lambda df, key, kind: df.join(clash, F.col(key) == F.col("clash_key"), kind)
    mine = of(rows, by, "left_semi")
    merged = _merged(apart(mine, by, "left_anti"), apart(spans, "period_key", "left_anti"), by, at, own, how)
    rest = paired(of(rows, by, "left_anti"), of(p, "period_key", "left_anti"))
    return rest.unionByName(merged).unionByName(paired(apart(mine, by, "left_semi"), apart(spans, "period_key", "left_semi")))


def _merged(rows: DataFrame, spans: DataFrame, by: str, at: str, own: list[str], how: str) -> DataFrame:
    """Rows and period starts in one order; a start comes before rows of its own time."""
    starts = spans.where(F.col("valid_from").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from"))))
    starts = starts.select(F.col("period_key").alias("merge_key"), F.col("valid_from").alias("merge_at"), F.lit(0).alias("kind"), F.struct("valid_to", *own).alias("period"))
    timed = rows.select(F.col(by).alias("merge_key"), F.col(at).alias("merge_at"), F.lit(1).alias("kind"), F.struct(*rows.columns).alias("row"))
    both = starts.unionByName(timed, allowMissingColumns=True)
    last = carried(both, "merge_key", [F.col("merge_at"), F.col("kind")], {"now": ("period", "last")}).where("kind = 1")
    covers = F.col("now.valid_to").isNull() | (F.col("merge_at") < F.col("now.valid_to"))
    now = F.when(F.col("merge_at").isNotNull() & covers, F.col("now"))
    kept = last.withColumn("now", now)
    kept = kept if how == "left" else kept.where("now is not null")
    return kept.select("row.*", *[F.col(f"now.{c}").alias(c) for c in own])
