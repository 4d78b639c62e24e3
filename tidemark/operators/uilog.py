"""Recorded screens and state logs: transition audit and screen scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Which state may follow which.
TRANSITIONS = {
    "unknown": ["home_feed", "profile", "upload", "popup", "error"],
    "home_feed": ["profile", "upload", "popup", "error"],
    "profile": ["home_feed", "upload", "popup", "error"],
    "upload": ["home_feed", "caption_editor", "popup", "error"],
    "caption_editor": ["upload", "posting", "popup", "error"],
    "posting": ["post_complete", "error", "popup"],
    "post_complete": ["home_feed", "profile", "popup", "error"],
    "popup": ["home_feed", "profile", "upload", "caption_editor", "posting", "post_complete", "popup", "error", "unknown"],
    "error": ["home_feed", "unknown"],
}

LOG = T.StructType([T.StructField(n, T.StringType()) for n in ("timestamp", "level", "logger", "message", "exception", "device_id", "action", "target_state", "result")])


def previous(states: DataFrame) -> DataFrame:
    return states.withColumn("was", F.lag("state").over(W.partitionBy("session").orderBy("ord")))


def allowed(was: Column, state: Column, table: dict[str, list[str]] = TRANSITIONS) -> Column:
    """Whether the table has the move; it is part of the expression, so nothing is joined."""
    out = F.lit(False)
    for a, to in table.items():
        out = F.when(was == a, state.isin(*to)).otherwise(out)
    return out


def audit(states: DataFrame, table: dict[str, list[str]] = TRANSITIONS) -> DataFrame:
    """Each move with whether it is allowed; disallowed moves still count as made."""
    moves = previous(states).where(F.col("was").isNotNull())
    return moves.select("session", "ord", "was", "state", F.coalesce(allowed(F.col("was"), F.col("state"), table), F.lit(False)).alias("valid"))


def parsed_log(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.select(F.from_json(column, LOG).alias("r")).select("r.*")


NODE = "screen string, nth int, text string, resource_id string, content_desc string, class string, bounds string"


def _nodes(batches):
    import xml.etree.ElementTree as ET

    import pyarrow as pa

    names = ("text", "resource-id", "content-desc", "class", "bounds")
    for batch in batches:
        rows: dict[str, list] = {c.split()[0]: [] for c in NODE.split(", ")}
        for screen, xml in zip(batch.column("screen").to_pylist(), batch.column("xml").to_pylist()):
            try:
                found = ET.fromstring(xml or "").iter("node")
            except ET.ParseError:
                continue
            for n, node in enumerate(found):
                for c, v in zip(rows, (screen, n, *(node.get(a, "") for a in names))):
                    rows[c].append(v)
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([(c, pa.int32() if c == "nth" else pa.string()) for c in rows]))


def nodes(screens: DataFrame) -> DataFrame:
    """One row for each node of screen dumps (screen, xml); a dump that isn't XML has none."""
    return screens.select("screen", "xml").mapInArrow(_nodes, NODE)


class NodeTable:
    """The nodes of one screen dump as a table function: nth, text, resource_id, content_desc, class, bounds."""

    def eval(self, xml: str):
        import xml.etree.ElementTree as ET

        try:
            found = ET.fromstring(xml or "").iter("node")
        except ET.ParseError:
            return
        for n, node in enumerate(found):
            yield (n, *(node.get(a, "") for a in ("text", "resource-id", "content-desc", "class", "bounds")))


def register(spark: SparkSession, name: str = "ui_nodes") -> None:
    """Makes the nodes of a dump usable in SQL: select ... from screens, lateral ui_nodes(xml)."""
    spark.udtf.register(name, F.udtf(NodeTable, returnType=NODE.removeprefix("screen string, ")))


#: state, rank (order among ties), group, attribute, pattern.
Sign = tuple[str, int, int, str, str]


def scored(screens: DataFrame, signatures: list[Sign]) -> DataFrame:
    """screen, state: the state with the most matching groups; a popup wins over all, none is unknown.

    A group of signatures matches where one node meets all its pairs of attribute and
    pattern; attributes are text, resource_id, content_desc and class.  The patterns are
    literals of one aggregation by screen.
    """
    groups: dict[tuple[str, int, int], list[Sign]] = {}
    for s in signatures:
        groups.setdefault(s[:3], []).append(s)
    met = [reduce(lambda a, b: a & b, (F.col(attribute).rlike(pattern) for *_, attribute, pattern in pairs)) for pairs in groups.values()]
    if not met:
        return screens.select("screen", F.lit("unknown").alias("state")).distinct()
    seen = nodes(screens).groupBy("screen").agg(*[F.bool_or(m).alias(f"g{i}") for i, m in enumerate(met)])
    votes = []
    for state, rank in dict.fromkeys(k[:2] for k in groups):
        n = reduce(lambda a, b: a + b, (F.col(f"g{i}").cast("int") for i, k in enumerate(groups) if k[:2] == (state, rank)))
        votes.append(F.struct((F.lit(state == "popup") & (n > 0)).alias("first"), n.alias("n"), F.lit(-rank).alias("rank"), F.lit(state).alias("state")))
    best = F.array_max(F.filter(F.array(*votes), lambda v: v["n"] > 0))["state"]
    return screens.select("screen").distinct().join(seen.select("screen", best.alias("state")), "screen", "left").select("screen", F.coalesce("state", F.lit("unknown")).alias("state"))
