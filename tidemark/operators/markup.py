"""Elements of markup as a table function over a table, and a vote over them.

    register(spark)
    select * from page_elements(table(select page_id as page, html from pages) partition by page)

Both work on Arrow batches: a task parses the pages of its partitions, one after the other.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from tidemark.functions import text as X
from tidemark.operators.uilog import nodes

ELEMENT = "page long, nth int, depth int, tag string, id string, class string, href string, text string"


class PageElements:
    """The start tags of each page (page, html) in their order, with the text right behind them.

    Broken markup is read as far as it goes: an end tag closes the nearest open element of
    its name, one without a start is passed over, and elements that are never closed end
    with the page.  Scripts and styles hold no elements.
    """

    def eval(self, batch):
        import pyarrow as pa

        for part in batch.to_batches() if hasattr(batch, "to_batches") else [batch]:
            rows: list[tuple] = []
            for page, html in zip(part.column("page").to_pylist(), part.column("html").to_pylist()):
                rows += [(page, *x) for x in elements(html or "")]
            names = [c.split()[0] for c in ELEMENT.split(", ")]
            kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
            yield pa.table({n: pa.array([r[i] for r in rows], kinds[c.split()[1]]) for i, (n, c) in enumerate(zip(names, ELEMENT.split(", ")))})


def elements(html: str) -> list[tuple]:
    """(nth, depth, tag, id, class, href, text) of each start tag."""
    from html.parser import HTMLParser

    # fixed values: elements that hold nothing
    void = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
    found: list[list] = []
    open_: list[str] = []

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            named = dict(reversed(attrs))  # the first of equal names counts
            found.append([len(found), len(open_), tag, *(named.get(a) or "" for a in ("id", "class", "href")), ""])
            if tag not in void:
                open_.append(tag)
            self.fresh = True

        def handle_startendtag(self, tag, attrs):
            self.handle_starttag(tag, attrs)
            if tag not in void:
                open_.pop()

        def handle_endtag(self, tag):
            if tag in open_:
                del open_[len(open_) - 1 - open_[::-1].index(tag) :]
            self.fresh = False

        def handle_data(self, data):
            if found and getattr(self, "fresh", False):
                found[-1][-1] += data

    reader = Reader(convert_charrefs=True)
    reader.feed(html)
    reader.close()
    return [tuple(x) for x in found]


def _vote(states: pa.Array, ranks: pa.Array) -> str:
    """The state that most rows name; the least rank wins a tie, a popup over all, none is unknown."""
    rows = pa.table({"state": states, "rank": ranks}).filter(pc.is_valid(states))
    if not len(rows):
        return "unknown"
    counted = rows.group_by("state").aggregate([("state", "count"), ("rank", "min")]).to_pylist()
    best = min(counted, key=lambda r: (r["state"] != "popup", -r["state_count"], r["rank_min"], r["state"]))
    return best["state"]


def vote():
    """A grouped aggregate of (state, rank): see ``_vote``."""
    return F.arrow_udf(_vote, "string", ArrowUDFType.GROUPED_AGG)


def register(spark: SparkSession) -> None:
    """Makes ``page_elements`` and ``screen_vote`` usable in SQL."""
    spark.udtf.register("page_elements", F.arrow_udtf(PageElements, returnType=ELEMENT))
    spark.udf.register("screen_vote", vote())


def page_states(pages: DataFrame, signs: list[tuple[str, str, str]]) -> DataFrame:
    """page, state, votes: the state that most elements of a page speak for.

    signs: state, attribute (tag, id, class, href or text) and pattern; an element that meets
    several signs votes for each.  Ties go to the state that is listed first.
    """
    register(pages.sparkSession)
    cases = [F.when(F.col(attribute).rlike(pattern), F.struct(F.lit(state).alias("state"), F.lit(i).alias("rank"))) for i, (state, attribute, pattern) in enumerate(signs)]
    found = pages.sparkSession.sql("select * from page_elements(table({pages}) partition by page)", pages=pages.select("page", "html"))
    votes = found.select("page", F.explode(F.filter(F.array(*cases), lambda c: c.isNotNull())).alias("v")).select("page", "v.*")
    per = votes.groupBy("page").agg(vote()("state", "rank").alias("state"))
    n = votes.groupBy("page", "state").agg(F.count("*").alias("votes"))
    best = per.join(n, ["page", "state"], "left")
    return pages.select("page").distinct().join(best, "page", "left").select("page", F.coalesce("state", F.lit("unknown")).alias("state"), F.coalesce("votes", F.lit(0).cast("long")).alias("votes"))


def element_places(screens: DataFrame, attribute: str, pattern: str, width: Column, height: Column) -> DataFrame:
    """screen, x, y: the centre, in shares of the screen, of the first node of each dump whose attribute matches.

    screens: screen, xml and what width and height are made of.  The pattern is found anywhere,
    in any case; a node without bounds is passed over, and so is a dump without such a node.
    """
    at = X.bounds_centre(F.col("bounds"), F.lit(1), F.lit(1))
    met = nodes(screens).where(F.col(attribute).rlike(f"(?i){pattern}")).select("screen", "nth", at.alias("at")).where("at is not null")
    first = met.groupBy("screen").agg(F.min_by("at", "nth").alias("at"))
    sizes = screens.groupBy("screen").agg(F.first(width).alias("w"), F.first(height).alias("h"))
    return first.join(sizes, "screen").select("screen", (F.col("at.x") / F.col("w")).alias("x"), (F.col("at.y") / F.col("h")).alias("y"))
