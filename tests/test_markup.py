"""Elements of pages as a table function, the vote over them, and places on a screen."""

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.operators import markup

PAGES = [
    (1, '<html><body class="x"><p id="a">One <b>two</b> three<p>Four<br>five</body></html>'),
    (2, '<ul><li>a<li><a HREF="/x&amp;y" href="/second">b</a></ul></nope><script>var t = "<p>";</script><!-- <p> --><div/>after'),
    (3, ""), (4, None), (5, "no markup < at all & so on"), (6, "<p" ), (7, "<div>" * 3000), (8, "<p>" + "word " * 200_000 + "</p>"),
]


def test_elements():
    assert markup.elements(PAGES[0][1]) == [(0, 0, "html", "", "", "", ""), (1, 1, "body", "", "x", "", ""), (2, 2, "p", "a", "", "", "One "), (3, 3, "b", "", "", "", "two"), (4, 3, "p", "", "", "", "Four"), (5, 4, "br", "", "", "", "five")]
    got = markup.elements(PAGES[1][1])
    assert [(x[1], x[2], x[5], x[6]) for x in got] == [(0, "ul", "", ""), (1, "li", "", "a"), (2, "li", "", ""), (3, "a", "/x&y", "b"), (0, "script", "", 'var t = "<p>";'), (0, "div", "", "after")]
    assert markup.elements("") == markup.elements("no markup < at all & so on") == [] and len(markup.elements(PAGES[6][1])) == 3000


def test_table_function_in_sql(spark):
    markup.register(spark)
    pages = spark.createDataFrame(PAGES, "page long, html string").repartition(3)
    rows = spark.sql("select * from page_elements(table(select page, html from {pages}) partition by page)", pages=pages).collect()
    got = sorted(tuple(r) for r in rows)
    assert got == sorted((i, *x) for i, html in PAGES for x in markup.elements(html or ""))
    none = spark.sql("select * from page_elements(table(select page, html from {pages}) partition by page)", pages=pages.limit(0))
    assert none.collect() == [] and none.columns == [c.split()[0] for c in markup.ELEMENT.split(", ")]


def test_vote(spark):
    v = lambda *rows: markup._vote(pa.array([s for s, _ in rows], pa.string()), pa.array([r for _, r in rows], pa.int32()))
    assert v() == v((None, 1)) == "unknown"
    assert v(("a", 1), ("b", 0), ("a", 1)) == "a" and v(("a", 1), ("b", 0)) == "b" and v(("a", 1), ("a", 1), ("popup", 9)) == "popup"
    markup.register(spark)
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 0), (1, "a", 1), (2, None, 0), (3, "c", 0)], "k int, state string, rank int")
    assert {r.k: r.v for r in spark.sql("select k, screen_vote(state, rank) v from {df} group by k", df=df).collect()} == {1: "a", 2: "unknown", 3: "c"}


def test_page_states(spark):
    pages = spark.createDataFrame(PAGES[:5] + [(9, '<a href="/the">x</a><a href="/la">y</a>')], "page long, html string")
    signs = [("list", "tag", "^li$"), ("text", "tag", "^p$"), ("text", "id", "^a$"), ("x", "href", "^/la$"), ("y", "href", "^/the$")]
    assert {r.page: (r.state, r.votes) for r in markup.page_states(pages, signs).collect()} == {1: ("text", 3), 2: ("list", 2), 3: ("unknown", 0), 4: ("unknown", 0), 5: ("unknown", 0), 9: ("x", 1)}


def test_element_places(spark):
    node = '<node text="{}" bounds="{}"/>'
    dumps = [("a", "<h>" + node.format("Ok", "[0,0][10,20]") + node.format("not ok", "[0,0][100,200]") + "</h>"), ("b", "<h>" + node.format("OK", "") + node.format("ok", "[2,4][6,8]") + "</h>"), ("c", "<broken"), ("d", "<h>" + node.format("none", "[0,0][1,1]") + "</h>"), ("e", None)]
    screens = spark.createDataFrame(dumps, "screen string, xml string")
    got = {r.screen: (r.x, r.y) for r in markup.element_places(screens, "text", "ok", F.lit(100), F.lit(200)).collect()}
    assert got == {"a": (0.05, 0.05), "b": (0.04, 0.03)}
