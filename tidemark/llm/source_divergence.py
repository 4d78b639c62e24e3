"""Divergence of sources by wide term vectors.

Every kept term of a language becomes one row with an array that is indexed by the
language's sources; higher-order functions take each array apart into contributions
of pairs of sources, which are summed before and after the shuffle.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.sizing import stage

LEAST_DOCUMENTS = 3
TOP_TERMS = 200
#: Shares are parts of this many.
SCALE = 1_000_000_000
#: A task's counts leave it when it holds so many different terms.
HELD_TERMS = 800_000
#: Groups (lang, source) up to this number are broadcast with their sizes; beyond, terms are joined to them in so many slices.
MOST_BROADCAST, SLICES = 100_000, 256

#: Bytes of terms: letters of ASCII, made small, and all bytes of other characters; anything else parts terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTED = "lang string, source string, term string, n long, docs long"


def terms(text: str) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split(b" ")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of each group, summed over many documents of a task."""
    n: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), c in n.items():
            c.pop(b"", None)
            size = len(c)
            held = docs[lang, source]
            word = pa.array(list(c), pa.binary()).cast(pa.string())
            same = lambda v: pa.array([v] * size, pa.string())
            yield pa.RecordBatch.from_arrays([same(lang), same(source), word, pa.array(list(c.values()), pa.int64()), pa.array([held[t] for t in c], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        n.clear(), docs.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            found = terms(text)
            n[lang, source].update(found)
            docs[lang, source].update(set(found))
        if sum(map(len, n.values())) > HELD_TERMS:
            yield from out()
    yield from out()


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), exact for counts of any size."""
    up = count + 1
    whole = (F.lit(SCALE).cast("decimal(38,0)") * up.cast("decimal(19,0)")).cast("decimal(38,0)")
    small = F.call_function("div", F.lit(SCALE).cast("long") * up, total + kept)
    return 1 + F.when(up < (1 << 62) // SCALE, small).otherwise(F.call_function("div", whole, (total + kept).cast("decimal(38,0)")))


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term, total and entries (source, n) of each term in at least ``least`` documents of its language."""
    counted = docs.mapInArrow(_counted, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    one = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("entries"))
    return one.where(F.col("docs") >= least).drop("docs")


def _by_lang(rows: DataFrame, langs: DataFrame, groups: int) -> DataFrame:
    """The rows with what is known of their language; a language may hold most rows."""
    if groups <= MOST_BROADCAST:
        return rows.join(F.broadcast(langs), "lang")
    cut = rows.withColumn("slice", F.pmod(F.xxhash64("term"), F.lit(SLICES)).cast("int"))
    return cut.join(langs.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))), ["lang", "slice"]).drop("slice")


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """Distances between a language's sources, and the terms that set each source apart.

    Input: text, lang, source; other columns are ignored, whatever their names.  Nulls count
    as empty texts and names; every row is a document, repeated ones too.  Output: lang,
    source, part, item, value, rank.  ``pair``: every other source of the language and the
    sum of gap(p, q) over the kept terms, p and q the shares of a term in the source and the
    other one; 0 where the language keeps no term.  ``term``: the ``top`` terms that the
    source has a greater share of than its language.  Ranks go by value, ties by item.  An
    empty table gives no rows.

    A term adds to pairs of two sources that both lack it what any such term adds, so a row
    only lists pairs with a source that has it; the rest is a product.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = docs.select(empty("lang"), empty("source"), empty("text"))
    kept = stage(kept_terms(rows, least), "kept-terms")
    sizes = kept.select("lang", F.inline("entries")).groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = stage(rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").select("lang", "source", F.coalesce("size", F.lit(0)).alias("size")), "groups")
    known = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("all"))
    langs = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "size"))).alias("groups")).join(known, "lang", "left")
    langs = stage(langs.select("lang", "groups", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("all", F.lit(0)).alias("all")), "langs")
    number = groups.count()

    wide = _by_lang(kept, langs, number).withColumn("found", F.map_from_entries("entries"))
    wide = wide.withColumn("n", F.transform("groups", lambda g: F.coalesce(F.col("found")[g["source"]], F.lit(0).cast("long"))))
    wide = wide.withColumn("p", F.zip_with("n", "groups", lambda n, g: share(n, g["size"], F.col("kept"))))
    cells = F.transform("p", lambda p, i: F.struct(i.alias("i"), p.alias("p"), (F.get("n", i) == 0).alias("lacks")))

    def contribution(a: Column, b: Column) -> Column:
        return F.struct(a["i"].alias("i"), b["i"].alias("j"), gap(a["p"], b["p"]).alias("there"), F.when(b["lacks"], gap(b["p"], a["p"])).alias("back"))

    have = lambda cells: F.filter(cells, lambda c: ~c["lacks"])
    parts = wide.withColumn("cells", cells).select("lang", F.inline(F.flatten(F.transform(have("cells"), lambda a: F.transform("cells", lambda b: contribution(a, b))))))
    seen = parts.groupBy("lang", "i", "j").agg(F.sum("there").alias("there"), F.count("*").alias("times"), F.sum("back").alias("back"), F.count("back").alias("lacks")).where("i <> j")
    seen = stage(seen, "seen")  # a row for each two sources; read twice
    both = seen.select("lang", "i", "j", F.col("there").alias("value"), "times").unionByName(seen.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), F.coalesce("back", F.lit(0)).alias("value"), F.col("lacks").alias("times")))
    both = both.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"), F.sum("times").alias("times"))
    left = langs.select("lang", "kept", "groups", F.posexplode("groups").alias("i", "a")).select("lang", "kept", "i", "a", F.posexplode("groups").alias("j", "b")).where("i <> j")
    none = F.lit(0).cast("long")
    rest = F.when(F.col("kept") > 0, gap(share(none, F.col("a.size"), F.col("kept")), share(none, F.col("b.size"), F.col("kept"))) * (F.col("kept") - F.coalesce("times", none))).otherwise(none)
    pairs = left.join(both, ["lang", "i", "j"], "left").select("lang", F.col("a.source").alias("source"), F.lit("pair").alias("part"), F.col("b.source").alias("item"), (F.coalesce("value", none) + rest).alias("value"))

    q = share(F.col("total"), F.col("all"), F.col("kept"))
    each = wide.withColumn("q", q).select("lang", "term", "q", F.inline(F.arrays_zip(F.col("groups.source").alias("source"), F.col("n").alias("n"), F.col("p").alias("p"))))
    apart = each.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    first = apart.withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(first)


#: Every term of every group with its share, zero counts too.
ORACLE = r"""
with d as (select coalesce(lang, '') lang, coalesce(source, '') source, row_number() over () id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') ts from documents),
occ as (select lang, source, id, unnest(ts) term from d),
kept as (select lang, term, count(*) total from occ group by all having count(distinct id) >= 3),
langs as (select lang, count(*) v, sum(total) n from kept group by lang),
counts as (select lang, source, term, count(*) c from occ join kept using (lang, term) group by all),
grp as (select d.lang, d.source, coalesce(any_value(s.n), 0) n from (select distinct lang, source from d) d left join (select lang, source, sum(c) n from counts group by all) s using (lang, source) group by all),
p as (select g.lang, g.source, k.term, coalesce(c, 0) c, 1 + (1000000000::hugeint * (coalesce(c, 0) + 1)) // (g.n + v)::hugeint p, 1 + (1000000000::hugeint * (total + 1)) // (langs.n + v)::hugeint q
    from grp g join kept k using (lang) join langs using (lang) left join counts using (lang, source, term)),
sums as (select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p) f from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' part, b.source item, cast(coalesce(f, 0) as bigint) "value" from grp a join grp b on a.lang = b.lang and a.source <> b.source left join sums on sums.lang = a.lang and sums.source = a.source and sums.item = b.source),
terms as (select lang, source, 'term' part, term item, cast((p - q) * (p - q) // q as bigint) "value" from p where c > 0 and p > q)
select lang, source, part, item, "value", cast(row_number() over (partition by lang, source, part order by "value" desc, item) as integer) "rank" from (from pairs union all from terms)
qualify part = 'pair' or "rank" <= 200
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))
