"""Line dedup: repeated runs of lines by distributed prefix doubling.

Lines become numbers, documents become sequences of them.  As in suffix-array
construction by prefix doubling, round r names the run of 2**r lines that starts
at each position, from the names of its two halves.  A name is the first place at
which that run occurs, so names need no global ranking, and the positions of equal
name are the interval of the suffix order whose common prefix is 2**r lines or longer.
Positions whose run occurs once leave the rounds at once: no repeated run starts there.
A position is a later copy at depth 2**r if its interval's first place is an earlier one.

Where a document's deepest such round is, the interval is narrowed bit by bit: the run of
2**r + x lines is known by two names of round r, x apart, and the positions that share
both are the interval of that depth.  The last depth whose interval still holds an
earlier place is the exact length of the longest run that starts there and earlier, too.
Elsewhere runs of 2**r lines, one from each position, cover the same lines as the exact
ones.  Overlapping runs are joined into maximal ones; their lines are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.columns import WORD, fresh
from tidemark.llm.ordering import hot_join
from tidemark.llm.recurrence import NO_ID
from tidemark.llm.sizing import stage

#: A single line is a run if it has this many words; two lines or more always are.
LEAST_WORDS = 5
MOST_ROUNDS = 40


def _place(doc: str, tie: str, nth: str) -> Column:
    return F.struct(F.col(doc).alias("d"), F.col(tie).alias("t"), F.col(nth).alias("n"))


def sequences(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """d, t, n, id, id2, alone: one row for each line with a word.

    d: doc_id (null as the largest long); t: hash of the text, which tells rows of
    equal doc_id apart; n: number among lines with a word; alone: whether the line has
    the words to be a run by itself.
    """
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("d"), F.xxhash64("text").alias("t"), F.split("text", "\n").alias("lines"))
    rows = own.select("d", "t", F.posexplode(F.filter("lines", lambda x: x.rlike(WORD))).alias("n", "line"))
    # words are tried from their beginning only and taken whole, so a very long one is read once
    word, gap = WORD.removesuffix("+"), r"[\x20\x09-\x0D]++"
    enough = rf"(?<!{word}){word}++(?:{gap}{word}++){{{max(0, least_words - 1)}}}"
    return rows.select("d", "t", "n", F.xxhash64("line").alias("id"), F.xxhash64(F.lit(7), "line").alias("id2"), F.col("line").rlike(enough).alias("alone")).distinct()


def named_levels(seq: DataFrame) -> list[DataFrame]:
    """d, t, n, name for each round (and alone for the first): positions whose run of 2**r lines repeats.

    Lines are counted before they are joined, and the rows of a very common one stay where
    they are.
    """
    place = _place("d", "t", "n")
    lines = seq.groupBy("id", "id2").agg(F.min(place).alias("name"), F.count("*").alias("c")).where("c > 1")
    level = hot_join(seq, stage(lines, "names"), ["id", "id2"], "c", seq.count()).select("d", "t", "n", "alone", "name")
    levels = []
    for r in range(MOST_ROUNDS + 1):
        level = stage(level, f"runs-{r}")
        if level.isEmpty():
            break
        if r == MOST_ROUNDS:
            raise RuntimeError("runs did not end")
        levels.append(level)
        # the run of 2 ** (r + 1) lines at a place: names of its halves
        half = level.select("d", "t", (F.col("n") - (1 << r)).alias("n"), F.col("name").alias("then"))
        pair = level.select("d", "t", "n", "name").join(half, ["d", "t", "n"])
        first = pair.groupBy("name", "then").agg(F.min(place).alias("fore"), F.count("*").alias("c")).where("c > 1").drop("c")
        level = pair.join(first, ["name", "then"]).select("d", "t", "n", F.col("fore").alias("name"))
    return levels


def repeated_runs(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """d, t, n, run, exact: the positions where a run starts that also starts earlier, and its length in lines.

    The length is that of the longest such run where ``exact``, which every document's longest
    runs are; elsewhere its greatest power of two.
    """
    levels = named_levels(stage(sequences(docs, least_words), "lines"))
    if not levels:
        empty = docs.sparkSession.range(0)
        return empty.select(F.col("id").alias("d"), F.col("id").alias("t"), F.col("id").cast("int").alias("n"), F.col("id").alias("run"), F.lit(True).alias("exact"))
    place = _place("d", "t", "n")
    every = None
    for r, x in enumerate(levels):
        part = x.select(F.lit(r).alias("r"), "d", "t", "n", "name", F.col("alone") if r == 0 else F.lit(True).alias("alone"))
        every = part if every is None else every.unionByName(part)
    every = stage(every, "levels")  # one table for the many plans below
    # the deepest round at which a position is a later copy; a lone line needs enough words
    later = every.where((F.col("name") < place) & F.col("alone"))
    found = later.groupBy("d", "t", "n").agg(F.max_by("name", "r").alias("name"), F.max("r").alias("r"))
    found = found.withColumn("exact", F.col("r") == F.max("r").over(W.partitionBy("d", "t")))  # one document's lines
    found = stage(found.select("d", "t", "n", "r", "name", F.lit(0).alias("x"), "exact"), "copies")
    done = found.where("exact").drop("exact")
    top = done.agg(F.max("r")).first()[0]
    for bit in range((top or 0) - 1, -1, -1):
        # deeper by 2 ** bit: that many more lines are asked for wherever the round allows
        deep = every.where(F.col("r") > bit).select("r", "name", "d", "t", "n")
        asked = done.where(F.col("r") > bit).select("r", "name", (F.col("x") + (1 << bit)).alias("x")).distinct()
        far = deep.select("r", "d", "t", F.col("n").alias("at"), F.col("name").alias("then"))
        members = stage(deep.join(asked, ["r", "name"]).withColumn("at", F.col("n") + F.col("x")).join(far, ["r", "d", "t", "at"]).drop("at"), f"members-{bit}")
        # a run that very many documents have is counted before it is joined
        keys = ["r", "name", "x", "then"]
        first = members.groupBy(*keys).agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
        deeper = members.join(first, keys).where(F.col("first") < place).select("d", "t", "n", "r", F.col("x").alias("more"))
        grown = done.withColumn("more", F.col("x") + (1 << bit)).join(deeper.withColumn("hit", F.lit(True)), ["d", "t", "n", "r", "more"], "left")
        done = stage(grown.select("d", "t", "n", "r", "name", F.when(F.col("hit"), F.col("more")).otherwise(F.col("x")).alias("x")), f"depths-{bit}")
    rest = found.where("not exact").drop("exact")
    return done.withColumn("exact", F.lit(True)).unionByName(rest.withColumn("exact", F.lit(False))).select("d", "t", "n", (F.expr("shiftleft(1L, r)") + F.col("x")).alias("run"), "exact")


def deleted_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """d, t, gone (numbers among lines with a word), longest: one row for each document that loses lines.

    Only maximal runs count: a run that reaches no further than those before it adds nothing.
    """
    runs = repeated_runs(docs, least_words).withColumn("end", F.col("n") + F.col("run"))
    before = W.partitionBy("d", "t").orderBy("n").rowsBetween(W.unboundedPreceding, -1)  # one document's lines
    maximal = runs.withColumn("reached", F.max("end").over(before)).where("reached is null or end > reached")
    # a run begins where the last one ended, if they overlap
    each = maximal.select("d", "t", F.explode(F.sequence(F.greatest("n", F.coalesce("reached", "n")), F.col("end") - 1)).alias("n"), "run")
    return each.groupBy("d", "t").agg(F.collect_list(F.col("n").cast("int")).alias("gone"), F.max("run").alias("longest"))


def _cut_texts(text: str, gone: str, count: str):
    """Deletes lines from packed batches; ``gone`` holds numbers among the lines with a word."""
    import re

    solid = re.compile(WORD)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, counts = batch.column(text).to_pylist(), []
            for i, numbers in enumerate(batch.column(gone).to_pylist()):
                if not numbers:
                    counts.append(0)
                    continue
                numbers, n, kept = set(numbers), 0, []
                for line in texts[i].split("\n"):
                    if solid.search(line):
                        n += 1
                        if n - 1 in numbers:
                            continue
                    kept.append(line)
                texts[i] = "\n".join(kept)
                counts.append(len(numbers))
            columns = {c: batch.column(c) for c in batch.schema.names if c != gone}
            columns[text] = pa.array(texts, batch.schema.field(text).type)
            yield pa.RecordBatch.from_pydict(columns | {count: pa.array(counts, pa.int64())})

    return run


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> tuple[DataFrame, str, str]:
    """The frame with repeated line runs deleted from ``text``; names of two added columns.

    A run is consecutive lines with a word, within one text: two lines or more, or
    one line of at least ``least_words`` words.  A line goes if a run that covers it
    also starts earlier: in a document of smaller doc_id, or earlier in the same one.
    Lines without a word stay and do not part a run.  A null text stays null; an empty
    one is unchanged.  Rows of equal doc_id come in order of a hash of their text;
    equal rows are one document, cut alike.  A null doc_id comes last.  A very long text is
    cut whole.  An empty table stays empty.  Other columns are unchanged, whatever their
    names.  The added columns: lines deleted, and the longest run of lines that also
    starts at one earlier place (null if none).
    """
    d, t, g, count, reach = (fresh(docs, x) for x in ("doc", "tie", "gone", "lines_cut", "longest_run"))
    gone = deleted_lines(docs, least_words).select(F.col("d").alias(d), F.col("t").alias(t), F.col("gone").alias(g), F.col("longest").alias(reach))
    own = docs.withColumn(d, F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID)))).withColumn(t, F.xxhash64("text"))
    joined = own.join(gone, [d, t], "left").select(*[F.col(f"`{c}`") for c in docs.columns], g, reach)
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema.fields if f.name != g} | {count: "bigint"}
    return joined.mapInArrow(_cut_texts("text", g, count), ", ".join(f"`{c}` {k}" for c, k in kinds.items())), count, reach


#: Every pair of equal lines, chained along its diagonal: a chain's rest is the length of the run that both places start.
ORACLE = r"""
with lines as (
    select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) pos
    from documents where text is not null),
solid as (
    select doc_id, pos, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) words, line,
           row_number() over (partition by doc_id order by pos) - 1 n
    from lines where regexp_matches(line, '[^\x20\x09-\x0D]')),
pairs as (
    select a.doc_id d, a.n, a.words, b.doc_id e, a.n - b.n diagonal from solid a join solid b on a.line = b.line
    and (b.doc_id < a.doc_id or (b.doc_id = a.doc_id and b.n < a.n))),
chains as (select *, n - row_number() over (partition by d, e, diagonal order by n) chain from pairs),
runs as (select d doc_id, n, words, max(n) over (partition by d, e, diagonal, chain) - n + 1 run from chains),
longest as (select doc_id, n, max(run) run from runs where run > 1 or words >= 5 group by doc_id, n),
gone as (select distinct doc_id, unnest(range(n, n + run)) n from longest),
counts as (select doc_id, count(*) c from gone group by doc_id),
reach as (select doc_id, max(run) run from longest group by doc_id),
kept as (
    select l.doc_id, string_agg(l.line, chr(10) order by l.pos) body
    from lines l left join solid s using (doc_id, pos) left join gone g on g.doc_id = s.doc_id and g.n = s.n
    where g.n is null group by l.doc_id)
select d.doc_id, cast(coalesce(c, 0) as bigint) n_removed, cast(coalesce(run, 0) as bigint) longest_run,
       cast(length(coalesce(body, '')) as bigint) n_chars_kept, sha256(coalesce(body, '')) kept_sha256
from documents d left join kept using (doc_id) left join counts using (doc_id) left join reach using (doc_id)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_removed, longest_run, n_chars_kept, kept_sha256 for every document."""
    out, count, reach = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id", F.col(count).alias("n_removed"), F.coalesce(F.col(reach), F.lit(0)).cast("long").alias("longest_run"),
        F.length(text).cast("long").alias("n_chars_kept"), F.sha2(text, 256).alias("kept_sha256"),
    )
