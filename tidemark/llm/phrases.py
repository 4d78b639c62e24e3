"""Phrase collocations by vertical positional inverted lists.

Texts are read once into blocks of one language.  A block keeps, for each of its words,
the list of positions at which the word stands; borders of pieces and documents take
a position of their own, so what is adjacent by position is contiguous in a piece.
The lists of frequent phrases are extended word by word: a phrase's positions are merged
with the postings of the words that follow.  The length of a list is the phrase's exact
frequency in the block, and the lengths over all blocks are its frequency.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.packing import packed, unpacked
from tidemark.llm.sizing import stage

LEAST = 100
LONGEST = 5
TOP = 2000
#: Slices of a language's phrases that are ranked by themselves before the language is.
SLICES = 64
#: Words of one block, and of all the blocks that one task fills at a time.
BLOCK_WORDS, HELD_WORDS = 1_000_000, 2_000_000

#: Small letters for A-Z, a line break for what ends a piece, a space for a tab.
PIECE_BYTES = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\v\f\r" else 32 if b == 9 else b for b in range(256))


def tokens(text: str) -> list[bytes]:
    """The words of a text in order, with a line break at each border of a piece and, between words, empty ones."""
    return text.encode().translate(PIECE_BYTES).replace(b"\n", b" \n ").split(b" ")


BLOCK = "block long, lang string, words array<string>, n_words long, lengths binary, places binary"


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of each block: its words, the length of each one's list, and the lists."""
    nth = TaskContext.get().partitionId() << 32
    number: dict[str, dict[bytes, int]] = {}
    codes: dict[str, list[np.ndarray]] = {}
    size: dict[str, int] = {}

    def block(lang: str) -> pa.RecordBatch:
        nonlocal nth
        every = np.concatenate(codes.pop(lang))
        names = list(number.pop(lang))[2:]  # all but the empty word and the border
        size.pop(lang)
        place = np.flatnonzero(every > 1).astype(np.int32)
        word = every[place] - 2
        order = np.argsort(word, kind="stable")
        lengths = np.bincount(word, minlength=len(names))
        nth += 1
        lists = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), pa.array(names, pa.binary()).cast(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([nth]), pa.array([lang], pa.string()), lists, pa.array([len(place)]), pa.array([packed(lengths)]), pa.array([listed(place[order], lengths)])], names=["block", "lang", "words", "n_words", "lengths", "places"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if lang not in number:
                number[lang], codes[lang], size[lang] = {b"": 0, b"\n": 1}, [], 0
            known = number[lang]
            own = np.array([known.setdefault(w, len(known)) for w in tokens(text)] + [1], dtype=np.int32)
            own = own[own > 0]
            codes[lang].append(own)
            size[lang] += len(own)
            if size[lang] >= BLOCK_WORDS:
                yield block(lang)
        if sum(size.values()) >= HELD_WORDS:
            yield from [block(lang) for lang in list(size)]
    yield from [block(lang) for lang in list(size)]


def listed(places: np.ndarray, lengths: np.ndarray) -> bytes:
    """Lists of ascending positions, as steps from one position to the next."""
    step = np.diff(places, prepend=0)
    start = (np.cumsum(lengths) - lengths)[np.asarray(lengths) > 0]
    step[start] = places[start]
    return packed(step)


def unlisted(b: bytes, lengths: np.ndarray) -> np.ndarray:
    # sums may pass 32 bits, but their differences are positions again
    so_far = np.cumsum(unpacked(b), dtype=np.int32)
    start = np.cumsum(lengths) - lengths
    before = np.append(np.int32(0), so_far)[start]
    return so_far - np.repeat(before, lengths)


#: A block's lists: of the words that may follow, and of its frequent phrases of one length (null for single words: the same).
LISTS = "block long, word_ids array<long>, word_lengths binary, word_places binary, ids array<long>, lengths binary, places binary"
KINDS = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()]


def _rows(rows: list[tuple]) -> pa.Table:
    names = [c.split()[0] for c in LISTS.split(", ")]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(KINDS)], names=names)


def _chosen(lengths: np.ndarray, places: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists numbered in ``keep``, in its order."""
    start = np.cumsum(lengths) - lengths
    some = lengths[keep]
    before = np.cumsum(some) - some
    return some, places[np.repeat(start[keep] - before, some) + np.arange(int(some.sum()))]


def _word_lists(row: dict, number: np.ndarray, ids: np.ndarray) -> list[tuple]:
    """A block's postings of its frequent words, their numbers in the block and their ids given."""
    lengths = unpacked(row["lengths"]).astype(np.int64)
    some, places = _chosen(lengths, unlisted(row["places"], lengths), number)
    return [(row["block"], ids, packed(some), listed(places, some), None, None, None)] if len(ids) else []


def extended(k: int, phrase: np.ndarray, places: np.ndarray, word: np.ndarray, postings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, word behind it, position) for each occurrence of a phrase of k words with a posting right behind it.

    Both sides are merged by position; a position has one word and one phrase of k words at most.
    """
    by = np.argsort(postings, kind="stable")
    postings, word = postings[by], word[by]
    by = np.argsort(places, kind="stable")
    places, phrase = places[by], phrase[by]
    near = np.searchsorted(postings, places + k)
    hit = near < len(postings)
    hit[hit] = postings[near[hit]] == places[hit] + k
    return phrase[hit], word[near[hit]], places[hit]


@dataclass
class Extensions:
    """A block's phrases, each extended by the word behind it: distinct extensions by number."""

    prefix: np.ndarray
    last: np.ndarray
    times: np.ndarray
    which: np.ndarray
    places: np.ndarray
    words: tuple[np.ndarray, np.ndarray, np.ndarray]

    @classmethod
    def of(cls, row: dict, k: int) -> Extensions:
        m = unpacked(row["word_lengths"]).astype(np.int64)
        word_ids, word, postings = np.array(row["word_ids"], dtype=np.int64), np.repeat(np.arange(len(m), dtype=np.int32), m), unlisted(row["word_places"], m)
        ids, phrase, places = word_ids, word, postings
        if row["ids"] is not None:
            n = unpacked(row["lengths"]).astype(np.int64)
            ids, phrase, places = np.array(row["ids"], dtype=np.int64), np.repeat(np.arange(len(n), dtype=np.int32), n), unlisted(row["places"], n)
        a, b, at = extended(k, phrase, places, word, postings)
        pair, which, times = np.unique(a.astype(np.int64) * len(m) + b, return_inverse=True, return_counts=True)
        return cls(ids[pair // len(m)], word_ids[pair % len(m)], times, which, at, (word_ids, word, postings))

    def lists(self, block: int, k: int, number: np.ndarray, ids: np.ndarray) -> list[tuple]:
        """The lists of the numbered extensions, which are phrases of k words, and of the words right behind them."""
        if not len(ids):
            return []
        some, places = _chosen(self.times, self.places[np.argsort(self.which, kind="stable")], number)
        word_ids, word, postings = self.words
        behind = np.isin(postings, places + k)
        left = np.bincount(word[behind], minlength=len(word_ids))
        # postings stay in order of word and position
        return [(block, word_ids[left > 0], packed(left[left > 0]), listed(postings[behind], left[left > 0]), ids, packed(some), listed(places, some))]


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


#: key: the phrase's id times the number of frequent words, plus the id of the word behind it; 63 bits hold 3 * 10^9 of each.
PAIRS = "block long, number int, key long, n long"


def _counter(k: int, words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each block's extensions of phrases of k words, and the lengths of their lists."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                x = Extensions.of(row, k)
                n = len(x.times)
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * n, pa.int64()), pa.array(np.arange(n), pa.int32()), pa.array(x.prefix * words + x.last), pa.array(x.times, pa.int64())], names=["block", "number", "key", "n"])

    return count


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            words = batch.column("words")[i].values
            n = len(words)
            same = lambda c, kind: pa.array([batch.column(c)[i].as_py()] * n, kind)
            lengths = unpacked(batch.column("lengths")[i].as_py())
            yield pa.RecordBatch.from_arrays([same("block", pa.int64()), same("lang", pa.string()), pa.array(np.arange(n), pa.int32()), pc.cast(words, pa.string()), pa.array(lengths.astype(np.int64))], names=["block", "lang", "number", "word", "n"])


#: Tables of frequent words or extensions of this many rows at most are sent to the blocks; larger ones are joined to them.
MOST_SENT = 1_000_000


def _sent_words(first: DataFrame) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    table = first.select("lang", "word", "id").toArrow()
    by = {lang: (t.column("word").combine_chunks(), t.column("id").to_numpy()) for lang in pc.unique(table.column("lang")).to_pylist() for t in [table.filter(pc.equal(table.column("lang"), lang))]}
    sent = first.sparkSession.sparkContext.broadcast(by)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                known, ids = sent.value.get(batch.column("lang")[i].as_py(), (pa.array([], pa.string()), None))
                at = pc.index_in(pc.cast(batch.column("words")[i].values, pa.string()), known)
                number = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                row = {c: batch.column(c)[i].as_py() for c in ("block", "lengths", "places")}
                if len(number):
                    yield from _rows(_word_lists(row, number, ids[at.drop_null().to_numpy()])).to_batches()

    return narrow


def _sent_extensions(enough: DataFrame, k: int, words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    table = enough.select("key", "id").toArrow()
    key, ids = table.column("key").to_numpy(), table.column("id").to_numpy()
    order = np.argsort(key)
    sent = enough.sparkSession.sparkContext.broadcast((key[order], ids[order]))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids = sent.value
        for batch in batches:
            for row in _each(batch) if len(keys) else ():
                x = Extensions.of(row, k)
                own = x.prefix * words + x.last
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                number = np.flatnonzero(keys[at] == own)
                yield from _rows(x.lists(row["block"], k + 1, number, ids[at[number]])).to_batches()

    return narrow


def _joined(blocks: DataFrame, found: DataFrame, make: Callable[[dict, np.ndarray, np.ndarray], list[tuple]]) -> DataFrame:
    """Blocks with what was found to be frequent in them; found: block, number, id."""

    def narrow(rows: pa.Table, found: pa.Table) -> pa.Table:
        if not len(rows) or not len(found):
            return _rows([])
        (row,) = rows.to_pylist()
        return _rows(make(row, found.column("number").to_numpy().astype(np.int64), found.column("id").to_numpy()))

    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(narrow, LISTS)


#: Bits of an id within its partition, as Spark makes them.
WITHIN = 33


def _numbered(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The rows with id, from 0 on without gaps, and their number.

    Ids stay, since they are written with the rows: each has its partition and its place
    there, and the partitions' sizes, one number each, make them follow one another.
    """
    rows = stage(df.withColumn("raw", F.monotonically_increasing_id()), name)
    part = F.shiftright("raw", WITHIN).cast("int")
    sizes = {r.part: r.n for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before = np.cumsum([0] + [sizes.get(i, 0) for i in range(max(sizes, default=0) + 1)]).tolist()
    within = F.col("raw").bitwiseAND(F.lit((1 << WITHIN) - 1))
    return rows.withColumn("id", within + F.get(F.array(*[F.lit(n).cast("long") for n in before]), part)).drop("raw"), before[-1]


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(phrases, words): lang, size, phrase, f of each phrase of up to ``longest`` words found ``least`` times or more; lang, n.

    The frequent words and extensions that the blocks keep lists of are sent to them while
    they are few, counted before; else (block, number) of each is found by a join.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = stage(rows.mapInArrow(_indexed, BLOCK), "postings")
    per_word = blocks.select("block", "lang", "words", "lengths").mapInArrow(_word_counts, "block long, lang string, number int, word string, n long")
    words = blocks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    first, number = _numbered(per_word.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "frequent-words")
    if number <= MOST_SENT:
        lists = blocks.select("block", "lang", "words", "lengths", "places").mapInArrow(_sent_words(first), LISTS)
    else:
        found = per_word.join(first.select("lang", "word", "id"), ["lang", "word"]).select("block", "number", "id")
        lists = _joined(blocks.select("block", "lengths", "places"), found, _word_lists)
    lists, base = stage(lists, "lists"), F.lit(max(1, number)).cast("long")
    tables = [first.select("lang", F.lit(1).alias("size"), F.col("word").alias("phrase"), "f", "id")]
    for k in range(1, longest):
        pairs = lists.mapInArrow(_counter(k, number), PAIRS)
        enough, several = _numbered(pairs.groupBy("key").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "frequent")
        if k + 1 < longest:
            if several <= MOST_SENT:
                lists = lists.mapInArrow(_sent_extensions(enough, k, number), LISTS)
            else:
                found = pairs.join(enough.select("key", "id"), "key").select("block", "number", "id")
                lists = _joined(lists, found, lambda row, number, ids, k=k: Extensions.of(row, k).lists(row["block"], k + 1, number, ids))
            lists = stage(lists, "lists")
        before = tables[-1].select(F.col("id").alias("prefix"), "lang", "phrase")
        last = first.select(F.col("id").alias("last"), "word")
        longer = enough.withColumn("prefix", F.call_function("div", F.col("key"), base)).withColumn("last", F.col("key") % base)
        longer = longer.join(before, "prefix").join(last, "last")
        tables.append(stage(longer.select("lang", F.lit(k + 1).alias("size"), F.concat_ws(" ", "phrase", "word").alias("phrase"), "f", "id"), "phrases"))
    return reduce(DataFrame.unionByName, [t.drop("id") for t in tables]), words


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The phrases of each language whose parts stand together most above chance.

    Input: text, lang; other columns are ignored, whatever their names.  A null lang counts
    as ``und``, a null text as empty; every row counts, repeated ones too.  Output: lang,
    rank, phrase, a, l, r, n, score.  A phrase (2 to ``longest`` words, a >= least
    occurrences) is cut where floor(1000 * a * n / (l * r)) is lowest, l and r being the
    frequencies of both parts, at equal scores as early as possible.  Phrases inside a
    longer candidate that stands as often are left out; it is enough to look one word
    further, since each phrase between the two stands as often, too.  Ranks go by score, a
    and the phrase, ``top`` for each language.  An empty table gives no rows.
    """
    phrases, words = frequent(docs, least, longest)
    phrases = stage(phrases, "all-phrases")
    spaced = F.split("phrase", " ", -1)
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    longer = phrases.where("size > 2").withColumn("w", spaced)
    inside = longer.select("lang", F.col("f").alias("a"), F.explode(F.array(part(1, F.col("size") - 1), part(2, F.col("size") - 1))).alias("phrase")).distinct()
    wanted = phrases.where("size > 1").withColumnRenamed("f", "a").join(inside, ["lang", "phrase", "a"], "left_anti").withColumn("w", spaced)
    cuts = wanted.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(1, F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size")).alias("rest"))
    f = phrases.select("lang", "phrase", "f")
    cuts = cuts.join(f.toDF("lang", "first", "l"), ["lang", "first"]).join(f.toDF("lang", "rest", "r"), ["lang", "rest"]).join(words, "lang")
    big = lambda c: F.col(c).cast("decimal(20,0)").cast("decimal(38,0)")
    up = (F.lit(1000).cast("decimal(38,0)") * big("a")).cast("decimal(38,0)") * big("n")
    score = F.call_function("div", up.cast("decimal(38,0)"), (big("l") * big("r")).cast("decimal(38,0)"))
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    found = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    # a language's first are among the first of its slices, so no task sorts all of its phrases
    rank = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = found.withColumn("rank", rank("lang", "slice")).where(F.col("rank") <= top)
    first = first.withColumn("rank", rank("lang")).where(F.col("rank") <= top)
    return first.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All phrases of one to five words by their text.
ORACLE = r"""
with pieces as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents),
split as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') ws from pieces),
spans as (select lang, ws, i, size from (select lang, ws, unnest(range(1, len(ws) + 1)) i from split) cross join range(1, 6) t(size) where i + size - 1 <= len(ws)),
f as (select lang, size, array_to_string(ws[i:i + size - 1], ' ') phrase, count(*) f from spans group by all),
total as (select lang, cast(sum(f) as bigint) n from f where size = 1 group by lang),
cand as (select * from f where f >= 100 and size > 1),
inner_parts as (select lang, f, unnest([array_to_string(string_split(phrase, ' ')[1:size - 1], ' '), array_to_string(string_split(phrase, ' ')[2:], ' ')]) phrase from cand where size > 2),
wanted as (select * from cand c where not exists (select 1 from inner_parts p where p.lang = c.lang and p.phrase = c.phrase and p.f = c.f)),
cuts as (select w.lang, w.phrase, w.f a, k, l.f l, r.f r, n, cast((1000::hugeint * w.f * n) // (l.f::hugeint * r.f) as bigint) score
    from wanted w cross join range(1, 5) t(k) join f l on l.lang = w.lang and l.phrase = array_to_string(string_split(w.phrase, ' ')[1:k], ' ')
    join f r on r.lang = w.lang and r.phrase = array_to_string(string_split(w.phrase, ' ')[k + 1:], ' ') join total on total.lang = w.lang where k < w.size),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) "rank", phrase, a, l, r, n, score from best qualify "rank" <= 2000
"""
