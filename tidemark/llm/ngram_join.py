"""N-gram Jaccard self-join by MinHash banding, verified on full n-gram sets.

1. Every document becomes a set of hashes of its five-word shingles.  Documents of
   equal sets form one *set class*, so exact copies never meet as pairs.
2. Bands of MinHash rows are chosen for the target recall.  Band hashes are
   shuffled; a bucket ties its members to its smallest one, which gives candidate
   clusters without listing the pairs of a bucket.
3. A cluster of up to CHUNK members meets in one task with its full shingle sets, and
   every pair in it is verified.  A larger one is cut into chunks by a hash, two of which
   meet in a task; or, where that moves fewer sets, each of its buckets is taken (and
   cut) by itself, so that members chained by others never meet.  A pair of several
   buckets counts in the first of them.  A task returns a count of links for each member
   and a spanning forest of them, never the pairs.
4. The forests' components are the near-duplicate classes.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import kernels as K
from tidemark.llm.columns import WORD
from tidemark.llm.components import components
from tidemark.llm.ordering import hot_join
from tidemark.llm.recurrence import NO_ID
from tidemark.llm.sizing import pieces, stage, text_bytes

SHINGLE = 5
#: 4 * union <= 5 * intersection, that is a Jaccard similarity of 0.8 or more.
NUMERATOR, DENOMINATOR = 4, 5
RECALL = 0.9999
#: More bands allow more rows a band, and so fewer candidates of low similarity.
MOST_BANDS = 52
#: Members, and bytes of their sets, of one of the parts that a large cluster is verified in; a task holds two parts.
CHUNK, CHUNK_BYTES = 512, 64 << 20
#: Members of small clusters that share a task.
BUNDLE_BYTES = 8 << 20
SEED = 99_991


def banding(threshold: float = NUMERATOR / DENOMINATOR, recall: float = RECALL, most: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose recall at the threshold is met within ``most`` bands."""
    best = None
    for rows in range(1, 33):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))
        if bands > most:
            break
        best = (bands, rows)
    return best or (most, 1)


def shingle_sets(column: pa.Array, most: int = 1 << 20):
    """Yields (first row, hashes, bounds): the shingles of row first + i are hashes[bounds[i]:bounds[i + 1]].

    A text of one to four words has one shingle, all its words; one without words none.
    """
    buf, off = K.buffer_of(column)
    for i, j in K.row_chunks(off, most):
        b, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        start, end, first = K.word_spans(b, o)
        h = K.span_hash(b, start, end)
        n = np.diff(first)
        wide = K.window_hash(h, SHINGLE)
        inside = np.zeros(len(h), dtype=bool)
        for x, y in zip(first[:-1][n >= SHINGLE].tolist(), (first[1:][n >= SHINGLE] - SHINGLE + 1).tolist()):
            inside[x:y] = True
        value = h.copy()
        value[: len(wide)] = np.where(inside[: len(wide)], wide, h[: len(wide)])
        for d in np.flatnonzero((n > 0) & (n < SHINGLE)).tolist():
            x, y = int(first[d]), int(first[d + 1])
            value[x] = K.mix(np.array([int(K.window_hash(h[x:y], y - x)[0])], dtype=np.uint64) + np.uint64(y - x))[0]
            inside[x] = True
        bounds = np.concatenate([[0], np.cumsum(np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64)))])
        yield i, value[inside], bounds


SIGNED = "doc_id long, text_hash long, k1 long, k2 long, n long, bands array<long>"


def _signatures(bands: int, rows: int):
    rng = np.random.default_rng(SEED)
    odd = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
    toss = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
            for i, h, bounds in shingle_sets(batch.column("text")):
                m = len(bounds) - 1
                full = np.flatnonzero(np.diff(bounds) > 0)
                k1, k2 = np.zeros(m, np.int64), np.zeros(m, np.int64)
                n = np.zeros(m, np.int64)
                for d in full.tolist():
                    own = np.unique(h[bounds[d] : bounds[d + 1]])
                    n[d] = len(own)
                    k1[d], k2[d] = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)
                signature = np.zeros((len(full), bands * rows), dtype=np.uint64)
                if len(full):
                    low = (h ^ (h >> np.uint64(32))).astype(np.uint32)
                    at = bounds[:-1][full]
                    for r in range(bands * rows):
                        x = (low ^ toss[r]) * odd[r]
                        x ^= x >> np.uint32(15)
                        signature[:, r] = np.minimum.reduceat(x, at)
                key = np.zeros((len(full), bands), dtype=np.uint64)
                for b in range(bands):
                    x = np.full(len(full), b + 1, dtype=np.uint64)
                    for r in range(b * rows, (b + 1) * rows):
                        x = K.mix(x * np.uint64(0x9E3779B97F4A7C15) + signature[:, r] + np.uint64(1))
                    key[:, b] = x
                sizes = np.zeros(m, np.int64)
                sizes[full] = bands
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(key.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + m]), batch.column("text_hash").slice(i, m), pa.array(k1), pa.array(k2), pa.array(n), listed], names=["doc_id", "text_hash", "k1", "k2", "n", "bands"])

    return run


FOUND = "id long, links long, a long, b long"


def _sets(batches):
    """The members with their shingle sets, as packed sorted hashes, instead of their texts."""
    for batch in batches:
        packed = [b""] * batch.num_rows
        for i, h, bounds in shingle_sets(batch.column("text")):
            for d in range(len(bounds) - 1):
                packed[i + d] = np.unique(h[bounds[d] : bounds[d + 1]]).tobytes()
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(packed, pa.binary())], names=[*names, "shingles"])


def linked(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Whether each set on the left has a Jaccard similarity of 0.8 or more with each on the right."""
    both = left + right
    every = np.concatenate(both) if both else np.zeros(0, np.uint64)
    vals, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    size = np.array([len(x) for x in both])
    row = np.repeat(np.arange(len(both)), size)
    shared = counts[inverse] > 1
    dense = np.cumsum(counts > 1) - 1
    row, col = row[shared], dense[inverse[shared]]
    width = int((counts > 1).sum())
    inter = np.zeros((len(left), len(right)), dtype=np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    step = 2048
    for at in range(0, width, step):
        x, y = np.searchsorted(col, [at, at + step])
        part = np.zeros((len(both), min(step, width - at)), dtype=np.float32)
        part[row[x:y], col[x:y] - at] = 1
        inter += part[: len(left)] @ part[len(left) :].T
    union = size[: len(left), None] + size[None, len(left) :] - inter
    return (DENOMINATOR * inter >= NUMERATOR * union) & (union > 0)


def _forest(ids: list[int], left: np.ndarray, right: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links (left[i], right[i]), numbers into ids."""
    up = list(range(len(ids)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    a, b = [], []
    for x, y in zip(left.tolist(), right.tolist()):
        p, q = root(x), root(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            a.append(ids[x])
            b.append(ids[y])
    return a, b


def _verify(key, table):
    out: dict[str, list] = {"id": [], "links": [], "a": [], "b": []}
    table = table.combine_chunks()
    roots, ids, weights, los, his, halves = (table[c].to_numpy() for c in ("meet", "id", "weight", "lo", "hi", "half"))
    turns = table["turn"].to_numpy()
    packed, banded = table["shingles"].combine_chunks(), table["bands"].combine_chunks()
    for lo, hi in sorted(set(zip(los.tolist(), his.tolist()))):
        here = np.flatnonzero((los == lo) & (his == hi))
        here = here[np.argsort(roots[here], kind="stable")]
        cut = np.flatnonzero(np.append(True, roots[here][1:] != roots[here][:-1]))
        for x, y in zip(cut.tolist(), np.append(cut[1:], len(here)).tolist()):
            rows = here[x:y]
            rows = rows[np.argsort(ids[rows], kind="stable")]
            sets = {r: np.frombuffer(packed[int(r)].as_py(), np.uint64) for r in rows.tolist()}
            left = [r for r in rows.tolist() if halves[r] == lo]
            right = left if lo == hi else [r for r in rows.tolist() if halves[r] == hi]
            hit = linked([sets[r] for r in left], [sets[r] for r in right])
            if lo == hi:
                np.fill_diagonal(hit, False)
            if turns[rows[0]] > 0:
                before = {r: np.array(banded[r].as_py()[: turns[rows[0]]], dtype=np.int64) for r in sets}
                for k in range(int(turns[rows[0]])):
                    hit &= np.array([before[r][k] for r in left])[:, None] != np.array([before[r][k] for r in right])[None, :]
            lw, rw = weights[left], weights[right]
            for r, n in zip(left, (hit @ rw).tolist()):
                out["id"].append(int(ids[r])), out["links"].append(n), out["a"].append(None), out["b"].append(None)
            if lo != hi:
                for r, n in zip(right, (lw @ hit).tolist()):
                    out["id"].append(int(ids[r])), out["links"].append(n), out["a"].append(None), out["b"].append(None)
            i, j = np.nonzero(np.triu(hit) if lo == hi else hit)
            names = [int(ids[r]) for r in left] + ([] if lo == hi else [int(ids[r]) for r in right])
            for a, b in zip(*_forest(names, i, j if lo == hi else j + len(left))):
                out["id"].append(None), out["links"].append(None), out["a"].append(a), out["b"].append(b)
    return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, set_id, n_links; one row for each input row.

    class_id: smallest doc_id of the near-duplicate class, the documents joined by
    chains of links; set_id: smallest doc_id of equal shingle sets; n_links: other
    rows with a similarity of 0.8 or more.  A text without words is linked to none:
    its class is its own doc_id.  Rows of equal doc_id count as separate rows where
    their sets are equal or linked.  A null doc_id is numbered as the largest long and
    given back as null; so is a class of such rows only.  A very long text is read whole;
    its set is one row.  An empty table gives none.  Other columns are ignored.
    """
    unnamed = lambda c: F.when(F.col(c) != int(NO_ID), F.col(c)).alias(c)
    return _classed(docs).select(unnamed("doc_id"), unnamed("class_id"), unnamed("set_id"), "n_links")


def _classed(docs: DataFrame) -> DataFrame:
    """near_duplicates by row of (doc_id, text_hash), null ids numbered, with the text that heads each class."""
    bands, rows = banding()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    signed = stage(own.mapInArrow(_signatures(bands, rows), SIGNED), "minhash")

    # a class is headed by a text of its own, not by a doc_id, which other texts may have too
    head = F.min(F.struct("doc_id", "text_hash"))
    classes = signed.where("n > 0").groupBy("k1", "k2").agg(head.alias("head"), F.count("*").alias("weight"), F.max("n").alias("n"), F.min_by("bands", "doc_id").alias("bands"))
    classes = classes.select("k1", "k2", "n", F.col("head.doc_id").alias("set_id"), F.col("head.text_hash").alias("set_text"), "weight", "bands")
    # a doc_id that heads two classes (repeated ids) is told apart by its set
    classes = stage(classes.withColumn("id", F.xxhash64("k1", "k2")), "set-classes")
    distinct = classes.count()
    buckets = stage(classes.select("id", "n", F.posexplode("bands").alias("turn", "band")), "buckets")
    heads = buckets.groupBy("band").agg(F.min("id").alias("head"), F.max("id").alias("tail"), F.count("*").alias("times"), F.sum("n").alias("held")).where("head < tail").select("band", "head", "times", "held")
    heads = stage(heads, "bucket-heads")
    ties = hot_join(buckets, heads, ["band"], "times", distinct * bands).where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    clusters = stage(components(ties, "candidates").join(classes.select("id", "n"), "id"), "clusters")

    size = clusters.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("grams")).withColumn("times", F.col("members"))
    clusters = stage(hot_join(clusters, size, ["root"], "times", distinct).drop("times", "n"), "cluster-sizes")
    # the members of large clusters, by bucket: a cluster whose buckets move fewer sets is verified by them
    cut = lambda n, grams: F.greatest(F.ceil(F.col(n) / CHUNK), F.ceil(F.col(grams) * 8 / CHUNK_BYTES)).cast("int")
    large = clusters.where(cut("members", "grams") > 1)
    meets = stage(hot_join(buckets.drop("n"), heads.drop("head"), ["band"], "times", distinct * bands).join(large, "id"), "large-buckets")
    cost = meets.groupBy("root").agg(F.sum(cut("times", "held").cast("long")).alias("moved"), F.first("members").alias("members"), F.first("grams").alias("grams"))
    sparse = cost.where(F.col("moved") < F.col("members") * cut("members", "grams")).select("root")
    sparse = stage(sparse, "sparse-clusters")
    whole = clusters.join(sparse, "root", "left_anti").select("id", F.col("root").alias("meet"), F.lit(0).alias("turn"), cut("members", "grams").alias("pieces"))
    parted = meets.join(sparse, "root", "left_semi").select("id", F.col("band").alias("meet"), "turn", cut("times", "held").alias("pieces"))

    # one text for each class: the one that heads it
    members = clusters.select("id").join(classes.select("id", "set_id", "set_text", "weight", "bands"), "id")
    holders = members.select("id", "weight", "bands", F.col("set_id").alias("doc_id"), F.col("set_text").alias("text_hash"))
    texts = own.withColumn("doc_id", F.coalesce("doc_id", F.lit(int(NO_ID)))).join(holders, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    sets = texts.select("id", "weight", "bands", "text").mapInArrow(_sets, "id long, weight long, bands array<long>, shingles binary")
    none = F.lit(None).cast("array<long>")
    once = sets.drop("bands").join(whole, "id").withColumn("bands", none)
    often = stage(sets.join(parted.select("id").distinct(), "id", "left_semi"), "sparse-sets").join(parted, "id")
    spread = once.unionByName(often.select(*once.columns))
    spread = spread.withColumn("half", F.pmod(F.xxhash64("id", F.lit(SEED)), F.col("pieces")).cast("int"))
    spread = spread.select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
    bundles = pieces(text_bytes(docs), BUNDLE_BYTES)
    lo, hi = F.least("half", "other"), F.greatest("half", "other")
    bundle = F.when(F.col("pieces") == 1, F.pmod(F.xxhash64("meet"), F.lit(bundles)).cast("int")).otherwise(F.lit(-1))
    spread = spread.select("meet", "turn", "id", "weight", lo.alias("lo"), hi.alias("hi"), "pieces", "half", bundle.alias("bundle"), "bands", "shingles")
    keys = ["bundle", "lo", "hi", F.when(F.col("pieces") > 1, F.col("meet")).otherwise(F.lit(0)).alias("whole")]
    verified = stage(spread.groupBy(*keys).applyInArrow(_verify, FOUND), "links")

    groups = components(verified.where("a is not null").select("a", "b"), "near-classes")
    links = verified.where("id is not null").groupBy("id").agg(F.sum("links").alias("links"))
    named = classes.select("id", "k1", "k2", "set_id", "set_text", "weight").join(groups, "id", "left").withColumn("root", F.coalesce("root", "id")).join(links, "id", "left")
    named = stage(named, "rooted")
    least = named.groupBy("root").agg(F.min(F.struct("set_id", "set_text")).alias("least"), F.count("*").alias("times"))
    least = least.select("root", F.col("least.set_id").alias("class_id"), F.col("least.set_text").alias("class_text"), "times")
    named = hot_join(named, least, ["root"], "times", distinct).select("k1", "k2", "weight", "set_id", "class_id", "class_text", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = ["doc_id", "text_hash", "class_id", "class_text", "set_id", "n_links"]
    named = stage(named, "named")
    full = hot_join(signed.where("n > 0").select("doc_id", "text_hash", "k1", "k2"), named, ["k1", "k2"], "weight", signed.count()).select(*out)
    itself = [F.col("doc_id").alias("class_id"), F.col("text_hash").alias("class_text"), F.col("doc_id").alias("set_id")]
    return full.unionByName(signed.where("n = 0").select("doc_id", "text_hash", *itself, F.lit(0).cast("long").alias("n_links")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows that head their near-duplicate class, all their columns unchanged.

    One row stays of each class, the one of smallest doc_id and, where rows of other
    texts have that id too, of smallest text hash; of rows of equal id and text the one whose
    values have the smallest hash stays, so reruns agree (maps don't count in it).  Texts without words and rows of null doc_id all stay.
    """
    near = stage(_classed(docs), "near").where(F.col("doc_id") != int(NO_ID))
    gone = near.where("doc_id <> class_id or text_hash <> class_text").select("doc_id", "text_hash").distinct()
    same = (F.col("d.doc_id").cast("long") == F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.text_hash"))
    kept = docs.alias("d").join(gone.alias("g"), same, "left_anti").select(*[F.col(f"d.`{c}`") for c in docs.columns])
    if not _repeated_ids(near.where("doc_id = class_id")):
        return kept
    all_stay = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    told = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, T.MapType)]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    each = kept.where(~all_stay).groupBy("doc_id", "text").agg(F.min_by(whole, F.xxhash64(*told)).alias("kept_row"))
    return kept.where(all_stay).unionByName(each.select("kept_row.*"))


def _repeated_ids(signed: DataFrame) -> bool:
    return signed.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0


#: Every pair that shares a shingle, counted; classes by walking the links.
ORACLE = r"""
with recursive words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
sets as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_sort(list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)])) end s from words),
grams as (select doc_id, len(s) n, unnest(s) g from sets),
shared as (select a.doc_id a, b.doc_id b, a.n na, b.n nb, count(*) i from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as (select a, b from shared where 5 * i >= 4 * (na + nb - i)),
reach as (select doc_id id, doc_id root from documents union select l.b, r.root from reach r join links l on l.a = r.id)
select d.doc_id, (select min(root) from reach where id = d.doc_id) class_id,
       case when len(s) = 0 then d.doc_id else min(d.doc_id) over (partition by s) end set_id, (select count(*) from links where a = d.doc_id) n_links
from documents d join sets using (doc_id)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
