"""Byte-string dedup with a run-length Burrows-Wheeler index.

The text of a home's own segments is indexed: suffix array by prefix doubling,
run-length encoded BWT, and the suffix-array samples at both ends of every run.
The suffix array itself is dropped.  Segments from other blocks are streamed
against the index from right to left; every step keeps the matching statistic,
the length of the longest match that starts here and one text position where it
occurs, by an LF step or, on a mismatch, by a jump to the better of the two
nearest runs of the wanted byte.  Many segments are streamed side by side as
numpy lanes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.recurrence import Body, Kind, earlier_windows_removed, runs_of

WINDOW_BYTES = 100
GRAM_BYTES = 40
#: Window starts that one lane handles; it also reads WINDOW_BYTES - 1 bytes beyond.
LANE = 512
#: Text of a block of documents, and so of an index.
BLOCK_BYTES = 2 << 20
#: Lanes streamed together, for bounded memory.
LANES = 4096
#: Rows compared at once while windows are numbered.
SLICE = 1 << 19
#: Text of the segments that are streamed together, and of an index over what is left.
BATCH_BYTES = 1 << 20

END, SEPARATOR, SHIFT = 0, 1, 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of small-alphabet text (< 512) in order; only unresolved groups are sorted again."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(7, text.dtype)])
    key = np.zeros(n, dtype=np.int64)
    for i in range(7):
        key <<= 9
        key |= padded[i : i + n]
    sa = np.argsort(key, kind="stable")
    sorted_key = key[sa]
    new = np.append(True, sorted_key[1:] != sorted_key[:-1])
    group = np.flatnonzero(new)[np.cumsum(new) - 1]
    rank = np.empty(n + 1, dtype=np.int64)
    rank[sa] = group
    rank[n] = -1
    del key, sorted_key, group, padded
    single = new & np.append(new[1:], True)
    slots = np.flatnonzero(~single)
    k = 7
    while len(slots):
        pos = sa[slots]
        key = rank[pos] * (n + 1) + rank[np.minimum(pos + k, n)] + 1
        order = np.argsort(key, kind="stable")
        pos, key = pos[order], key[order]
        sa[slots] = pos
        new = np.append(True, key[1:] != key[:-1])
        rank[pos] = slots[np.flatnonzero(new)[np.cumsum(new) - 1]]
        slots = slots[~(new & np.append(new[1:], True))]
        k *= 2
    return sa


class RunLengthIndex:
    """Run-length BWT of some byte strings with sampled run ends, and the classes of their windows."""

    def __init__(self, parts: list[bytes], width: int = WINDOW_BYTES):
        self.width = width
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes + 1)])
        n = int(self.first[-1]) + 1
        raw = np.frombuffer(b"\0".join(parts) + b"\0\0", np.uint8)
        self.left = np.zeros(n, dtype=np.int32)  # bytes from here to the end of the part
        text = raw.astype(np.int16) + SHIFT
        text[self.first[1:] - 1] = SEPARATOR
        text[n - 1] = END
        self.left[: n - 1] = np.repeat(self.first[1:] - 1, sizes + 1) - np.arange(n - 1)
        self.raw = np.concatenate([raw, np.zeros(2 * width + 8, np.uint8)])
        self.eight = np.ndarray((len(self.raw) - 7,), np.uint64, self.raw.tobytes(), 0, (1,))
        sa = suffix_array(text)
        bwt = text[sa - 1]
        new = np.append(True, bwt[1:] != bwt[:-1])
        self.run_start = np.flatnonzero(new)
        self.run_byte = bwt[self.run_start].astype(np.int64)
        run_stop = np.append(self.run_start[1:], n)
        self.head, self.tail = sa[self.run_start], sa[run_stop - 1]
        size = run_stop - self.run_start
        # LF of a run's first row: smaller symbols, then equal ones in earlier runs
        by_symbol = np.argsort(self.run_byte, kind="stable")
        self.lf = np.empty(len(size), dtype=np.int64)
        self.lf[by_symbol] = np.concatenate([[0], np.cumsum(size[by_symbol])[:-1]])
        self.stop = run_stop
        self.runs = len(size)
        self.by_symbol = self.run_byte[by_symbol] * self.runs + by_symbol
        # windows of equal content are neighbours in the order: number them, then let the order go
        rows = sa[self.left[sa] >= width]
        self.window_class = np.full(n, -1, dtype=np.int32)
        number = -1
        for i in range(0, len(rows), SLICE):
            part = rows[max(0, i - 1) : i + SLICE]
            fresh = self.common(part[1:], part[:-1], np.full(len(part) - 1, width)) < width
            fresh = fresh if i else np.append(True, fresh)
            self.window_class[rows[i : i + SLICE]] = number + np.cumsum(fresh)
            number += int(fresh.sum())
        self.classes = int(self.window_class.max(initial=-1)) + 1
        self.n = n

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix of text[a:] and text[b:] within their parts, up to ``most``."""
        most = np.minimum(np.minimum(most, self.left[a]), self.left[b])
        out = most.copy()
        live = np.flatnonzero(most > 0)
        k = 0
        while len(live):
            x = self.eight[a[live] + k] ^ self.eight[b[live] + k]
            differ = x != 0
            if differ.any():
                y = x[differ]
                low = (y & (~y + np.uint64(1))).astype(np.float64)
                out[live[differ]] = np.minimum(out[live[differ]], k + (np.frexp(low)[1] - 1) // 8)
            k += 8
            live = live[~differ]
            live = live[most[live] > k]
        return out

    def stream(self, queries: list[bytes]) -> list[np.ndarray]:
        """For each window of each query a text position where it occurs, or -1."""
        w = self.width
        found = [np.full(len(q) - w + 1, -1, dtype=np.int64) for q in queries]
        lanes = [(k, s, min(len(q) - w + 1, s + LANE)) for k, q in enumerate(queries) for s in range(0, len(q) - w + 1, LANE)]
        lanes.sort(key=lambda x: x[1] - x[2])
        for i in range(0, len(lanes), LANES):
            self._stream(queries, lanes[i : i + LANES], found)
        return found

    def _stream(self, queries: list[bytes], lanes: list[tuple[int, int, int]], found: list[np.ndarray]) -> None:
        w = self.width
        length = np.array([b - a + w - 1 for _, a, b in lanes])
        longest = int(length[0])
        # column t holds each lane's t-th byte from its right end
        grid = np.zeros((longest, len(lanes)), dtype=np.int16)
        for j, (k, a, b) in enumerate(lanes):
            grid[: length[j], j] = np.frombuffer(queries[k], np.uint8, length[j], a)[::-1].astype(np.int16) + SHIFT
        hits = np.full((longest, len(lanes)), -1, dtype=np.int64)
        row = np.zeros(len(lanes), dtype=np.int64)
        pos = np.full(len(lanes), self.head[0], dtype=np.int64)
        size = np.zeros(len(lanes), dtype=np.int64)
        for t in range(longest):
            live = int(np.searchsorted(-length, -t, side="left"))  # lanes longer than t, longest first
            want = grid[t, :live].astype(np.int64)
            r, p, m = row[:live], pos[:live], size[:live]
            j = np.searchsorted(self.run_start, r, side="right") - 1
            odd = np.flatnonzero(self.run_byte[j] != want)
            if len(odd):
                c, jo, po, mo = want[odd], j[odd], p[odd], m[odd]
                after = np.searchsorted(self.by_symbol, c * self.runs + jo)
                nxt = self.by_symbol[np.minimum(after, self.runs - 1)]
                prv = self.by_symbol[np.maximum(after - 1, 0)]
                has_n, has_p = (after < self.runs) & (nxt // self.runs == c), (after > 0) & (prv // self.runs == c)
                jn, jp = np.where(has_n, nxt % self.runs, 0), np.where(has_p, prv % self.runs, 0)
                cap = np.minimum(mo, w)
                ln = np.where(has_n, self.common(po, self.head[jn], cap), -1)
                lp = np.where(has_p, self.common(po, self.tail[jp], cap), -1)
                up = lp >= ln
                to = np.where(up, jp, jn)
                none = ~has_n & ~has_p
                j[odd] = np.where(none, jo, to)
                r[odd] = np.where(none, r[odd], np.where(up, self.stop[jp] - 1, self.run_start[jn]))
                p[odd] = np.where(none, po, np.where(up, self.tail[jp], self.head[jn]))
                m[odd] = np.where(none, -1, np.maximum(lp, ln))
            lost = m < 0
            step = self.lf[j] + r - self.run_start[j]
            row[:live] = np.where(lost, r, step)
            pos[:live] = np.where(lost, p, p - 1)
            size[:live] = m + 1
            hits[t, :live] = np.where(size[:live] >= w, pos[:live], -1)
        for j, (k, a, b) in enumerate(lanes):
            found[k][a:b] = hits[w - 1 : length[j], j][::-1]


def resolve_by_index(bodies: list[Body], width: int = WINDOW_BYTES) -> list[np.ndarray]:
    """Earliest places of the windows of each body, as runs.

    Places are packed as (number of the document, start).  What is kept for a window of
    another block's segment is one 32-bit class; all else is made batch by batch.
    """
    docs, doc_at = np.unique(np.array([b.doc for b in bodies], dtype=np.int64), return_inverse=True)
    windows = [len(b.data) - width + 1 for b in bodies]

    def place(i: int) -> np.ndarray:
        return (np.int64(doc_at[i]) << 32) + bodies[i].start + np.arange(windows[i])

    own = [i for i, b in enumerate(bodies) if b.home] or [0]
    rest = sorted(set(range(len(bodies))) - set(own))
    index = RunLengthIndex([bodies[i].data for i in own], width)
    least = np.full(index.classes, np.iinfo(np.int64).max)
    spot: dict[int, np.ndarray] = {i: index.window_class[index.first[k] : index.first[k] + windows[i]] for k, i in enumerate(own)}
    for batch in _batches(rest, lambda i: len(bodies[i].data)):
        for i, p in zip(batch, index.stream([bodies[i].data for i in batch])):
            spot[i] = np.where(p >= 0, index.window_class[p], np.int32(-1))
    del index
    for i, c in spot.items():
        hit = c >= 0
        np.minimum.at(least, c[hit], place(i)[hit])

    # what the home itself doesn't hold can still occur twice among the others
    missing: list[tuple[int, int, int, int, bool]] = []  # anchor, body, windows from and to, whether one could be there twice
    for i in rest:
        for a, b in _stretches(spot[i] < 0):
            missing += [(v, i, a + x, a + y, twice) for v, x, y, twice in _by_anchor(bodies[i].data[a : b + width - 1], width)]
    found: dict[int, list[tuple[int, np.ndarray]]] = {}
    for batch in _batches(sorted(_recurring(missing)), lambda m: m[3] - m[2] + width, whole=lambda m: m[0]):
        index = RunLengthIndex([bodies[i].data[a : b + width - 1] for _, i, a, b in batch], width)
        low = np.full(index.classes, np.iinfo(np.int64).max)
        cls = [index.window_class[index.first[k] : index.first[k] + b - a] for k, (_, _, a, b) in enumerate(batch)]
        for c, (_, i, a, b) in zip(cls, batch):
            np.minimum.at(low, c, place(i)[a:b])
        for c, (_, i, a, _) in zip(cls, batch):
            found.setdefault(i, []).append((a, low[c]))
    out = []
    for i in range(len(bodies)):
        c, best = spot[i], place(i)
        hit = c >= 0
        best[hit] = least[c[hit]]
        for a, low in found.get(i, ()):
            best[a : a + len(low)] = low
        out.append(runs_of(docs[best >> 32], best & 0xFFFFFFFF))
    return out


def _batches(items: list, size, whole=None):
    """Lists of about BATCH_BYTES; items of equal ``whole`` stay together."""
    batch, total, last = [], 0, None
    for x in items:
        if batch and total >= BATCH_BYTES and (whole is None or whole(x) != last):
            yield batch
            batch, total = [], 0
        batch.append(x)
        total += size(x)
        last = whole(x) if whole else None
    if batch:
        yield batch


def _stretches(mask: np.ndarray) -> list[tuple[int, int]]:
    step = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()))


def _by_anchor(text: bytes, width: int) -> list[tuple[int, int, int, bool]]:
    """(anchor, first window, window after the last, repeat) for the runs of windows of equal anchor.

    repeat: the anchor's gram stands in the run twice or more.  A window that comes
    twice in a run brings its anchor's gram twice, at whatever distance.
    """
    value = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
    grams = K.window_hash(value, GRAM_BYTES)
    anchor = K.sliding_min(grams, width - GRAM_BYTES + 1)
    at = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    runs = zip(anchor[at], at.tolist(), [*at[1:].tolist(), len(anchor)])
    return [(int(v), x, y, np.count_nonzero(grams[x : y + width - GRAM_BYTES] == v) > 1) for v, x, y in runs]


def _recurring(missing: list[tuple[int, int, int, int, bool]]) -> list[tuple[int, int, int, int]]:
    """Runs whose anchor another run has too, or that could hold a window twice."""
    times: dict[int, int] = {}
    for v, *_ in missing:
        times[v] = times.get(v, 0) + 1
    return [m[:4] for m in missing if times[m[0]] > 1 or m[4]]


STRINGS = Kind(width=WINDOW_BYTES, gram=GRAM_BYTES, words=False, strict_document=False, resolve=resolve_by_index)


def remove_repeated_strings(docs: DataFrame) -> DataFrame:
    """Drop every byte covered by a 100-byte string that also starts earlier in the corpus.

    Earlier: in a document of smaller doc_id, or in the same one at an earlier byte;
    the two may overlap.  Matches never cross documents.  Input: doc_id, text (UTF-8;
    null is empty); other columns are ignored, whatever their names.  Output, one row
    for each input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    spans (int64 pairs, bytes from and to), kept_bytes (binary, may cut a character).
    A null doc_id comes after all others.  Rows of equal doc_id are copies of one
    document: an equal start in another of them is not earlier.
    """
    out = earlier_windows_removed(docs, STRINGS, BLOCK_BYTES)
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "spans", F.col("kept").alias("kept_bytes"))


#: Every 100-byte window by its digest, over the text as hexadecimal digits.
ORACLE = """
with raw as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
places as (select doc_id, unnest(range(1, cast(length(h) / 2 as bigint) + 1)) i, h from raw),
bytes as (select doc_id, i, substr(h, cast(2 * i - 1 as bigint), 2) b, case when 2 * (i + 99) <= length(h) then md5(substr(h, cast(2 * i - 1 as bigint), 200)) end w from places),
again as (select doc_id, i, b, w is not null and row_number() over (partition by w order by doc_id, i) > 1 again from bytes),
judged as (select doc_id, i, b, bool_or(again) over (partition by doc_id order by i rows between 99 preceding and current row) gone from again),
edges as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) opens from judged),
kept as (select doc_id, count(*) n_bytes, count(*) filter (gone) n_removed, count(*) filter (opens) n_spans, string_agg(b, '' order by i) filter (not gone) body from edges group by doc_id)
select r.doc_id, coalesce(n_bytes, 0) n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(body, ''))) kept_sha256 from raw r left join kept using (doc_id)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_repeated_strings(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))
