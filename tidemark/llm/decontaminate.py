"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A benchmark item of m bytes that occurs in a document with at most k edits shares
m - q + 1 - k*q of its q-grams with it, all of them on diagonals (place in the
document less place in the item) that lie within k of each other.  Long items are
cut into overlapping pieces, so that a part of an item is found as well.

1. Bytes of a normalised document are packed into q-grams and looked up in a bit
   table of the benchmark's grams, then exactly.
2. Hits are counted by (piece, diagonal band); bands are k + 1 wide and neighbours
   are added, so every k-wide range lies in one of the overlapping pairs.
3. Regions that reach the bound are aligned with the piece: the fewest edits that
   turn the piece into some part of the region, within a band of k diagonals.

Items too short for that many grams are looked up exactly, between word boundaries, by
an automaton.

The benchmark travels to the tasks.  Its size is checked: beyond SHARD_BYTES it is cut
into shards, which the documents pass one after the other, CHAINED of them within one
stage.  The driver holds two shards at a time, and a worker process builds the index of a
shard once, which takes some ten bytes a byte of the shard.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.sizing import stage

Q = 8
#: Edits allowed for each byte of a piece.
EDIT_RATE = 0.05
#: Items longer than WHOLE bytes are cut into pieces of PIECE bytes, PIECE // 2 apart.
WHOLE, PIECE = 180, 120
#: Normalised items of fewer bytes allow no edits: they count where they stand as they are.
LEAST_BYTES = 24
SHARD_BYTES, CHAINED = 32 << 20, 2
LEAST_TABLE_BITS = 22
CELL = 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def normalised(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ASCII and Latin-1 letters lowered, runs of spaces as one space; offsets follow."""
    space = K.SPACE[buf]
    keep = np.ones(len(buf), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    out = _LOWER[buf]
    # U+00C0 to U+00DE but the multiplication sign: 0xC3 and a byte 0x20 below its small letter's
    out[1:] += np.where((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97), np.uint8(32), np.uint8(0))
    out[space] = 32
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[off]


@dataclass
class Pieces:
    """Benchmark pieces, as stretches of the items' joined bytes, and items too short to have any."""

    raw: bytes
    item: np.ndarray
    start: np.ndarray
    size: np.ndarray
    short: list[tuple[int, bytes]] = field(default_factory=list)

    @classmethod
    def of(cls, items: list[tuple[int, str | None]]) -> "Pieces":
        number, start, size, short, texts, at = [], [], [], [], [], 0
        for i, t in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
            raw = np.frombuffer((t or "").encode(), np.uint8)
            b = normalised(raw, np.array([0, len(raw)]))[0].tobytes().strip()
            if i is None or not b:
                continue
            if len(b) < LEAST_BYTES:
                short.append((i, b))
                continue
            cuts = [0] if len(b) <= WHOLE else [*range(0, len(b) - PIECE, PIECE // 2), len(b) - PIECE]
            number += [i] * len(cuts)
            start += [at + a for a in cuts]
            size += [min(len(b), WHOLE if len(b) <= WHOLE else PIECE)] * len(cuts)
            texts.append(b)
            at += len(b)
        return cls(b"".join(texts), np.array(number, dtype=np.int64), np.array(start, dtype=np.int64), np.array(size, dtype=np.int64), short)

    def plain(self) -> tuple:
        """As values that any worker can read, whether it has this module or not."""
        return self.raw, self.item, self.start, self.size, self.short

    @property
    def text(self) -> list[bytes]:
        return [self.raw[a : a + n] for a, n in zip(self.start.tolist(), self.size.tolist())]

    def index(self) -> "Index":
        return Index(self)


class Index:
    """Where the grams of the pieces stand in their text: positions sorted by a hash of the gram, and
    for each hash the first of its positions.  Some ten bytes a byte of text; a gram that lies
    in several overlapping pieces is kept once, and found in all of them."""

    #: Positions are sorted a part of the hashes at a time.
    PASSES = 16

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.start, self.size = pieces.start, pieces.size
        size = self.size
        self.edits = np.minimum((EDIT_RATE * size).astype(np.int64), np.maximum(0, (size - Q) // Q))
        self.bound = np.maximum(1, size - Q + 1 - self.edits * Q)
        self.grams = _grams_of(pieces.raw)
        # a gram counts that lies within a piece; pieces of an item overlap or meet
        inside = np.zeros(len(self.grams) + 1, dtype=np.int32)
        np.add.at(inside, self.start, 1)
        np.add.at(inside, self.start + size - Q + 1, -1)
        inside = np.cumsum(inside[:-1]) > 0
        n = int(inside.sum())
        self.bits = int(np.clip(np.ceil(np.log2(n + 1)), 16, 30))
        self.first = np.zeros((1 << self.bits) + 1, dtype=np.uint32)
        self.places = np.empty(n, dtype=np.uint32)
        filled = 0
        for k in range(self.PASSES):
            mine = []
            for a in range(0, len(self.grams), 1 << 22):
                slot = _slot(self.grams[a : a + (1 << 22)], self.bits)
                at = np.flatnonzero((slot >> (self.bits - 4) == k) & inside[a : a + (1 << 22)])
                mine.append(np.stack([slot[at], at + a]))
            slot, at = np.concatenate(mine, axis=1) if mine else np.zeros((2, 0), np.int64)
            order = np.argsort(slot, kind="stable")
            self.places[filled : filled + len(at)] = at[order]
            low, width = k << (self.bits - 4), 1 << (self.bits - 4)
            self.first[low + 1 : low + width + 1] = filled + np.cumsum(np.bincount(slot - low, minlength=width))
            filled += len(at)
        # the least hits that a stretch of text must have, by classes of piece sizes
        grade = size // 16
        self.least = [(int((size + self.edits)[grade == g].max()), int(self.bound[grade == g].min())) for g in np.unique(grade)]
        # whether a gram is there at all, by a longer hash, so that few others pass
        self.table_bits = max(LEAST_TABLE_BITS, self.bits + 1)
        self.table = np.zeros(1 << self.table_bits, dtype=bool)
        for a in range(0, len(self.grams), 1 << 20):
            self.table[_slot(self.grams[a : a + (1 << 20)][inside[a : a + (1 << 20)]], self.table_bits)] = True
        self.exact = None
        if pieces.short:
            import ahocorasick

            items: dict[bytes, list[int]] = {}
            for i, b in pieces.short:
                items.setdefault(b, []).append(i)
            self.exact = ahocorasick.Automaton()
            for b, numbers in items.items():
                self.exact.add_word(b.decode("latin-1"), (len(b), numbers))
            self.exact.make_automaton()

    def found(self, buf: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item, from, to) of every place that holds an item or a piece of one."""
        return self.search(buf, off) + self.short(buf, off)

    def short(self, buf: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Exact places of the short items, with no letter or digit at either side (bytes beyond ASCII are letters)."""
        if self.exact is None:
            return []
        out = []
        for r, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            text = buf[a:b]
            for last, (n, numbers) in self.exact.iter(text.tobytes().decode("latin-1")):
                first = last - n + 1
                if not (first and _LETTER[text[first - 1]] and _LETTER[text[first]]) and not (last + 1 < len(text) and _LETTER[text[last + 1]] and _LETTER[text[last]]):
                    out += [(r, i, first, last + 1) for i in numbers]
        return out

    def _dense(self, hit: np.ndarray) -> np.ndarray:
        """Places of the hits that lie where some class of pieces could reach its bound."""
        n = len(hit)
        cells = np.zeros(-(-n // CELL) * CELL, dtype=np.int8)
        cells[:n] = hit
        total = np.concatenate([[0], np.cumsum(cells.reshape(-1, CELL).sum(axis=1, dtype=np.int64))])
        m = len(total) - 1
        turn = np.zeros(m + 1, dtype=np.int64)
        for span, bound in self.least:
            w = min(m, -(-span // CELL) + 1)
            ok = np.flatnonzero(total[w:] - total[: m - w + 1] >= bound)
            np.add.at(turn, ok, 1)
            np.add.at(turn, ok + w, -1)
        near = np.cumsum(turn[:-1]) > 0
        at = np.flatnonzero(hit)
        return at[near[at // CELL]]

    def search(self, buf: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item, from, to) of every region that holds a piece within its edits; bytes of the row."""
        if len(buf) < Q or not len(self.places):
            return []
        grams = _grams(buf)
        at = self._dense(self.table[_slot(grams, self.table_bits)])
        if not len(at):
            return []
        slot = _slot(grams[at], self.bits)
        pos, run = _spread(at, self.first[slot].astype(np.int64), self.first[slot + 1].astype(np.int64))
        place = self.places[run].astype(np.int64)
        same = self.grams[place] == grams[pos]
        pos, place = pos[same], place[same]
        # the pieces that the gram lies in
        which, piece = _spread(np.arange(len(place)), np.searchsorted(self.start, place - (WHOLE - Q)), np.searchsorted(self.start, place, side="right"))
        within = place[which] <= self.start[piece] + self.size[piece] - Q
        piece, which = piece[within], which[within]
        pos, place = pos[which], place[which] - self.start[piece]
        row = np.searchsorted(off, pos, side="right") - 1
        wide = self.edits[piece] + 1
        band = (pos - place + 4 * PIECE) // wide
        # a pair of neighbouring bands is named by its lower one; the text before a row belongs to other rows
        key = np.stack([row, piece, band])
        order = np.lexsort(key[::-1])
        row, piece, band, pos = row[order], piece[order], band[order], pos[order]
        new = np.append(True, (row[1:] != row[:-1]) | (piece[1:] != piece[:-1]) | (band[1:] != band[:-1])) if len(row) else np.zeros(0, bool)
        cut = np.flatnonzero(new)
        hits = np.diff(np.append(cut, len(row)))
        row, piece, band = row[cut], piece[cut], band[cut]
        joined = np.append((row[1:] == row[:-1]) & (piece[1:] == piece[:-1]) & (band[1:] == band[:-1] + 1), False) if len(row) else np.zeros(0, bool)
        pair = hits.copy()
        pair[joined] += hits[np.flatnonzero(joined) + 1]
        found = []
        for i in np.flatnonzero(pair >= self.bound[piece]).tolist():
            p, r = int(piece[i]), int(row[i])
            k, m = int(self.edits[p]), int(self.size[p])
            low = int(band[i]) * (k + 1) - 4 * PIECE
            a, b = max(int(off[r]), low - k), min(int(off[r + 1]), low + 2 * (k + 1) + m + k)
            part = _aligned(self.pieces.raw[self.start[p] : self.start[p] + m], buf[a:b].tobytes(), k)
            if part is not None:
                found.append((r, int(self.pieces.item[p]), a + part[0] - int(off[r]), a + part[1] - int(off[r])))
        return found


def _grams_of(raw: bytes) -> np.ndarray:
    """The gram at each place, as a view of the bytes."""
    return np.ndarray((max(0, len(raw) - Q + 1),), np.uint64, raw if len(raw) >= Q else b" " * Q, 0, (1,))


def _grams(buf: np.ndarray) -> np.ndarray:
    return _grams_of(buf.tobytes()).copy()


def _slot(gram: np.ndarray, bits: int) -> np.ndarray:
    return ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _spread(of: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value beside all the numbers from its low to its high, which is left out."""
    times = high - low
    return np.repeat(of, times), np.repeat(low - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))


def _aligned(piece: bytes, region: bytes, k: int) -> tuple[int, int] | None:
    """Where some part of the region is within k edits of the piece; the region spans the band."""
    at = region.find(piece)
    if at >= 0:
        return at, at + len(piece)
    text = np.frombuffer(region, np.uint8)
    n = len(text)
    step = np.arange(n + 1)
    cost = np.zeros(n + 1, dtype=np.int64)
    begin = step.copy()
    far = len(piece) + n + 1
    for i, c in enumerate(piece):
        swap = np.concatenate([[far], cost[:-1] + (text != c)])
        drop = cost + 1
        now = np.minimum(swap, drop)
        now[0] = i + 1
        src = np.where(swap <= drop, np.concatenate([[0], begin[:-1]]), begin)
        src[0] = 0
        # insertions: the least of now[j] - j so far, plus the distance
        rest = now - step
        low = np.minimum.accumulate(rest)
        last = np.maximum.accumulate(np.where(rest == low, step, 0))
        cost, begin = low + step, src[last]
        if cost.min() > k:
            return None
    end = int(np.argmin(cost))
    return (int(begin[end]), end) if cost[end] <= k else None


def _index(shard) -> Index:
    """The shard's index, made once in a worker process; the last one is kept."""
    kept = sys.__dict__.setdefault("_benchmark_index", {})
    if shard.id not in kept:
        kept.clear()
        kept[shard.id] = Pieces(*shard.broadcast.value).index()
    return kept[shard.id]


@dataclass
class Shard:
    """A broadcast shard of the benchmark, as plain values; id tells it from others on a worker."""

    id: str
    broadcast: object


def shards(benchmark: DataFrame, most: int = SHARD_BYTES) -> Iterator[Pieces]:
    """The benchmark in pieces, at most about ``most`` bytes of text a shard, one after the other."""
    total = int(benchmark.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0)
    n = total // most + 1
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    for i in range(n):
        mine = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield Pieces.of([(r["item_id"], r["text"]) for r in mine.collect()])  # SHARD_BYTES at most


def _passed(rows: DataFrame, benchmark: DataFrame, most: int, step: Callable[[DataFrame, Shard, bool], DataFrame]) -> DataFrame:
    """The rows passed through all shards; ``step`` is told whether a shard is the last.

    Up to CHAINED shards are passed within one stage, each in a worker of its own beside the
    others; then the rows are staged and those shards are given up.
    """
    sent, spark = shards(benchmark, most), rows.sparkSession
    pieces, held = next(sent), []
    while pieces is not None:
        shard = Shard(uuid.uuid4().hex, spark.sparkContext.broadcast(pieces.plain()))
        pieces = next(sent, None)
        rows = step(rows, shard, pieces is None)
        held.append(shard)
        if len(held) == CHAINED and pieces is not None:
            rows = stage(rows, "past-shards")
            for s in held:
                s.broadcast.destroy()
            held = []
    return rows


def _hits(shard: Shard, batch: pa.RecordBatch):
    """(row, item, from, to) of a batch's texts."""
    buf, off = K.buffer_of(batch.column("text"))
    for i, j in K.row_chunks(off, 1 << 20):
        text, at = normalised(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        for r, item, a, b in _index(shard).found(text, at):
            yield i + r, item, a, b


FOUND = "doc_id long, tie long, text string, items array<long>, spans array<long>"


def _searched(shard: Shard, last: bool):
    names = ["doc_id", "tie", *([] if last else ["text"])]

    def run(batches):
        for batch in batches:
            rows: dict[int, set[tuple[int, int, int]]] = {}
            for r, *span in _hits(shard, batch):
                rows.setdefault(r, set()).add(tuple(span))
            items, spans = batch.column("items").to_pylist(), batch.column("spans").to_pylist()
            for r, mine in rows.items():
                items[r] = sorted({*items[r], *(x[0] for x in mine)})
                spans[r] = spans[r] + [y for x in sorted(mine) for y in x]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(items, longs), pa.array(spans, longs)], names=[*names, "items", "spans"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, most: int = SHARD_BYTES) -> DataFrame:
    """doc_id, tie, items, spans; one row for each input row, equal rows alike.

    items: sorted item_ids of which the text holds a piece (a whole item of up to 180
    bytes, else 120 of its bytes) within a twentieth of the piece's bytes as edits, after
    lowering ASCII and Latin-1 letters and taking runs of spaces as one.  An item under 24
    bytes counts where it stands without edits between word boundaries.  spans: item, from,
    to, in bytes of the text so normalised.  A null or empty text holds none; items that are
    null, empty or of null id are passed over; equal items are both reported.  A null
    doc_id stays null.  A very long text is searched whole.  tie is a hash of the text.
    Other columns are ignored, whatever their names.
    """
    none = F.array().cast("array<bigint>")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text", none.alias("items"), none.alias("spans"))

    def step(rows: DataFrame, shard: Shard, last: bool) -> DataFrame:
        # the texts are passed on to further shards only
        return rows.mapInArrow(_searched(shard, last), FOUND.replace("text string, ", "") if last else FOUND)

    return _passed(found, benchmark, most, step)


def _clean(shard: Shard):
    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            keep[[r for r, *_ in _hits(shard, batch)]] = False
            yield batch.filter(pa.array(keep))

    return run


def uncontaminated(docs: DataFrame, benchmark: DataFrame, most: int = SHARD_BYTES) -> DataFrame:
    """The rows that hold no item of the benchmark, nor a piece of one, all their columns unchanged."""
    return _passed(docs, benchmark, most, lambda rows, shard, last: rows.mapInArrow(_clean(shard), docs.schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items", F.size("items").cast("long").alias("n_items"))
