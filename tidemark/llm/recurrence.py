"""Locate every window of W units that also occurs earlier in a corpus.

The unit is a byte or a word.  Exactness does not rest on sampling: each window
is represented by the smallest hash among its k-unit grams (its *anchor*), a
function of the window's content alone, so two equal windows always have equal
anchors.  The steps, all keyed by bounded integers:

1. ``blocks``: documents are dealt by a hash of their id and text into blocks of a
   few MB; the one shuffle of text, which the later passes reuse.  Rows of one or
   no id spread as all others do; only rows equal in both share a block.
2. ``anchors``: every block sends its distinct anchors (8 bytes each) to anchor
   buckets.  A frequent passage costs one entry a block, not one a document.
3. ``homes``: a bucket returns each anchor that occurs twice or more to the blocks
   that hold it, with its home, one of those blocks.
4. ``segments``: maximal runs of windows with recurring anchors and one home go to
   that home as text, each distinct text once a block.
5. ``resolve``: a home decides for each window of its segments the earliest place
   (doc_id, start) at which it occurs; that is where the named index works.
6. ``apply``: blocks compare each of their windows with its earliest place.

A block sends a text once, and a home keeps each distinct text once, so a copy costs a
block's row at most.  A passage in many different surroundings does gather at its home,
one text for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.sizing import pieces, text_bytes

#: A null doc_id is a document after all others.
NO_ID = np.iinfo(np.int64).max
BLOCK_BYTES = 4 << 20
#: Text bytes to a bucket of anchors. Beyond so many buckets a block's rows would hold few anchors each, so buckets
#: grow first, up to what a task can sort in some 500 MB, and then their number does.
BUCKET_BYTES = 16 << 20
MANY_BUCKETS = 200_000
LARGEST_BUCKET_BYTES = 192 << 20

ENTRY = "bucket int, block int, payload binary"
REPLY = "block int, kind int, payload binary"
SEGMENT = "home int, block int, doc_id long, start long, many boolean, body binary"
RESULT = "doc_id long, null_text boolean, n_units long, n_removed long, n_spans long, spans binary, kept binary"

HOMES, VERDICTS = 0, 1


@dataclass(frozen=True)
class Kind:
    """What a window is made of, and how segments are resolved."""

    width: int
    gram: int
    words: bool
    strict_document: bool
    resolve: Callable[[list["Body"]], list[np.ndarray]]


@dataclass
class Body:
    """A distinct segment text at its home. first: its earliest (doc_id, start); count: places seen."""

    data: bytes
    doc: int
    start: int
    count: int
    home: bool


class Scan:
    """Windows of a run of documents. Arrays are indexed by unit."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, kind: Kind):
        self.kind, self.buf, self.off = kind, buf, off
        if kind.words:
            self.start, self.end, self.first = K.word_spans(buf, off)
            items = K.span_hash(buf, self.start, self.end)
        else:
            self.first = off
            items = buf.astype(np.uint64) + np.uint64(1)
        self.n = len(items)
        w = kind.width
        grams = K.window_hash(items, kind.gram)
        self.anchor = K.sliding_min(grams, w - kind.gram + 1) if self.n >= w else np.zeros(0, np.uint64)
        self.inside = np.zeros(len(self.anchor), dtype=bool)
        for a, b in zip(self.first[:-1].tolist(), (self.first[1:] - w + 1).tolist()):
            if b > a:
                self.inside[a:b] = True
        self.grams = grams

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Grams that are the least of some window: hashes, whether another is equal, kinship.

        Each hash comes once.  Kinship is 16 bits of the least gram of the whole
        document, the least over the documents that hold the gram.
        """
        if not self.inside.any():
            return np.zeros(0, np.uint64), np.zeros(0, dtype=bool), np.zeros(0, np.uint16)
        span = self.kind.width - self.kind.gram + 1
        pad = np.zeros(span - 1, np.uint64)
        most = ~K.sliding_min(~np.concatenate([pad, np.where(self.inside, self.anchor, np.uint64(0)), pad]), span)
        at = np.flatnonzero((most == self.grams) & (most > 0))
        vals = self.grams[at]
        owner = np.searchsorted(self.first, at, side="right") - 1
        order = np.argsort(vals, kind="stable")
        vals, owner = vals[order], owner[order]
        least = np.full(len(self.first), ~np.uint64(0))
        np.minimum.at(least, owner, vals)
        kin = (K.mix(least[owner]) & np.uint64(0xFFFF)).astype(np.uint16)
        new = np.append(True, vals[1:] != vals[:-1])
        same = ~new
        if self.kind.strict_document:
            same[1:] &= owner[1:] != owner[:-1]
        at = np.flatnonzero(new)
        return vals[at], np.maximum.reduceat(same.view(np.int8), at) > 0, np.minimum.reduceat(kin, at)

    def segments(self, known: np.ndarray, home: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(first window, window after the last, home) of each maximal run."""
        if not len(known) or not len(self.anchor):
            return
        a = self.anchor
        edge = np.ones(len(a), dtype=bool)
        edge[1:] = a[1:] != a[:-1]
        at = np.flatnonzero(edge)
        vals = a[at]
        slot = np.minimum(np.searchsorted(known, vals), len(known) - 1)
        to = np.where(known[slot] == vals, home[slot], -1)
        to = np.repeat(to, np.diff(np.append(at, len(a))))
        to[~self.inside] = -1
        cut = np.ones(len(to), dtype=bool)
        cut[1:] = to[1:] != to[:-1]
        begins = self.first[:-1]
        cut[begins[begins < len(to)]] = True
        at = np.flatnonzero(cut)
        stop = np.append(at[1:], len(to))
        ok = to[at] >= 0
        yield from zip(at[ok].tolist(), stop[ok].tolist(), to[at[ok]].tolist())

    def body(self, a: int, b: int) -> bytes:
        """Text of windows a to b - 1; words are joined by one space."""
        last = b + self.kind.width - 1
        if not self.kind.words:
            return self.buf[a:last].tobytes()
        raw = self.buf[self.start[a] : self.end[last - 1]]
        space = K.SPACE[raw]
        if not space.any():
            return raw.tobytes()
        keep = np.ones(len(raw), dtype=bool)
        keep[1:] = ~(space[1:] & space[:-1])
        return np.where(space, np.uint8(32), raw)[keep].tobytes()


def _ids(table: pa.Table) -> np.ndarray:
    return table["doc_id"].combine_chunks().fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


def _scans(table: pa.Table, kind: Kind) -> Iterator[tuple[int, int, Scan]]:
    column = table["text"].combine_chunks()
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        buf, off = K.buffer_of(part)
        for i, j in K.row_chunks(off, 1 << 20):
            yield i, j, Scan(buf[off[i] : off[j]], off[i : j + 1] - off[i], kind)


def _ordered(table: pa.Table) -> pa.Table:
    return table.combine_chunks()


def _anchor_entries(kind: Kind, buckets: int):
    def run(key, table):
        block = key[0].as_py()
        parts = [scan.anchors() for _, _, scan in _scans(_ordered(table), kind)]
        vals = np.concatenate([np.zeros(0, np.uint64), *(p[0] for p in parts)])
        flag = np.concatenate([np.zeros(0, bool), *(p[1] for p in parts)]).astype(np.uint8)
        kin = np.concatenate([np.zeros(0, np.uint16), *(p[2] for p in parts)])
        order = np.argsort(vals, kind="stable")
        vals, flag, kin = vals[order], flag[order], kin[order]
        at = np.flatnonzero(np.append(True, vals[1:] != vals[:-1])) if len(vals) else np.zeros(0, np.int64)
        if len(at):
            times = np.diff(np.append(at, len(vals)))
            vals, flag, kin = vals[at], np.maximum(np.maximum.reduceat(flag, at), (times > 1).astype(np.uint8)), np.minimum.reduceat(kin, at)
        bucket = (vals % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        vals, flag, kin, bucket = vals[order], flag[order], kin[order], bucket[order]
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        stop = np.append(cut[1:], len(bucket))
        rows = [vals[a:b].tobytes() + kin[a:b].tobytes() + flag[a:b].tobytes() for a, b in zip(cut, stop)]
        return pa.table({"bucket": pa.array(bucket[cut].astype(np.int32)), "block": pa.array(np.full(len(cut), block, np.int32)), "payload": pa.array(rows, pa.binary())})

    return run


def _homes(table):
    blocks = table["block"].to_numpy()
    parts = [x.as_py() for c in table["payload"].chunks for x in c]
    sizes = np.array([len(p) // 11 for p in parts], dtype=np.int64)
    vals = np.concatenate([np.frombuffer(p, np.uint64, n) for p, n in zip(parts, sizes)])
    kin = np.concatenate([np.frombuffer(p, np.uint16, n, 8 * n) for p, n in zip(parts, sizes)])
    flag = np.concatenate([np.frombuffer(p, np.uint8, n, 10 * n) for p, n in zip(parts, sizes)])
    owner = np.repeat(blocks, sizes)
    del parts
    order = np.argsort(vals, kind="stable")
    vals, flag, owner, kin = vals[order], flag[order], owner[order], kin[order]
    new = np.append(True, vals[1:] != vals[:-1])
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    size = np.diff(np.append(at, len(vals)))
    seen = (size > 1) | (np.maximum.reduceat(flag, at) > 0)
    # the home is the holder with the least hash; kin documents seed the hash, so that
    # neighbouring anchors agree, while passages held everywhere spread over all blocks
    kin = np.minimum.reduceat(kin, at)[group]
    turn = K.mix(owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + kin.astype(np.uint64))
    first = np.minimum.reduceat(turn, at)[group] == turn
    home = np.empty(len(at), dtype=owner.dtype)
    home[group[first]] = owner[first]
    keep = seen[group]
    vals, owner, home = vals[keep], owner[keep], home[group][keep]
    order = np.argsort(owner, kind="stable")
    vals, owner, home = vals[order], owner[order], home[order]
    cut = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    stop = np.append(cut[1:], len(owner))
    rows = [vals[a:b].tobytes() + home[a:b].astype(np.int32).tobytes() for a, b in zip(cut, stop)]
    return pa.table({"block": pa.array(owner[cut].astype(np.int32)), "kind": pa.array(np.full(len(cut), HOMES, np.int32)), "payload": pa.array(rows, pa.binary())})


def _known(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Recurring anchors of a block, sorted, and their homes."""
    vals, home = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for kind, payload in zip(table["kind"].to_pylist(), (x for c in table["payload"].chunks for x in c)):
        if kind == HOMES:
            raw = payload.as_py()
            n = len(raw) // 12
            vals.append(np.frombuffer(raw, np.uint64, n))
            home.append(np.frombuffer(raw, np.int32, n, 8 * n))
    vals, home = np.concatenate(vals), np.concatenate(home)
    order = np.argsort(vals)
    return vals[order], home[order]


def _key_of(body: bytes) -> bytes:
    import hashlib

    return hashlib.blake2b(body, digest_size=16).digest()


def _segments(kind: Kind):
    def run(key, docs, replies):
        rows: dict[tuple[int, bytes], list[int]] = {}
        if docs.num_rows and replies.num_rows:
            block = docs["block"][0].as_py()
            known, home = _known(replies)
            docs = _ordered(docs)
            ids = _ids(docs)
            for i, _, scan in _scans(docs, kind):
                owner = None
                for a, b, to in scan.segments(known, home):
                    if owner is None:
                        owner = scan.first
                    d = int(np.searchsorted(owner, a, side="right")) - 1
                    here = (int(ids[i + d]), a - int(owner[d]))
                    at = rows.setdefault((to, scan.body(a, b)), [*here, 0])
                    if here < (at[0], at[1]):
                        at[0], at[1] = here
                    at[2] += 1
        n = len(rows)
        return pa.table({
            "home": pa.array([k[0] for k in rows], pa.int32()), "block": pa.array([block] * n if n else [], pa.int32()),
            "doc_id": pa.array([v[0] for v in rows.values()], pa.int64()), "start": pa.array([v[1] for v in rows.values()], pa.int64()),
            "many": pa.array([v[2] > 1 for v in rows.values()], pa.bool_()), "body": pa.array([k[1] for k in rows], pa.binary()),
        })

    return run


#: A run of windows whose earliest places follow each other: from this window on, earliest = (doc, base + window).
RUN = np.dtype([("since", np.int64), ("doc", np.int64), ("base", np.int64)])


def runs_of(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    base = start - np.arange(len(start))
    cut = np.ones(len(doc), dtype=bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (base[1:] != base[:-1])
    at = np.flatnonzero(cut)
    out = np.empty(len(at), dtype=RUN)
    out["since"], out["doc"], out["base"] = at, doc[at], base[at]
    return out


def _resolved(kind: Kind):
    def run(key, table):
        home = key[0].as_py()
        blocks, docs, starts, many = (table[c].to_numpy() for c in ("block", "doc_id", "start", "many"))
        encoded = table["body"].dictionary_encode().unify_dictionaries()
        code = np.concatenate([c.indices.to_numpy() for c in encoded.chunks])
        texts = encoded.chunk(0).dictionary.to_pylist()
        count = np.bincount(code) + np.bincount(code[many], minlength=len(texts))
        here = np.zeros(len(texts), dtype=bool)
        here[code[blocks == home]] = True
        order = np.lexsort((starts, docs, code))
        first = order[np.flatnonzero(np.append(True, np.diff(code[order]) > 0))]
        bodies = [Body(*b) for b in zip(texts, docs[first].tolist(), starts[first].tolist(), count.tolist(), here.tolist())]
        verdicts = kind.resolve(bodies)
        single = np.array([len(runs) == 1 for runs in verdicts])
        lead = np.array([runs[0] for runs in verdicts], dtype=RUN)
        own = single[code] & (lead["doc"][code] == docs)
        if not kind.strict_document:
            own &= lead["base"][code] == starts
        replies = [_key_of(text) + np.int64(len(runs)).tobytes() + runs.tobytes() for text, runs in zip(texts, verdicts)]
        out: dict[int, list[bytes]] = {}
        for i in np.flatnonzero(many | ~own).tolist():
            out.setdefault(int(blocks[i]), []).append(replies[code[i]])
        return pa.table({"block": pa.array(list(out), pa.int32()), "kind": pa.array([VERDICTS] * len(out), pa.int32()), "payload": pa.array([b"".join(x) for x in out.values()], pa.binary())})

    return run


def _verdicts(table: pa.Table) -> dict[bytes, np.ndarray]:
    found = {}
    for kind, payload in zip(table["kind"].to_pylist(), (x for c in table["payload"].chunks for x in c)):
        if kind != VERDICTS:
            continue
        raw, at = payload.as_py(), 0
        while at < len(raw):
            n = int(np.frombuffer(raw, np.int64, 1, at + 16)[0])
            found[raw[at : at + 16]] = np.frombuffer(raw, RUN, n, at + 24)
            at += 24 + n * RUN.itemsize
    return found


def _applied(kind: Kind):
    w = kind.width

    def run(key, docs, replies):
        out: dict[str, list] = {f.split()[0]: [] for f in RESULT.split(", ")}
        if docs.num_rows:
            known, home = _known(replies)
            verdict = _verdicts(replies)
            docs = _ordered(docs)
            ids, null_id = _ids(docs), docs["doc_id"].is_null().to_pylist()
            null_text = docs["text"].is_null().to_pylist()
            for i, j, scan in _scans(docs, kind):
                gone = np.zeros(scan.n + 1, dtype=np.int64)
                for a, b, _ in scan.segments(known, home):
                    runs = verdict.get(_key_of(scan.body(a, b)))
                    if runs is None:
                        continue
                    d = int(np.searchsorted(scan.first, a, side="right")) - 1
                    doc, start = int(ids[i + d]), a - int(scan.first[d])
                    upto = np.append(runs["since"][1:], b - a)
                    for r, stop in zip(runs, upto.tolist()):
                        if r["doc"] < doc or (not kind.strict_document and r["doc"] == doc and r["base"] < start):
                            gone[a + int(r["since"])] += 1
                            gone[a + stop + w - 1] -= 1
                hit = np.cumsum(gone[:-1]) > 0
                for d in range(j - i):
                    x, y = int(scan.first[d]), int(scan.first[d + 1])
                    mine = hit[x:y]
                    step = np.diff(np.concatenate([[0], mine.view(np.int8), [0]]))
                    a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                    out["doc_id"].append(None if null_id[i + d] else int(ids[i + d]))
                    out["null_text"].append(null_text[i + d])
                    out["n_units"].append(y - x)
                    out["n_removed"].append(int(mine.sum()))
                    out["n_spans"].append(len(a))
                    out["spans"].append(np.stack([a, b], axis=1).astype(np.int64).tobytes())
                    out["kept"].append(_kept(scan, x, y, mine))
        kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
        return pa.table({f.split()[0]: pa.array(out[f.split()[0]], kinds[f.split()[1]]) for f in RESULT.split(", ")})

    return run


def _kept(scan: Scan, x: int, y: int, gone: np.ndarray) -> bytes:
    if not scan.kind.words:
        part = scan.buf[x:y]
        return (part[~gone] if gone.any() else part).tobytes()
    if x == y:
        return b""
    raw = scan.buf[scan.start[x] : scan.end[y - 1]]
    words = raw.tobytes().split()  # bytes.split() parts at exactly the six space characters
    return b" ".join(words if not gone.any() else [w for w, g in zip(words, gone.tolist()) if not g])


def earlier_windows_removed(docs: DataFrame, kind: Kind, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of RESULT, one for each row of ``docs`` (doc_id, text)."""
    total = text_bytes(docs)
    blocks = pieces(total, block_bytes)
    buckets = max(pieces(total, BUCKET_BYTES, most=MANY_BUCKETS), total // LARGEST_BUCKET_BYTES)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"))
    entries = dealt.groupBy("block").applyInArrow(_anchor_entries(kind, buckets), ENTRY)
    homes = entries.groupBy("bucket").applyInArrow(_homes, REPLY)
    segments = dealt.groupBy("block").cogroup(homes.groupBy("block")).applyInArrow(_segments(kind), SEGMENT)
    verdicts = segments.groupBy("home").applyInArrow(_resolved(kind), REPLY)
    replies = homes.unionByName(verdicts)
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_applied(kind), RESULT)
