"""Byte and word windows against brute force."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import byte_dedup, substring_dedup
from tidemark.llm.byte_dedup import RunLengthIndex, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 1 << 62


def brute_bytes(rows):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: LAST if r[0] is None else r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - 99):
            if seen.setdefault(b[a : a + 100], (i, a)) != (i, a):
                gone[a : a + 100] = b"\1" * 100
        runs = sum(1 for x in range(len(b)) if gone[x] and not (x and gone[x - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


def brute_words(rows):
    first = {}
    rows = [(LAST if i is None else i, WORD.findall(t or "")) for i, t in rows]
    for i, w in rows:
        for a in range(len(w) - 12):
            k = tuple(w[a : a + 13])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, w in rows:
        gone = [False] * len(w)
        for a in range(len(w) - 12):
            if first[tuple(w[a : a + 13])] < i:
                gone[a : a + 13] = [True] * 13
        out[None if i == LAST else i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


def test_byte_strings(docs, corpus):
    out = byte_dedup.remove_repeated_strings(docs(corpus)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256))
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == brute_bytes(corpus)


def test_word_windows(docs, corpus):
    rows = substring_dedup.remove_repeated_phrases(docs(corpus)).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256((r["kept_text"] or "").encode()).hexdigest()) for r in rows}
    assert got == brute_words(corpus)
    assert next(r for r in rows if r["doc_id"] == 60)["kept_text"] is None


def test_equal_ids_and_rows(docs):
    w = " ".join(f"w{i}" for i in range(20))
    rows = substring_dedup.remove_repeated_phrases(docs([(1, w), (1, w), (2, w)])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in rows) == [(1, 0), (1, 0), (2, 20)]
    b = "".join(chr(97 + i % 26) + str(i) for i in range(60))
    rows = byte_dedup.remove_repeated_strings(docs([(1, b), (1, b), (2, b)])).collect()
    assert sorted((r["doc_id"], r["n_removed"] > 0) for r in rows) == [(1, False), (1, False), (2, True)]


def test_texts_of_equal_and_null_ids(docs, corpus):
    # ids that many different texts share; the first text of an id alone holds what its later rows repeat
    tail = " ".join(f"t{i}" for i in range(30))
    rows = [(7, t) for _, t in corpus[:12]] + [(None, t) for _, t in corpus[12:24]] + [(8, "a " + tail), (None, "b " + tail), (None, "c " + tail)]
    got = substring_dedup.remove_repeated_phrases(docs(rows)).select("doc_id", "kept_text").collect()
    first = {}
    split = [(LAST if i is None else i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for a in range(len(w) - 12):
            first[tuple(w[a : a + 13])] = min(first.get(tuple(w[a : a + 13]), i), i)
    want = []
    for i, w in split:
        gone = {k for a in range(len(w) - 12) if first[tuple(w[a : a + 13])] < i for k in range(a, a + 13)}
        want.append((i, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert sorted((LAST if r[0] is None else r[0], r[1]) for r in got) == sorted(want)
    out = byte_dedup.remove_repeated_strings(docs(rows)).select("doc_id", "n_bytes", "n_removed").collect()
    assert len(out) == len(rows)
    places, want = {}, []
    data = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for a in range(len(b) - 99):
            places[b[a : a + 100]] = min(places.get(b[a : a + 100], (i, a)), (i, a))
    for i, b in data:
        gone = {k for a in range(len(b) - 99) if places[b[a : a + 100]] < (i, a) for k in range(a, a + 100)}
        want.append((i, len(b), len(gone)))
    assert sorted((LAST if r[0] is None else r[0], r[1], r[2]) for r in out) == sorted(want)


def test_long_texts(docs):
    # several scan chunks and more than a block; the copy begins elsewhere
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, long), (2, "other words first " + long), (3, "x" * 150_000)]
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeated_phrases(docs(rows)).collect()}
    assert [(got[i]["n_words"], got[i]["n_removed"]) for i in (1, 2, 3)] == [(200_000, 0), (200_003, 200_000), (1, 0)]
    assert got[2]["kept_text"] == "other words first"
    got = {r["doc_id"]: r for r in byte_dedup.remove_repeated_strings(docs(rows)).collect()}
    assert [(got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) for i in (1, 2, 3)] == [(len(long), 0, 0), (len(long) + 18, len(long), 1), (150_000, 149_999, 1)]


@pytest.mark.parametrize("remove", [byte_dedup.remove_repeated_strings, substring_dedup.remove_repeated_phrases])
def test_empty_table(docs, remove):
    assert remove(docs([(1, "a")]).limit(0)).count() == 0


def test_suffix_array_and_matching_statistics():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 3, 400).astype(np.int16)
    text[100:200] = text[:100]
    want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert suffix_array(text).tolist() == want
    parts = [bytes(rng.integers(97, 100, 300).astype(np.uint8)), b"ab" * 120, bytes(rng.integers(0, 3, 200).astype(np.uint8))]
    index = RunLengthIndex(parts)
    queries = [parts[0][37:250] + b"zzz" + parts[1][:140], b"q" * 150, b"ab" * 400, parts[2]]
    whole = [p[a : a + 100] for p in parts for a in range(len(p) - 99)]
    for q, found in zip(queries, index.stream(queries)):
        for a, p in enumerate(found.tolist()):
            there = q[a : a + 100] in whole
            assert (p >= 0) == there
            if there:
                k = int(np.searchsorted(index.first, p, side="right")) - 1
                assert parts[k][p - index.first[k] :][:100] == q[a : a + 100]


def test_periodic_text_of_another_block_repeats_in_itself():
    # a home that holds the anchor only inside its own text, and one foreign run that holds a window many times
    words = " ".join(f"w{i}" for i in range(40)).encode()
    home = words + b"=" * 95 + words
    phrase = b"thirty bytes of a phrase, yes "
    for foreign in (b"=" * 110, phrase * 5):
        bodies = [byte_dedup.Body(home, 1, 0, 1, True), byte_dedup.Body(foreign, 2, 0, 1, False)]
        runs = byte_dedup.resolve_by_index(bodies)[1]
        upto = [*runs["since"][1:].tolist(), len(foreign) - 99]
        got = [(int(r["doc"]), int(r["base"]) + a) for r, stop in zip(runs, upto) for a in range(int(r["since"]), stop)]
        seen = {}
        assert got == [seen.setdefault(foreign[a : a + 100], (2, a)) for a in range(len(foreign) - 99)]
