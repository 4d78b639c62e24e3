import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, ngram_join
from tidemark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        out[i] = {tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def test_join_against_all_pairs(docs, corpus):
    rows = [r for r in corpus if r[0] is not None]
    long = " ".join(f"x{i}" for i in range(200))
    rows += [(100 + k, long.replace(f"x{k * 7} ", f"y{k} ")) for k in range(12)]
    s = sets_of(rows)
    up = {i: i for i in s}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    links = Counter()
    for a in s:
        for b in s:
            if a < b and s[a] and 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b]):
                links[a] += 1
                links[b] += 1
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(docs(rows)).collect()}
    assert got == {i: (root(i), links[i]) for i in s}
    kept = ngram_join.one_of_each(docs(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in s if root(i) == i) and kept.columns == docs(rows).columns


def test_join_edge_rows(docs):
    near = ngram_join.near_duplicates(docs([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, "")]))
    got = sorted(((r["doc_id"] or -1), r["class_id"], r["n_links"]) for r in near.collect())
    assert got == [(-1, 1, 2), (1, 1, 2), (1, 1, 2), (2, 2, 0), (3, 3, 0)]
    assert ngram_join.near_duplicates(docs([(1, "a")]).limit(0)).count() == 0


def test_banding_meets_its_recall():
    bands, rows = ngram_join.banding()
    assert 1 - (1 - 0.8**rows) ** bands >= ngram_join.RECALL and bands <= ngram_join.MOST_BANDS


@pytest.mark.parametrize("members,size", [(8, 64 << 20), (512, 4000)])
def test_large_cluster_is_cut_into_chunks(docs, monkeypatch, members, size):
    """By its members, or by the bytes of their sets."""
    monkeypatch.setattr(ngram_join, "CHUNK", members)
    monkeypatch.setattr(ngram_join, "CHUNK_BYTES", size)
    long = " ".join(f"x{i}" for i in range(120))
    rows = [(k, long.replace(f"x{k * 3} ", f"y{k} ")) for k in range(30)]
    s = sets_of(rows)
    links = {a: sum(1 for b in s if b != a and 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b])) for a in s}
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(docs(rows)).collect()}
    assert got == {a: (0, links[a]) for a in s}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 90, 90: 90, 95: 90, 200: 200, 201: 200}


def brute_lines(rows):
    solid = {i: [(p, x) for p, x in enumerate((t or "").split("\n")) if WORD.search(x)] for i, t in rows}
    one, two = {}, {}
    for i in sorted(solid):
        for n, (_, x) in enumerate(solid[i]):
            one.setdefault(x, (i, n))
            if n + 1 < len(solid[i]):
                two.setdefault((x, solid[i][n + 1][1]), (i, n))
    out = {}
    for i, t in rows:
        gone = set()
        for n, (_, x) in enumerate(solid[i]):
            if one[x] < (i, n) and len(WORD.findall(x)) >= 5:
                gone.add(n)
            if n + 1 < len(solid[i]) and two[(x, solid[i][n + 1][1])] < (i, n):
                gone |= {n, n + 1}
        cut = {solid[i][n][0] for n in gone}
        out[i] = (len(gone), None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in cut))
    return out


def test_lines_against_brute_force(docs, corpus):
    rows = [r for r in corpus if r[0] is not None]
    rows += [(200, "a\nb\nc\n\nd"), (201, "z\na\nb\nc\nd\nq"), (202, "a\na\na\na"), (203, "one two three four five\n\n\none two three four five")]
    frame = docs(rows)
    out, count, reach = line_dedup.without_repeats(frame)
    assert {r["doc_id"]: (r[count], r["text"]) for r in out.collect()} == brute_lines(rows)
    assert out.columns[: len(frame.columns)] == frame.columns
    assert out.where(F.col("doc_id") == 201).first()[reach] == 4


def test_runs_are_the_longest_that_start_earlier(docs):
    """Random documents over few lines, so that runs overlap, repeat within a text and are pieced from several places."""
    import random

    r = random.Random(31)
    pool = [f"line number {i} of the pool" for i in range(6)] + ["ab", "x y"]
    rows = [(i, "\n".join(r.choice(pool + [f"own {i} {k}" for k in range(2)]) for _ in range(r.randint(1, 40)))) for i in range(30)]
    rows += [(40, rows[3][1] + "\n" + rows[4][1]), (41, rows[40 - 10][1] if len(rows) > 30 else rows[5][1]), (42, "\n".join(["same old line of five words"] * 70)), (43, rows[7][1])]
    seqs = {i: t.split("\n") for i, t in rows}
    want = {}
    for i, s in seqs.items():
        for n in range(len(s)):
            best = 0
            for j, o in seqs.items():
                if j > i:
                    continue
                for m in range(len(o) if j < i else n):
                    k = 0
                    while n + k < len(s) and m + k < len(o) and s[n + k] == o[m + k]:
                        k += 1
                    best = max(best, k)
            if best > 1 or (best == 1 and len(s[n].split()) >= 5):
                want[i, n] = best
    got = {(x["d"], x["n"]): (x["run"], x["exact"]) for x in line_dedup.repeated_runs(docs(rows)).collect()}
    assert got.keys() == want.keys() and max(want.values()) > 60
    assert all(run == want[k] if exact else run <= want[k] < 2 * run for k, (run, exact) in got.items())
    out, count, reach = line_dedup.without_repeats(docs(rows))
    for x in out.collect():
        runs = {n: k for (i, n), k in want.items() if i == x["doc_id"]}
        assert x[count] == len({m for n, k in runs.items() for m in range(n, n + k)}) and (x[reach] or 0) == max(runs.values(), default=0)


def test_lines_of_long_texts(docs):
    long = "\n".join(f"line {i} of a very long text" for i in range(60_000))
    out, count, reach = line_dedup.without_repeats(docs([(1, long), (2, "first\n" + long), (3, "z" * 2_000_000)]))
    assert sorted((r["doc_id"], r[count], r[reach], len(r["text"])) for r in out.collect()) == [(1, 0, None, len(long)), (2, 60_000, 60_000, 5), (3, 0, None, 2_000_000)]


def test_lines_edge_rows(docs):
    five = "one two three four five"
    out, count, _ = line_dedup.without_repeats(docs([(1, five), (1, five), (None, five), (2, None)]))
    assert sorted((r["doc_id"] or 0, r[count]) for r in out.collect()) == [(0, 1), (1, 0), (1, 0), (2, 0)]
    assert line_dedup.without_repeats(docs([(1, "a")]).limit(0))[0].count() == 0


def test_hash_of_kept(spark):
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]


def test_join_of_repeated_and_null_ids_with_other_texts(docs):
    text = lambda p: " ".join(f"{p}{i}" for i in range(60))
    near = lambda p: text(p).replace(f"{p}0 ", "other ")
    rows = [(1, text("a")), (2, near("a")), (2, text("b")), (2, text("c")), (9, near("b")), (9, near("c")), (9, text("z"))]
    rows += [(None, text(p)) for p in "defgh"] + [(None, near("d")), (None, near("e")), (3, near("f"))]
    # text, class and links of every row
    want = [("a", 1, 1), ("a", 1, 1), ("b", 2, 1), ("c", 2, 1), ("b", 2, 1), ("c", 2, 1), ("z", 9, 0)]
    want += [("d", None, 1), ("e", None, 1), ("f", 3, 1), ("g", None, 0), ("h", None, 0), ("d", None, 1), ("e", None, 1), ("f", 3, 1)]
    got = ngram_join.near_duplicates(docs(rows)).collect()
    full = lambda x: sorted(x, key=str)
    assert full((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == full((i, c, n) for (i, _), (_, c, n) in zip(rows, want))
    kept = ngram_join.one_of_each(docs(rows))
    assert full((r["doc_id"], r["text"]) for r in kept.collect()) == full(r for r in rows if r[0] in (None, 1, 3) or r in [(2, text("b")), (2, text("c")), (9, text("z"))])


def test_one_of_a_class_of_equal_ids(docs):
    text = " ".join(f"a{i}" for i in range(60))
    rows = [(1, text), (1, text), (1, text.replace("a0 ", "b ")), (4, "one word"), (4, "one word"), (5, None), (5, None), (None, text), (None, text)]
    got = ngram_join.one_of_each(docs(rows)).collect()
    assert sorted(((r["doc_id"] or 0) for r in got)) == [0, 0, 1, 4, 5, 5]


def test_chained_cluster_is_verified_by_buckets(docs, monkeypatch):
    """Members that only a chain of others ties together: whole clusters and buckets give the same links."""
    rows = [(k, " ".join(f"x{i}" for i in range(k * 8, k * 8 + 110))) for k in range(300)]
    s = sets_of(rows)
    links = {a: sum(1 for b in range(a - 4, a + 5) if b != a and b in s and 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b])) for a in s}
    for chunk in (2, 100_000):
        monkeypatch.setattr(ngram_join, "CHUNK", chunk)
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(docs(rows)).collect()}
        assert got == {a: (0, links[a]) for a in s} and max(links.values()) == 2


def test_join_of_long_texts(docs):
    long = " ".join(f"w{i}" for i in range(400_000))
    rows = [(1, long), (2, long.replace("w7 ", "other ")), (3, long[: len(long) // 2]), (4, "x" * 2_500_000)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(docs(rows)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}


def test_hot_join(spark):
    from tidemark.llm import ordering

    left = spark.range(40_000).select(F.when(F.col("id") < 20_000, 7).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    got = ordering.hot_join(left, right, ["k"], "n", 40_000)
    assert got.count() == 40_000 and got.where("n = 20000").count() == 20_000 and got.columns == ["k", "id", "n"]
