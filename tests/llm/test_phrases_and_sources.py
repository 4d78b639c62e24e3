"""Ops 11 and 12 against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import packing, phrases, source_divergence

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, lang string, source string, n long, p string, rank int, words string, block string"


@pytest.fixture
def frame(spark):
    def make(rows):
        return spark.createDataFrame([(*r, 1, "p", 2, "w", "b") for r in rows], COLUMNS)

    return make


@pytest.fixture
def mixed_rows():
    r = random.Random(3)
    vocabulary = ["the", "of", "NEW", "York", "city", "Ärger", "naïve", "x1", "<b>", "co-op", "the", "the"]
    rows = []
    for i in range(120):
        text = " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 40)))
        text = text.replace("city", "city" + r.choice([".", ",", "\n", "\t", " ", " ", ""]))
        rows.append((i, text, r.choice(["en", "en", "de", None]), r.choice(["a", "b", "c", None, "ü"])))
    rows += [(500, None, "en", "a"), (501, "", "fr", "only"), (502, "new york city hall", "fr", "second"), (None, "the the the the the the", "en", "a"), (0, rows[0][1], rows[0][2], rows[0][3]), (503, ". , ; :\n\n", "en", "b")]
    return rows


def mined(rows, least, top):
    f, total = Counter(), Counter()
    for _, text, lang, _ in rows:
        for piece in re.split("[.,;:!?\n\v\f\r]", (text or "").translate(SMALL)):
            w = [x for x in re.split("[ \t]", piece) if x]
            lang_ = "und" if lang is None else lang
            total[lang_] += len(w)
            for size in range(1, 6):
                for i in range(len(w) - size + 1):
                    f[lang_, tuple(w[i : i + size])] += 1
    good = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, p), a in good.items():
        if any(other == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (other, q), b in good.items()):
            continue
        cuts = [(1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


@pytest.mark.parametrize("least,top,sent", [(5, 2000, 1000), (3, 7, 0), (3, 2000, 40)])
def test_phrases_equal_plain_python(frame, mixed_rows, monkeypatch, least, top, sent):
    monkeypatch.setattr(phrases, "MOST_SENT", sent)
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 150)
    monkeypatch.setattr(phrases, "HELD_WORDS", 400)
    got = phrases.collocations(frame(mixed_rows).repartition(3), least=least, top=top)
    assert sorted(map(tuple, got.collect())) == mined(mixed_rows, least, top)


def test_one_passage_everywhere_and_a_very_long_text(frame):
    passage = "alpha beta gamma delta epsilon zeta"
    rows = [(i, f"{passage} tail{i}. {passage}", "en", "a") for i in range(60)] + [(99, "loop " * 100_000, "en", "a")]
    got = phrases.collocations(frame(rows)).collect()
    by = {r.phrase: r for r in got}
    # overlapping occurrences count, and what stands inside a longer phrase as often is left out
    assert by["loop loop loop loop loop"].a == 99_996 and by["loop loop"].a == 99_999
    assert {p for p in by if "alpha" in p or "zeta" in p} == {"alpha beta gamma delta epsilon", "beta gamma delta epsilon zeta"}
    assert by["alpha beta gamma delta epsilon"].a == 120


def test_no_phrases(frame):
    assert phrases.collocations(frame([])).collect() == []
    assert phrases.collocations(frame([(1, None, None, None), (2, "one two", "en", "a")])).collect() == []


def test_lists_round_trip():
    r = np.random.default_rng(5)
    lengths = r.integers(0, 6, 200)
    places = np.concatenate([np.sort(r.choice(1 << 28, n, replace=False)) for n in lengths]).astype(np.int32)
    assert (phrases.unlisted(phrases.listed(places, lengths), lengths) == places).all()
    a = r.integers(-(1 << 31), 1 << 31, 1000).astype(np.int32)
    assert (packing.unpacked(packing.packed(a)) == a).all() and len(packing.unpacked(packing.packed(a[:0]))) == 0


def audited(rows, least=3, top=200):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(SMALL))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        among = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t, n in among.items() if n >= least]
        count = {s: Counter(t for d in mine if d[1] == s for t in d[2] if among[t] >= least) for s in {d[1] for d in mine}}
        whole = sum(count.values(), Counter())
        share = lambda c, t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept))
        gap = lambda p, q: (p - q) ** 2 // q
        for s, c in count.items():
            pairs = [(o, sum(gap(share(c, t), share(count[o], t)) for t in kept)) for o in count if o != s]
            found = [(t, gap(share(c, t), share(whole, t))) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, items, most in (("pair", pairs, None), ("term", found, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_divergence_equals_plain_python(frame, mixed_rows, monkeypatch, broadcast):
    monkeypatch.setattr(source_divergence, "MOST_BROADCAST", broadcast)
    monkeypatch.setattr(source_divergence, "SLICES", 5)
    monkeypatch.setattr(source_divergence, "HELD_TERMS", 20)
    got = source_divergence.divergence(frame(mixed_rows).repartition(3), top=4)
    assert sorted(map(tuple, got.collect())) == audited(mixed_rows, top=4)


def test_divergence_of_few_rows_and_long_texts(frame):
    assert source_divergence.divergence(frame([])).collect() == []
    rows = [(1, None, None, None), (2, "lone", "en", "a"), (3, "", "en", "b")]
    assert sorted(map(tuple, source_divergence.divergence(frame(rows)).collect())) == audited(rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    rows = [(i, "big word " * 100_000 + f"t{i}x", "en", "ab"[i % 2]) for i in range(6)] + [(9, "Big", "en", "c")]
    assert sorted(map(tuple, source_divergence.divergence(frame(rows)).collect())) == audited(rows)


def test_shares_are_exact_for_counts_beyond_64_bit_products(spark):
    cases = [(0, 0, 1), (5, 9, 3), (10**12, 3 * 10**12, 77), (9 * 10**17, 10**18, 10**9), (4611686017, 10**11, 5)]
    df = spark.createDataFrame(cases, "c long, n long, v long")
    got = df.select("c", source_divergence.share(*(source_divergence.F.col(x) for x in "cnv")).alias("p")).collect()
    assert {r.c: r.p for r in got} == {c: 1 + 10**9 * (c + 1) // (n + v) for c, n, v in cases}
