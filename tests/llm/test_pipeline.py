import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from test_near_and_lines import WORD, brute_lines, sets_of

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_pipeline_runs_and_keeps_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, function in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(function(spark, docs, FOLDER), name.replace(" ", "-"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns and 0 < docs.count() <= n
            n = docs.count()
    assert docs.where("words_taken <= 0").count() == 0 and set(columns) < set(docs.columns)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_line_dedup_matches_sql(spark):
    from tidemark.llm import registry

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    got = registry.queries()["op7_line_dedup"](spark, FOLDER)
    want = con.sql(registry.oracle_sql()["op7_line_dedup"])
    columns = sorted(got.columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.select(", ".join(columns)).fetchall())


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)) and "pipeline" in names


def features_of(text):
    w = WORD.findall(text or "")
    n, chars = max(1, len(w)), max(1, sum(map(len, w)))
    times = Counter(tuple(w[a : a + 5]) for a in range(len(w) - 4))
    repeat = len({x for a in range(len(w) - 4) if times[tuple(w[a : a + 5])] > 1 for x in range(a, a + 5)})
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    count = lambda p: len(re.findall(p, text or ""))
    of = {
        "words": len(w), "mean_word": sum(map(len, w)) / n, "symbols_per_word": count(r"[#*$%&|<>]") / n, "dup_line_share": (len(lines) - len(set(lines))) / max(1, len(lines)), "repeat_share": repeat / n,
        "upper_share": sum(c.isupper() for c in text or "") / chars, "marks_per_word": count("[!?]") / n, "digit_share": count("[0-9]") / chars, "distinct_share": len(set(w)) / n,
    }
    return of, len(w) < 10 or 100 * repeat > 20 * len(w)


def least_edits(piece, text):
    """Fewest edits that turn the piece into some part of the text, cell by cell."""
    cost = [0] * (len(text) + 1)
    for i, c in enumerate(piece, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(cost[j - 1] + (c != d), cost[j] + 1, now[-1] + 1))
        cost = now
    return min(cost)


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tidemark.llm import mixing, quality_rules

    r = random.Random(11)
    text = lambda n: " ".join(f"{r.choice('abcdefgh')}{r.choice('rstuv')}{r.randint(0, 60)}" for _ in range(n))
    item = " ".join(text(20).split())
    shared = text(8)
    rows = [(i, text(30) + "\n" + text(25) + ("\n" + shared if i % 4 == 0 else ""), f"s{i % 4}") for i in range(60)]
    rows = [(i, " ".join(w + "###" for w in t.split(" ")) if i % 4 == 3 else t, s) for i, t, s in rows]
    rows += [(70, rows[2][1], "s1"), (71, rows[9][1].replace("a", "b", 1), "s2"), (72, text(25) + " " + item + " " + text(10), "s0"), (73, text(25) + " " + item[:30] + "x" + item[30:] + " " + text(12), "s0"), (74, None, "s1"), (75, "", None), (76, text(40), None)]
    one = text(60)
    rows += [(80, one, "s3"), (81, one.replace(one.split()[30], "zz", 1), "s3")]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 != 3), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    folder = str(tmp_path)
    frame = spark.read.parquet(folder + "/documents.parquet")
    rules = quality_rules.fit(frame, spark.read.parquet(folder + "/labels.parquet"))
    steps = []
    for name, function in corpus_pipeline.STAGES:
        frame = corpus_pipeline.stage(function(spark, frame, folder), "t")
        steps.append(frame.collect())

    def rejected(t):
        of, failed = features_of(t)
        return failed or any(all(of[c.name] >= c.threshold if c.above else of[c.name] <= c.threshold for c in rule) for rule in rules.rules)

    want = {i: (t, s) for i, t, s in rows if not rejected(t)}
    assert {x["doc_id"] for x in steps[0]} == set(want) and rules.rules
    cut = brute_lines([(i, t) for i, (t, _) in want.items()])
    want = {i: (cut[i][1], s) for i, (t, s) in want.items() if not cut[i][0] or WORD.search(cut[i][1])}
    assert {x["doc_id"]: (x["text"], x["source"]) for x in steps[1]} == want and all(x["n_chars"] == len(x["text"]) for x in steps[1])
    sets, head = sets_of([(i, t) for i, (t, _) in want.items()]), {i: i for i in want}
    for _ in want:
        for a in want:
            for b in want:
                if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    head[a] = head[b] = min(head[a], head[b])
        if all(head[head[a]] == head[a] for a in want):
            break
    want = {i: v for i, v in want.items() if head[i] == i}
    assert {x["doc_id"] for x in steps[2]} == set(want) and 81 not in want
    clean = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t).lower()
    want = {i: v for i, v in want.items() if least_edits(clean(item), clean(v[0])) > int(len(item) * 0.05)}
    assert {x["doc_id"] for x in steps[3]} == set(want) and not {72, 73} & set(want)
    size, taken = defaultdict(int), defaultdict(int)
    for i, (t, s) in want.items():
        size[s] += len(WORD.findall(t))
    for x in steps[4]:
        taken[x["source"]] += x["words_taken"]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    targets = mixing.fill_targets([size[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))], 1.5 * sum(size.values()))
    assert all(abs(taken[s] - t) <= 1 for s, t in zip(order, targets)) and all(want[x["doc_id"]][0] == x["text"] for x in steps[4])


def edge_rows():
    """Null ids and texts, equal rows, rows of one id, very long texts, and no words at all."""
    r = random.Random(5)
    text = lambda n: " ".join(f"{r.choice('abcdefgh')}{r.choice('rstuv')}{r.randint(0, 900)}" for _ in range(n))
    a, b, far = text(60), text(70), text(300_000)
    rows = [(1, a, "s0"), (1, a, "s0"), (1, a, "s1"), (2, b, None), (2, text(40), "s1"), (None, b, "s0"), (None, None, None), (3, None, "s1"), (4, "", "s1"), (5, " \t\n\n", "s0"), (6, far, "s0"), (7, far + " end", "s1"), (8, "x" * 2_000_000, "s0")]
    return rows + [(20 + i, text(50), f"s{i % 3}") for i in range(12)]


@pytest.fixture
def edges(spark, tmp_path):
    """The frame, with columns whose names clash with what stages add, and a folder with labels and a benchmark."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, words_taken string, shard string, block int, gone int, size string, items string"
    spark.createDataFrame([(i, i % 2, 0) for i in range(20, 32)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, "a passage that is in no document of this kind at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), f"w{k}", "h", k, 7, "z", "i") for k, (i, t, s) in enumerate(edge_rows())], schema), str(tmp_path)


@pytest.mark.parametrize("nth", range(5))
def test_stages_on_edges(spark, edges, nth):
    import corpus_pipeline

    frame, folder = edges
    name, function = corpus_pipeline.STAGES[nth]
    out = function(spark, frame, folder)
    rows = out.collect()
    texts = Counter((r.doc_id, r.text) for r in rows)
    given = Counter((i, t) for i, t, _ in edge_rows())
    if nth < 4:
        assert out.columns == frame.columns and set(texts) <= set(given) | {(r.doc_id, r.text) for r in rows if nth == 1}
        assert {r.words_taken[0] for r in rows} == {"w"} and {r.gone for r in rows} == {7}
    if nth == 0:  # too few words, or none: rejected; a null id is a document like others
        assert not {(None, None), (3, None), (4, ""), (5, " \t\n\n")} & set(texts) and texts[1, edge_rows()[0][1]] == 3
    if nth == 1:  # equal rows count as one text; later copies of the long line and of the null id's text are cut
        assert texts[1, edge_rows()[0][1]] == 3 and texts[2, edge_rows()[3][1]] == 1 and texts[None, edge_rows()[3][1]] == 0
    if nth == 2:  # one row of equal ones; a null id and texts without words all stay
        assert texts[1, edge_rows()[0][1]] == 1 and texts[None, None] == 1 and texts[None, edge_rows()[3][1]] == 1 and {3, 4, 5, 6} <= {i for i, _ in texts} and 7 not in {i for i, _ in texts}
    if nth == 3:
        assert texts == given
    if nth == 4:
        assert set(frame.columns) < set(out.columns) and set(texts) <= set(given) and all(n <= 2 * given[k] for k, n in texts.items())
    empty = function(spark, frame.limit(0), folder)
    assert empty.collect() == [] and empty.columns == out.columns
    again = Counter(map(repr, function(spark, frame.repartition(7), folder).collect()))
    assert again == Counter(map(repr, rows)), "reruns agree"


def test_new_queries_are_registered():
    import __spark_entry__ as entry

    assert all(any(k.startswith(f"op{n}_") for k in entry.queries()) for n in range(1, 14))
