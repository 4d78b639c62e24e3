"""Op 13 against the library on whole texts."""

import pytest

from tidemark.llm import sentence_pieces as P

tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=tokenizers.path(P.MODEL))


ODD = ["", " ", "   ", "a", " a", "a ", "a  b   ", "▁a▁ b", "x▁", "\n", "tab\tand\nline \n", "nul\0nul ﻿", "½ ﬁ é é   日本語 🙂🙂", "<s> </s> <unk> <0x41>", "  <0x0A>  ", "word " * 300, "unbroken" * 5000, " " * 3000 + "end", "  　x"]


def expected(sp, text):
    ids = sp.encode(text or "", add_eos=True)
    return ids, sp.decode(ids)


def test_ids_and_texts_equal_the_library(spark, docs, corpus, library, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_BYTES", 4000)  # several blocks a task
    rows = corpus + [(1000 + i, t) for i, t in enumerate(ODD)] + [(1, corpus[1][1]), (None, None)]
    got = P.encode(docs(rows).repartition(5), tokenizers.path(P.MODEL)).collect()
    have = sorted(((r.doc_id, r.ids, r.decoded) for r in got), key=repr)
    want = sorted(((r[0], *expected(library, r[1])) for r in rows), key=repr)
    assert have == want


def test_very_long_text(spark, docs, library):
    text = "".join(f"w{i % 977}x{i % 13} {'  ' if i % 7 == 0 else ''}" for i in range(300_000))
    (r,) = P.encode(docs([(1, text)]), tokenizers.path(P.MODEL)).collect()
    assert (r.ids, r.decoded) == expected(library, text)


def test_empty_table_and_other_id_types(spark, library):
    none = spark.createDataFrame([], "doc_id string, text string, ids string, block int")
    assert P.encode(none, tokenizers.path(P.MODEL)).collect() == []
    one = spark.createDataFrame([("k", "some text", "x", 1)], none.schema)
    assert [(r.doc_id, r.ids) for r in P.encode(one, tokenizers.path(P.MODEL), eos=False).collect()] == [("k", library.encode("some text"))]


def test_models_that_cannot_be_taken_apart_get_whole_texts(spark, docs, library, monkeypatch):
    monkeypatch.setattr(P, "separable", lambda model: False)
    rows = [(1, "a  b "), (2, None), (3, "a  b "), (4, " ▁x")]
    got = {r.doc_id: (r.ids, r.decoded) for r in P.encode(docs(rows), tokenizers.path(P.MODEL)).collect()}
    assert got == {i: expected(library, t) for i, t in rows}


def test_separable_needs_pieces_within_words(library):
    from sentencepiece import sentencepiece_model_pb2 as proto

    raw = P.read_model(tokenizers.path(P.MODEL))
    assert P.separable(raw)
    m = proto.ModelProto.FromString(raw)
    m.pieces.add(piece="a▁b", score=-9.0)
    assert not P.separable(m.SerializeToString())


def test_decode(spark, library):
    ids = library.encode("two  words ")
    df = spark.createDataFrame([(1, ids), (2, None), (3, [])], "k int, ids array<int>")
    assert {r.k: r.decoded for r in P.decode(df, tokenizers.path(P.MODEL)).collect()} == {1: "two  words ", 2: None, 3: ""}
