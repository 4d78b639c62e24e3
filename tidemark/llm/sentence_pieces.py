"""SentencePiece encoding and decoding through a table of distinct chunks.

A chunk is a run of whitespace markers with the word behind it.  Where no piece of a
model holds a marker behind another character, merges never cross from a word to the
next marker, so chunks are segmented alone.  Documents are read once into blocks; a
block keeps its texts as numbers of its own distinct chunks.  The distinct chunks of
all blocks meet in hash buckets, where each is segmented once, and its ids go back to
the blocks that hold it, where they are joined to the texts by position.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.packing import packed, packed_texts, unpacked, unpacked_texts
from tidemark.llm.sizing import pieces, text_bytes
from tidemark.staging import staged_by

MARK = "▁"
#: A chunk of a text that has a space put in front; spaces that end the text belong to its last word.
CHUNK = re.compile(r" +[^ ]+(?: +\Z)?| +")
#: Text of one block, of the blocks that one task puts together, and of the input behind one bucket of chunks.
BLOCK_BYTES, HOME_BYTES, BUCKET_BYTES = 16 << 20, 32 << 20, 16 << 20


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def separable(model: bytes) -> bool:
    """Whether chunks can be segmented alone: merges by pair, texts taken as they are behind one
    marker, and no piece with a marker behind another character."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto.FromString(model)
    norm, train = m.normalizer_spec, m.trainer_spec
    plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
    return bool(train.model_type == train.BPE and not train.treat_whitespace_as_suffix and plain and not any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in m.pieces))


def _processor(model: bytes):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_proto=model)


def chunks_of(text: str, apart: bool = True) -> list[str]:
    """The chunks, each without its first marker; a text in one piece if they can't be taken apart."""
    if not text:
        return []
    return [c[1:] for c in CHUNK.findall(" " + text.replace(MARK, " "))] if apart else [text]


SPLIT = [("block", "long"), ("doc_ids", None), ("sizes", "binary"), ("sequence", "binary"), ("bucket", "int"), ("numbers", "binary"), ("chunks", "binary")]


def _splitter(buckets: int, apart: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks: one row with the documents' ids, lengths and chunk numbers, and a row for each
    bucket that the block has distinct chunks for, their numbers as steps.  Commoner chunks
    have smaller numbers."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth, held = TaskContext.get().partitionId() << 32, 0
        number: dict[str, int] = {}
        ids: list[pa.Array] = []
        codes: list[np.ndarray] = []

        def block() -> Iterator[pa.RecordBatch]:
            names = pa.array(list(number), pa.string())
            every = np.concatenate(codes) if codes else np.empty(0, dtype=np.int64)
            order = np.argsort(-np.bincount(every, minlength=len(number)), kind="stable")
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            owner = pa.chunked_array(ids).combine_chunks()
            lists = pa.ListArray.from_arrays(pa.array([0, len(owner)], pa.int32()), owner)
            sizes = packed(np.array([len(c) for c in codes], dtype=np.int32))
            none = lambda kind, n: pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays([pa.array([nth]), lists, pa.array([sizes]), pa.array([packed(rank[every].astype(np.int32))]), none(pa.int32(), 1), none(pa.binary(), 1), none(pa.binary(), 1)], names=[c for c, _ in SPLIT])
            if not number:
                return
            home = np.fromiter((zlib.crc32(c.encode()) % buckets for c in number), dtype=np.int64, count=len(number))
            by = np.lexsort((rank, home))
            cut = np.flatnonzero(np.append(True, home[by][1:] != home[by][:-1]))
            ends = np.append(cut, len(by))
            n, texts = len(cut), names.take(pa.array(by))
            some = [packed(np.diff(rank[by[a:b]], prepend=0)) for a, b in zip(ends[:-1], ends[1:])]
            texts = pa.array([packed_texts(texts.slice(a, b - a)) for a, b in zip(ends[:-1], ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([nth] * n, pa.int64()), none(lists.type, n), none(pa.binary(), n), none(pa.binary(), n), pa.array(home[by[cut]], pa.int32()), pa.array(some), texts], names=[c for c, _ in SPLIT])

        for batch in batches:
            at = 0
            for i, text in enumerate(batch.column("text").to_pylist()):
                codes.append(np.array([number.setdefault(c, len(number)) for c in chunks_of(text or "", apart)], dtype=np.int64))
                held += len(text or "") + 1
                if held >= BLOCK_BYTES:
                    ids.append(batch.column("doc_id").slice(at, i + 1 - at))
                    yield from block()
                    nth, at, held = nth + 1, i + 1, 0
                    number.clear(), ids.clear(), codes.clear()
            if at < batch.num_rows:
                ids.append(batch.column("doc_id").slice(at))
        if codes:
            yield from block()

    return split


SEGMENTED = "block long, numbers binary, lengths binary, ids binary"


def _segmenter(model) -> Callable[[pa.Table], pa.Table]:
    """Each distinct chunk of a bucket is segmented once; every block gets the ids of its own."""

    def segment(rows: pa.Table) -> pa.Table:
        lists = [unpacked_texts(b) for b in rows.column("chunks").to_pylist()]
        every = pa.concat_arrays(lists).dictionary_encode()
        found = _processor(model.value).encode(every.dictionary.to_pylist(), num_threads=1)
        length = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = np.fromiter((i for ids in found for i in ids), dtype=np.int32, count=int(length.sum()))
        start = np.cumsum(length) - length
        which, at = every.indices.to_numpy(), 0
        out: list[tuple[bytes, bytes]] = []
        for n in map(len, lists):
            own = which[at : at + n]
            out.append((packed(length[own].astype(np.int32)), packed(flat[_spread(start[own], length[own])])))
            at += n
        return pa.table({"block": rows.column("block"), "numbers": rows.column("numbers"), "lengths": pa.array([a for a, _ in out], pa.binary()), "ids": pa.array([b for _, b in out], pa.binary())})

    return segment


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places from each start on, as many as its length, one after the other."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(int(length.sum()))


def _joiner(model, eos: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block's texts as ids by position, and decoded from the ids, chunk by chunk."""

    def join(docs: pa.Table, answers: pa.Table) -> pa.Table:
        sp = _processor(model.value)
        read = lambda c: [unpacked(b) for b in answers.column(c).to_pylist()]
        none = [np.empty(0, dtype=np.int32)]
        number = np.concatenate([np.cumsum(steps) for steps in read("numbers")] + none)
        length = np.concatenate(read("lengths") + none).astype(np.int64)
        flat = np.concatenate([*read("ids"), *none, np.array([sp.eos_id()] if eos else [], dtype=np.int32)])
        place = np.argsort(number)
        length_of, start_of = length[place], (np.cumsum(length) - length)[place]
        listed = flat.tolist()
        text_of = pa.array(sp.decode([listed[a : a + n] for a, n in zip(start_of.tolist(), length_of.tolist())]) if len(number) else [], pa.string())
        end = len(number)
        if eos:
            length_of, start_of = np.append(length_of, 1), np.append(start_of, len(flat) - 1)
        parts = []
        for row in docs.select(["doc_ids", "sizes", "sequence"]).to_batches():
            for i in range(row.num_rows):
                sizes, sequence = unpacked(row.column("sizes")[i].as_py()).astype(np.int64), unpacked(row.column("sequence")[i].as_py())
                ends = np.cumsum(sizes)
                words = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), text_of.take(pa.array(sequence)))
                whole = np.insert(sequence, ends, end) if eos else sequence
                counts = np.append(0, np.cumsum(length_of[whole]))
                borders = counts[np.append(0, ends + (np.arange(len(ends)) + 1 if eos else 0))]
                ids = pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(flat[_spread(start_of[whole], length_of[whole])]))
                parts.append(pa.table({"doc_id": row.column("doc_ids")[i].values, "ids": ids, "decoded": pc.binary_join(words, " ")}))
        return pa.concat_tables(parts)

    return join


def encode(docs: DataFrame, model_path: str, eos: bool = True) -> DataFrame:
    """Every text's ids as the library encodes it, and the text that the ids decode to.

    Input: doc_id, text; other columns are ignored, whatever their names.  Output, one row
    for each input row, repeated ones too: doc_id, ids (array of int, with an end id if
    eos), decoded.  A null or empty text has the end id alone and decodes to the empty text;
    a null doc_id stays null.  A text is never cut, however long; a word of any length is one
    chunk.  A model whose pieces may cross markers, or that rewrites texts, gets each
    distinct text as one chunk.  The model is read at the driver and sent to the workers.
    """
    spark = docs.sparkSession
    raw = read_model(model_path)
    model, total = spark.sparkContext.broadcast(raw), text_bytes(docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join(f"{c} {t or f'array<{kind}>'}" for c, t in SPLIT)
    split = rows.mapInArrow(_splitter(pieces(total, BUCKET_BYTES), separable(raw)), schema)
    blocks = staged_by(split, "chunked", "block", pieces(total, HOME_BYTES))
    table = blocks.where("chunks is not null").select("block", "bucket", "numbers", "chunks")
    segmented = table.groupBy("bucket").applyInArrow(_segmenter(model), SEGMENTED)
    texts = blocks.where("doc_ids is not null").select("block", "doc_ids", "sizes", "sequence")
    return texts.groupBy("block").cogroup(segmented.groupBy("block")).applyInArrow(_joiner(model, eos), T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]))


def decode(rows: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """The rows with ``decoded``, what the library makes of their ids; null ids give null."""
    model = rows.sparkSession.sparkContext.broadcast(read_model(model_path))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(model.value)
        for b in batches:
            texts = [None if x is None else sp.decode(x) for x in b.column(ids).to_pylist()]
            yield b.append_column("decoded", pa.array(texts, pa.string()))

    return rows.mapInArrow(decoded, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


#: The registered query's model.
MODEL = "piece_bpe_32k.model"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(MODEL))
    digest = lambda c: F.sha2(c, 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join("ids", " ")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))
