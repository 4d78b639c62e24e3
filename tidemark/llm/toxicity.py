"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly.

Words are bags of hashed character sequences of their UTF-8 form with a boundary at
either end, so an unseen misspelling shares most of its vectors with the word it
stands for.  A document's vector is the weighted average of its sequences' vectors; a
sequence's weight falls with the share of training texts that have it, so that the
average is one of telling sequences and doesn't fade with a text's length.  A linear
softmax over it gives the score.  Embeddings and softmax are trained together by
Adagrad in numpy on a bounded sample of labelled rows, with the rare label weighted up
and both decayed, which keeps the many rare sequences from learning rows by heart.

Since the classifier is linear, a trained model is two numbers for each bucket: its
weight and the difference of the two logits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.decontaminate import normalised
from tidemark.llm.sizing import hashed_sample, stage

#: Lengths of the sequences, in bytes with boundaries.
LENGTHS = (3, 4, 5, 6)
BUCKET_BITS = 17
DIMENSION = 8
#: Labelled documents used for training at most (those of the smallest hash of the id), and
#: their text in bytes; a labelled text of more than LONGEST bytes isn't trained on.
MOST_LABELLED, MOST_BYTES, LONGEST = 6_000, 48 << 20, 1 << 20
EPOCHS, BATCHES, RATE = 30, 16, 0.05
#: The softmax sees the average this many times larger.
GAIN = 64.0
#: A sequence in a share p of the training texts weighs COMMON / (COMMON + p); one in fewer
#: than LEAST_TEXTS of them, or than a share of LEAST_SHARE, weighs nothing.
COMMON, LEAST_TEXTS, LEAST_SHARE = 0.02, 5, 0.005
#: Total weight of the toxic training rows against the others', at least their own.
BALANCE = 0.5
PENALTY = 1e-3
SEED = 5

_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[list(b".,;:!?\"()[]{}<>|/\\*#$%&_-+=~`'")] = True


def _subwords(raw: np.ndarray, texts: list[str]):
    sizes = np.array([len(t.encode()) for t in texts], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 3)])[:-1] + 1 if len(texts) else np.zeros(0, np.int64)
    buf, at = normalised(np.where(_PUNCTUATION[raw], np.uint8(32), raw), np.append(begin, len(raw)))
    n = len(buf)
    space = buf == 32
    spaces = np.concatenate([[0], np.cumsum(space)])
    word_of = spaces[1:]  # words are numbered by the spaces before them
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    number = word_of[start]
    doc = np.searchsorted(at[:-1], start, side="right") - 1
    buckets, words = [], []
    value = buf.astype(np.uint64) + np.uint64(1)
    for length in LENGTHS:
        if n < length:
            continue
        m = n - length + 1
        whole = (spaces[length - 1 : length - 1 + m] - spaces[1 : 1 + m]) == 0
        h = K.window_hash(value, length)
        i = np.flatnonzero(whole)
        buckets.append((h[i] >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
        words.append(word_of[i + 1])
    order = np.full(int(spaces[-1]) + 1, -1, dtype=np.int64)
    order[number] = np.arange(len(number))
    return (np.concatenate(buckets) if buckets else np.zeros(0, np.int32)), (order[np.concatenate(words)] if words else np.zeros(0, np.int64)), doc, len(number)


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, document, how often): the sequences of some texts, each bucket once a document."""
    bucket, word, doc, _ = _parts(texts)
    size = 1 << BUCKET_BITS
    key, times = np.unique(doc[word].astype(np.int64) * size + bucket, return_counts=True)
    return (key % size).astype(np.int32), (key // size).astype(np.int32), times.astype(np.float32)


def _parts(texts: list[str]):
    if not texts:
        z = np.zeros(0, np.int64)
        return z.astype(np.int32), z, z, 0
    return _subwords(np.frombuffer((" " + " \n ".join(texts) + " ").encode(), np.uint8), texts)


@dataclass
class Model:
    """Weight and logit difference of each bucket, and the logit difference of the empty text."""

    weight: np.ndarray
    table: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        bucket, word, doc, _ = _parts(texts)
        owner, w = doc[word], self.weight[bucket]
        total = np.bincount(owner, weights=w, minlength=len(texts))
        mean = np.bincount(owner, weights=w * self.table[bucket], minlength=len(texts)) / np.where(total > 0, total, 1)
        return 1.0 / (1.0 + np.exp(-(GAIN * mean + self.bias)))


def _pieces(texts: list[str], each: int = 1 << 18):
    """(first text, its successors' slice) of about ``each`` bytes."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= each):
            n += len(texts[j])
            j += 1
        yield i, texts[i:j]
        i = j


def train(texts: list[str], labels: np.ndarray) -> Model:
    """Joint training of embeddings and softmax; the same rows in the same order give the same model."""
    size = 1 << BUCKET_BITS
    if not len(texts) or labels.min() == labels.max():
        rate = float(np.clip(labels.mean() if len(texts) else 0.0, 1e-3, 1 - 1e-3))
        return Model(np.zeros(size), np.zeros(size), float(np.log(rate / (1 - rate))))
    # the texts are read twice, so that only sequences that count are ever held together
    texts_with = np.zeros(size, np.int64)
    for _, part in _pieces(texts):
        texts_with += np.bincount(counts(part)[0], minlength=size)
    least = max(LEAST_TEXTS, LEAST_SHARE * len(texts))
    weight = np.where(texts_with < least, 0.0, COMMON / (COMMON + texts_with / len(texts)))
    rng = np.random.default_rng(SEED)
    embed = rng.normal(0, 0.1, (size, DIMENSION))
    soft = rng.normal(0, 0.5, (2, DIMENSION))
    bias = np.zeros(2)
    toxic = int((labels == 1).sum())
    worth = np.where(labels == 1, max(1.0, BALANCE * (len(labels) - toxic) / toxic), 1.0)
    batch_of = rng.permutation(len(texts)) % BATCHES
    place = np.zeros(len(texts), np.int32)  # of a text within its batch
    for b in range(BATCHES):
        place[batch_of == b] = np.arange((batch_of == b).sum())
    held: list[list] = [[] for _ in range(BATCHES)]
    for i, part in _pieces(texts):
        bucket, doc, times = counts(part)
        live = weight[bucket] > 0
        bucket, doc, w = bucket[live], doc[live], (times[live] * weight[bucket[live]]).astype(np.float32)
        total = np.bincount(doc, weights=w, minlength=len(part))
        w = (GAIN * w / total[doc]).astype(np.float32)
        for b in np.unique(batch_of[i : i + len(part)]).tolist():
            mine = batch_of[doc + i] == b
            held[b].append((bucket[mine], place[doc[mine] + i], w[mine]))
    none = (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32))
    batches = []
    for b in range(BATCHES):
        own = [np.concatenate(x) for x in zip(none, *held[b])]
        held[b] = []
        batches.append((*own, labels[batch_of == b].astype(np.int64), worth[batch_of == b]))
    seen_embed, seen_soft, seen_bias = np.full((size, DIMENSION), 1e-8), np.full((2, DIMENSION), 1e-8), np.full(2, 1e-8)
    for _ in range(EPOCHS):
        for bucket, doc, w, y, own in batches:
            n = len(y)
            if not n:
                continue
            apart = soft[1] - soft[0]
            logit = np.bincount(doc, weights=w * (embed @ apart)[bucket], minlength=n) + bias[1] - bias[0]
            delta = own * (1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30))) - y) / own.sum()
            pull = np.bincount(bucket, weights=w * delta[doc], minlength=size)
            d_embed = pull[:, None] * apart + PENALTY * embed
            d_apart = pull @ embed
            d_soft, d_bias = np.stack([-d_apart, d_apart]) + PENALTY * soft, np.array([-delta.sum(), delta.sum()])
            seen_embed += d_embed**2
            seen_soft += d_soft**2
            seen_bias += d_bias**2
            embed -= RATE * d_embed / np.sqrt(seen_embed)
            soft -= RATE * d_soft / np.sqrt(seen_soft)
            bias -= 10 * RATE * d_bias / np.sqrt(seen_bias)
    return Model(weight, embed @ (soft[1] - soft[0]), float(bias[1] - bias[0]))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, most_bytes: int = MOST_BYTES) -> Model:
    """Train on at most ``most`` labelled documents, of ``most_bytes`` together, that aren't held out.

    The sample is the documents whose id has the least hash, so it doesn't depend on how
    the tables are partitioned.  Null ids, labels and texts don't count; a document labelled
    twice counts once, by its higher label; of rows of equal doc_id one is taken, by its
    text's hash.  Without labels every text scores 0.001.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    known = hashed_sample(known, "id", most)  # MOST_LABELLED rows, so it may be broadcast
    rows = docs.select(F.col("doc_id").alias("id"), "text").where(F.octet_length("text") <= LONGEST).join(F.broadcast(known), "id")
    one = stage(rows.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic")), "toxic-sample")
    sizes = sorted((r["h"], r["id"], r["b"]) for r in one.select(F.xxhash64("id").alias("h"), "id", F.octet_length("text").alias("b")).collect())
    fits = int(np.searchsorted(np.cumsum([b for *_, b in sizes]), most_bytes, side="right")) if sizes else 0
    kept = one if fits == len(sizes) else one.where(F.struct(F.xxhash64("id"), "id") < F.struct(F.lit(sizes[fits][0]), F.lit(sizes[fits][1])))
    found = sorted((r["id"], r["text"], r["toxic"]) for r in kept.collect())
    return train([t for _, t, _ in found], np.array([y for *_, y in found], dtype=np.int64))


def _scored(model: Model, most: int = 1 << 20):
    own = Model(model.weight.astype(np.float32), model.table.astype(np.float32), model.bias)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").fill_null("")
            sizes = np.cumsum(np.asarray(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64))
            i = 0
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + most, side="right")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(own.scores(texts.slice(i, j - i).to_pylist()))], names=["doc_id", "score"])
                i = j

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted; one row for each input row, in any order, equal rows alike.

    score: 0 to 1, the model's chance that the text is toxic, from its words alone.  A
    null, empty or wordless text gets the score of no words, the bias.  A null doc_id
    isn't held out.  A very long text is scored whole, in memory for itself.  Other columns
    are ignored, whatever their names.
    """
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(model), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
