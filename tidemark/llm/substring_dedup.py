"""Substring dedup by repeated-phrase automata.

Recurring passages are gathered at their home (see ``recurrence``), the windows
confirmed to recur are compiled into an Aho-Corasick automaton over word
numbers, one automaton a home, and all segments sent there are streamed through
it to locate every occurrence.  The automata are shards: each holds the passages
of about one block of documents, and a document's text only visits the homes of
its own passages.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.recurrence import Body, Kind, earlier_windows_removed, runs_of

WINDOW_WORDS = 13
GRAM_WORDS = 6


def resolve_by_automaton(bodies: list[Body], width: int = WINDOW_WORDS) -> list[np.ndarray]:
    import ahocorasick

    number: dict[bytes, int] = {}
    texts = [[number.setdefault(w, len(number)) for w in b.data.split(b" ")] for b in bodies]
    windows = [len(t) - width + 1 for t in texts]
    first = np.concatenate([[0], np.cumsum(windows)])
    hashes = np.concatenate([K.window_hash(K.mix(np.array(t, dtype=np.uint64) + np.uint64(1)), width) for t in texts])
    owner = np.repeat(np.arange(len(bodies)), windows)
    doc = np.array([b.doc for b in bodies], dtype=np.int64)
    many = np.array([b.count > 1 for b in bodies])

    # confirm: windows in two places or more
    order = np.argsort(hashes, kind="stable")
    new = np.append(True, hashes[order][1:] != hashes[order][:-1])
    at = np.flatnonzero(new)
    confirmed = (np.diff(np.append(at, len(order))) > 1) | np.maximum.reduceat(many[owner[order]], at)
    trie = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for n, w in enumerate(order[at[confirmed]].tolist()):
        j = w - int(first[owner[w]])
        trie.add_word(tuple(texts[owner[w]][j : j + width]), n)
    earliest_of = np.full(int(confirmed.sum()), np.iinfo(np.int64).max)
    where = np.full(len(hashes), -1, dtype=np.int64)
    if len(trie):
        trie.make_automaton()
        for k, t in enumerate(texts):
            base = int(first[k]) - width + 1
            for end, n in trie.iter(tuple(t)):
                where[base + end] = n
        hit = where >= 0
        np.minimum.at(earliest_of, where[hit], doc[owner[hit]])
    earliest = doc[owner]
    hit = where >= 0
    earliest[hit] = earliest_of[where[hit]]
    still = np.arange(len(hashes)) - np.repeat(first[:-1], windows)
    return [runs_of(earliest[a:b], still[a:b]) for a, b in zip(first[:-1], first[1:])]


PHRASES = Kind(width=WINDOW_WORDS, gram=GRAM_WORDS, words=True, strict_document=True, resolve=resolve_by_automaton)


def remove_repeated_phrases(docs: DataFrame) -> DataFrame:
    """Drop every word covered by a 13-word window that also starts in a document of smaller doc_id.

    Input: doc_id, text; other columns are ignored, whatever their names.  Output,
    one row for each input row: doc_id, n_words, n_removed, n_spans (maximal removed
    runs), spans (int64 pairs, word numbers from and to), kept_text (null where the
    text is null; words joined by one space).  A null or empty text has no words.
    A null doc_id comes after all others.  Rows of equal doc_id never remove each
    other's words.  Windows are judged on the input.
    """
    out = earlier_windows_removed(docs, PHRASES)
    kept = F.when(~F.col("null_text"), F.col("kept").cast("string"))
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "n_spans", "spans", kept.alias("kept_text"))


#: Every window by its words; a word goes if a covered window starts at it or up to twelve words before.
ORACLE = r"""
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
places as (select doc_id, unnest(range(1, len(ws) + 1)) i, unnest(ws) word, ws from words),
windows as (select doc_id, i, min(doc_id) over (partition by array_to_string(ws[i:i + 12], ' ')) < doc_id again from places where i + 12 <= len(ws)),
judged as (select p.doc_id, p.i, p.word, coalesce(bool_or(again) over (partition by p.doc_id order by p.i rows between 12 preceding and current row), false) gone from places p left join windows w on w.doc_id = p.doc_id and w.i = p.i),
kept as (select doc_id, count(*) filter (gone) n_removed, string_agg(word, ' ' order by i) filter (not gone) body from judged group by doc_id)
select w.doc_id, cast(len(ws) as bigint) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(body, '')) kept_sha256 from words w left join kept using (doc_id)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_repeated_phrases(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))
