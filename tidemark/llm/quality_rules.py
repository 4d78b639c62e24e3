"""Quality rules: a learned decision list over native text statistics.

Sequential covering on labelled documents: a rule is grown as a conjunction of
``statistic >= threshold`` or ``<= threshold`` by information gain on two thirds
of the labelled rows, then pruned from its end on the remaining third, and kept
while it stays precise there.  The rows it covers are taken out and the next rule
is grown.  The list becomes one ordered Spark conditional expression; statistics
and verdicts are DataFrame expressions throughout.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.columns import WORD, count_of, fold_add, fresh, words
from tidemark.llm.sizing import hashed_sample

WINDOW = 5
#: Labelled documents used for learning at most (those of the smallest hash of the id).
MOST_LABELLED = 20_000
#: Thresholds tried for each statistic, at quantiles of the labelled rows.
THRESHOLDS = 48
MOST_RULES = 12
MOST_CONDITIONS = 4
#: Share of a rule's rows that must be labelled low quality, on the pruning rows.
PRECISION = 0.97
LEAST_COVER = 8

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    """The frame with one added struct column, and its fields as columns.

    A null text counts as empty; every statistic of it is 0.
    """
    w, h, q, p, s = (fresh(docs, x) for x in ("words", "hashes", "pairs", "places", "stats"))
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn(w, words(F.col(text)))
    n = F.size(w)
    spot = lambda i: F.xxhash64(*[F.col(w)[i + k] for k in range(WINDOW)])
    df = df.withColumn(h, F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), spot)).otherwise(F.array().cast("array<bigint>")))
    # only a text that has a window twice is looked at more closely
    pair = F.sort_array(F.transform(F.col(h), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn(q, F.when(F.size(F.array_distinct(h)) < F.size(h), pair))
    last = F.size(q) - 1
    again = F.filter(
        F.col(q),
        lambda x, i: ((i > 0) & (F.col(q)[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | ((i < last) & (F.col(q)[F.least(i + 1, last)]["h"] == x["h"])),
    )
    df = df.withColumn(p, F.sort_array(F.transform(again, lambda x: x["i"])))
    gap = F.zip_with(F.slice(p, 2, F.size(p) - 1), F.slice(p, 1, F.size(p) - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)).cast("long"))
    repeat = F.when(F.size(p) > 0, F.aggregate(gap, F.lit(WINDOW).cast("long"), fold_add)).otherwise(F.lit(0).cast("long"))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    fields = {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": count_of(t, r"[^#*$%&|<>]+"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeat,
        "n_lines": F.size(lines).cast("long"),
        "n_upper": count_of(t, r"[^\p{Lu}]+"),
        "n_marks": count_of(t, r"[^!?]+"),
        "n_digits": count_of(t, r"[^0-9]+"),
        "n_distinct": F.size(F.array_distinct(w)).cast("long"),
    }
    # the row number keeps a later filter above this step: pushed below it, the filter would
    # carry all of the expressions above, and evaluate an array anew for each of its elements
    barrier = F.monotonically_increasing_id().alias("row")
    df = df.withColumn(s, F.struct(*[v.alias(k) for k, v in fields.items()], barrier)).drop(w, h, q, p)
    return df, {k: F.col(f"`{s}`.{k}") for k in fields}


def features(stat: dict[str, Column]) -> dict[str, Column]:
    n = F.greatest(stat["n_words"], F.lit(1)).cast("double")
    chars = F.greatest(stat["word_chars"], F.lit(1)).cast("double")
    return {
        "words": stat["n_words"].cast("double"),
        "mean_word": stat["word_chars"] / n,
        "symbols_per_word": stat["n_symbols"] / n,
        "dup_line_share": stat["n_dup_lines"] / F.greatest(stat["n_lines"], F.lit(1)).cast("double"),
        "repeat_share": stat["n_repeat_words"] / n,
        "upper_share": stat["n_upper"] / chars,
        "marks_per_word": stat["n_marks"] / n,
        "digit_share": stat["n_digits"] / chars,
        "distinct_share": stat["n_distinct"] / n,
    }


def base_failed(stat: dict[str, Column]) -> Column:
    return (stat["n_words"] < 10) | (100 * stat["n_repeat_words"] > 20 * stat["n_words"])


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.name] >= self.threshold if self.above else of[self.name] <= self.threshold


@dataclass
class DecisionList:
    """Ordered rules; a document that meets one is rejected."""

    rules: list[list[Condition]] = field(default_factory=list)

    def rejects(self, of: dict[str, Column]) -> Column:
        verdict = F.lit(False)
        for rule in reversed(self.rules):
            verdict = F.when(reduce(lambda a, b: a & b, (c.column(of) for c in rule)), F.lit(True)).otherwise(verdict)
        return verdict

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(f"{c.name} {'>=' if c.above else '<='} {c.threshold:.6g}" for c in r) for r in self.rules) or "keep all"


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], cuts: list[np.ndarray]) -> list[Condition]:
    rule, inside = [], np.ones(len(bad), dtype=bool)
    while len(rule) < MOST_CONDITIONS and (~bad[inside]).any():
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        before, best = np.log2(p / (p + n)), (1e-9, None, None)
        for f, name in enumerate(names):
            v = x[inside, f]
            for above in (True, False):
                hit = (v[:, None] >= cuts[f]) if above else (v[:, None] <= cuts[f])
                pos = hit[bad[inside]].sum(axis=0)
                neg = hit[~bad[inside]].sum(axis=0)
                gain = np.where(pos >= LEAST_COVER, pos * (np.log2(np.maximum(pos, 1) / np.maximum(pos + neg, 1)) - before), -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), Condition(name, above, float(cuts[f][k])), f)
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= _covers([best[1]], x, names)
    return rule


def _covers(rule: list[Condition], x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c in rule:
        v = x[:, names.index(c.name)]
        out &= v >= c.threshold if c.above else v <= c.threshold
    return out


def learn(x: np.ndarray, bad: np.ndarray, prune: np.ndarray, names: list[str]) -> DecisionList:
    """Sequential covering. x: rows by features; bad: labelled low quality; prune: rows held for pruning."""
    found = DecisionList()
    left = np.ones(len(bad), dtype=bool)
    cuts = [np.unique(np.concatenate([np.quantile(v[m], np.linspace(0, 1, THRESHOLDS)) for m in (bad, ~bad) if m.any()])) if len(v) else np.zeros(1) for v in x.T]
    while len(found.rules) < MOST_RULES and (bad & left & ~prune).sum() >= LEAST_COVER:
        g, h = left & ~prune, left & prune
        rule = _grow(x[g], bad[g], names, cuts)
        if not rule:
            break

        def worth(r: list[Condition]) -> float:
            hit = _covers(r, x[h], names)
            p, n = (hit & bad[h]).sum(), (hit & ~bad[h]).sum()
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        hit, held = _covers(rule, x[g], names), _covers(rule, x[h], names)
        p, n = (hit & bad[g]).sum() + (held & bad[h]).sum(), (hit & ~bad[g]).sum() + (held & ~bad[h]).sum()
        if p < LEAST_COVER or p / (p + n) < PRECISION:
            break
        found.rules.append(rule)
        left &= ~_covers(rule, x, names)
    return found


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DecisionList:
    """Learn from at most ``most`` labelled documents; without labels nothing is rejected.

    The sample doesn't depend on how the tables are partitioned.  A document labelled
    twice counts once, by its lower label; of rows of equal doc_id the one with the least
    statistics counts; null ids and labels don't.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("quality"))
    known = hashed_sample(known, "id", most)  # MOST_LABELLED rows, so it may be broadcast
    sample = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(known), "id")
    df, stat = with_statistics(sample)
    of = features(stat)
    one = df.where(~base_failed(stat)).select("id", "quality", F.struct(*[v.alias(k) for k, v in of.items()]).alias("x"))
    rows = one.groupBy("id").agg(F.first("quality").alias("quality"), F.min("x").alias("x")).collect()
    if not rows:
        return DecisionList()
    rows.sort(key=lambda r: r["id"])
    x = np.array([tuple(r["x"]) for r in rows], dtype=float)
    bad = np.array([r["quality"] == 0 for r in rows])
    return learn(x, bad, np.arange(len(rows)) % 3 == 2, list(of))


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept; a row for each input row.

    A null or empty text has no words and fails the base checks.  A null doc_id stays
    null; repeated rows are judged alike, each on its own.  Long texts are judged whole.
    Other columns are ignored, whatever their names.
    """
    df, stat = with_statistics(docs.select("doc_id", "text"))
    failed = base_failed(stat)
    return df.select("doc_id", *[stat[k].alias(k) for k in BASE], failed.alias("base_failed"), (~failed & ~rules.rejects(features(stat))).alias("kept"))


def keep_good(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows that pass, all their columns unchanged, whatever their names; null and empty texts go."""
    df, stat = with_statistics(docs)
    return df.where(~base_failed(stat) & ~rules.rejects(features(stat))).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
