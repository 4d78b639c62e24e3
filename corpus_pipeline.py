"""Training-corpus pipeline: rules, line dedup, near-duplicate join, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
All but the last return the columns of documents; the last returns a row for each
document and pass that the mix takes, with its output shard and place.

For all stages: an empty table gives an empty one; further columns stay with their rows,
whatever their names; texts are read whole, however long; reruns agree, also on rows that
are equal in id, text and source and differ elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, mixing, ngram_join, quality_rules
from tidemark.llm.columns import WORD
from tidemark.llm.sizing import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base checks or meet a learned rule go.

    Null and empty texts, and those of fewer than ten words, fail; a null id is judged by its
    text, equal rows are judged alike.  Without labels there are only the base checks.
    """
    rules = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.keep_good(docs, rules)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut from the texts; n_chars follows.

    A text of which nothing but white space is left goes: all of it stands elsewhere.
    Rows of equal id and text count as one and stay or are cut alike; a null id comes after
    all others; null and empty texts, and those without words, stay as they are.
    """
    cut, count, reach = line_dedup.without_repeats(docs)
    length = F.when(F.col(count) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    left = (F.col(count) == 0) | F.col("text").rlike(WORD)
    return cut.withColumn("n_chars", length).where(left).drop(count, reach)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one of smallest id.

    One of several equal rows stays; rows of null id and texts without words all stay.
    """
    return ngram_join.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    Null and empty texts hold none and stay; equal rows go or stay together; a null id is
    no exception.  Without a benchmark all stay.
    """
    return decontaminate.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights.

    Null and empty texts have no words and are never taken; a null source is one of its
    own, the last; a null id is taken like others, equal rows each by themselves.
    """
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing to target weights", mixed),
]

#: Learned rules and edit-distance search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
