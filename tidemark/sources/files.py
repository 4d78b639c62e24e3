"""Files in and out: check results, log lines, recorded responses, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as X
from tidemark.operators.uilog import parsed_log

POST = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("url", T.StringType(), False), *[T.StructField(m, T.LongType()) for m in ("views", "likes", "comments")], T.StructField("caption", T.StringType()), T.StructField("posted_at", T.StringType()), T.StructField("account", T.StringType())]
)
FORMATS = ("parquet", "orc", "json", "csv")


def posts(spark: SparkSession, rows: list[dict], vendor: str) -> DataFrame:
    """A vendor's posts from dicts, in their order; only ``id`` may be lacking."""
    for r in rows:
        lacking = {f.name for f in POST if f.name != "id"} - set(r)
        if lacking:
            raise KeyError(sorted(lacking)[0])
    data = [(vendor, i, *[r.get(f.name) for f in POST]) for i, r in enumerate(rows)]
    schema = T.StructType([T.StructField("vendor", T.StringType()), T.StructField("ord", T.LongType()), *POST.fields])
    return spark.createDataFrame(data, schema).withColumn("posted_at", X.parsed_time(F.col("posted_at")))


def snapshots(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """The last snapshot, in input order."""
    data = [(i, r["platform_id"], r["views"], r["likes"], r["scraped_at"], r.get("source")) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "ord long, id string, views long, likes long, scraped_at string, source string").withColumn("scraped_at", X.parsed_time(F.col("scraped_at")))


def assignments(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Owners of accounts, in input order; an empty end is open."""
    data = [(r["account"], i, r["client"], r["from"], r.get("to") or None) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "account string, ord long, client string, valid_from string, valid_to string")
    return df.withColumn("valid_from", X.parsed_time(F.col("valid_from"))).withColumn("valid_to", X.parsed_time(F.col("valid_to")))


def check_results(spark: SparkSession, path: str) -> DataFrame:
    """Check results of JSON documents: device_id, check, raw, lists (the two list values)."""
    raw = spark.read.schema("device_id string, check string, raw_output string, commands_run array<string>").json(path, multiLine=True)
    lists = F.from_json("raw_output", "struct<location_grants:array<string>,saved_networks:array<string>>")
    both = F.create_map(F.lit("location_grants"), lists["location_grants"], F.lit("saved_networks"), lists["saved_networks"])
    return raw.select("device_id", "check", F.from_json("raw_output", "map<string,string>").alias("raw"), both.alias("lists"))


RESPONSE = (
    "job_id long, attempt int, vendor string, account string, fetched_at double, outcome string, is_complete boolean, retry_after double, "
    "posts array<struct<platform_post_id:string,views:long,likes:long,comments:long,shares:long,published_at:string>>"
)


def responses(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Recorded vendor responses, one JSON object a line: (attempts, posts).

    attempts: job_id, attempt, vendor, account, fetched_at (seconds), outcome, retry_after;
    the outcome is what was recorded, else complete or partial by is_complete.  posts: the
    posts of complete responses only, with their job, vendor, account and place; a partial
    response would make the posts that it lacks look as if they had disappeared.
    """
    raw = spark.read.schema(RESPONSE).json(path)
    outcome = F.coalesce("outcome", F.when(F.col("is_complete"), "complete").otherwise("partial"))
    raw = raw.withColumn("outcome", outcome)
    whole = raw.where("outcome = 'complete'").select("job_id", "attempt", "vendor", "account", "fetched_at", F.posexplode("posts").alias("ord", "p"))
    attempts = raw.select("job_id", "attempt", "vendor", "account", "fetched_at", "outcome", "retry_after")
    return attempts, whole.select("*", "p.*").drop("p").withColumn("published_at", X.parsed_time(F.col("published_at")))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    return parsed_log(spark.read.text(path))


def read(spark: SparkSession, path: str, form: str, schema: str | None = None) -> DataFrame:
    """A table of one of FORMATS; text forms need a schema, so nothing is inferred by a scan."""
    if form not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    if form in ("json", "csv") and schema is None:
        raise ValueError(f"{form} needs a schema")
    reader = spark.read.format(form)
    return (reader.schema(schema) if schema else reader).options(**({"header": "true"} if form == "csv" else {})).load(path)


def report(df: DataFrame, path: str, form: str = "json") -> None:
    df.write.mode("errorifexists").format(form).save(path)
