"""Domain tables, derived from the driver's tables by fixed integer rules (see SURVEY 7.3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2026-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_name(n) -> F.Column:
    return F.concat(F.lit("doc-"), F.lpad(n.cast("string"), 8, "0"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge entries, one per document."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        n.alias("n"),
        doc_name(n).alias("kid"),
        F.col("source").alias("domain"),
        F.col("lang").alias("subject"),
        F.col("text").alias("content"),
        F.array("lang", "source", F.concat(F.lit("k"), F.expr("n_chars div 1000").cast("string"))).alias("tags"),
        F.when(n % 11 != 0, F.concat(F.lit("p"), (n % 4).cast("string"))).alias("project"),
        F.when(n % 5 == 0, "public").otherwise("private").alias("zone"),
        F.when(n % 10 != 0, doc_name(n - n % 10)).alias("parent"),
        F.when(n % 10 != 0, n % 10).alias("seq"),
        F.when(n % 10 == 0, "collection").when(n % 10 != 9, "book").alias("content_type"),
        F.when(n % 13 == 0, "deprecated").when(n % 17 != 0, "published").alias("status"),
        (n % 7 == 0).alias("evergreen"),
        F.when(n % 3 != 0, F.concat(F.lit("https://example.org/"), n.cast("string"))).alias("source_url"),
        (n % 730).alias("updated_day"),
        (n % 9 != 0).alias("explicit"),
        (n % 5 + 1).alias("version"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with vectors: two vectors an entry."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("vec_id - vec_id % 2").alias("n"), F.col("embedding").alias("vector"), "label")
    return v.join(entries(spark, sf_dir), "n")


def error_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log events: seq, ts, day, source, marker, status, message, actor, exit_code, expected, hint."""
    n, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    base = table(spark, sf_dir, "events").withColumn("k", k)
    status = F.when(F.col("event_type") == "error", F.when(n % 3 == 0, 500).otherwise(404)).when(n % 10 == 0, 429)
    return base.select(
        n.alias("seq"), "ts", F.to_date("ts").alias("day"), F.concat(F.lit("svc"), (F.col("user_id") % 5).cast("string")).alias("source"),
        F.when(n % 4 == 0, "HEALTH").when(n % 4 == 1, "REQ").alias("marker"), status.alias("status"),
        F.concat(F.lit("GET /items/"), n.cast("string"), F.lit(" took "), F.col("k").cast("string"), F.lit(".5ms code "), (F.col("k") % 7).cast("string"), F.lit(" "), F.col("event_type")).alias("message"),
        F.when(n % 6 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("actor"), (n % 12).cast("int").alias("exit_code"), (n % 8 == 0).alias("expected"),
        F.when(status == 500, "5xx").when(n % 97 == 0, "oom").alias("hint"), "event_type", "user_id", "value", "k",
        F.concat(F.col("event_type"), F.lit("|"), (F.col("k") % 10).cast("string")).alias("sig"),
    )
