"""A content-addressed cache of answers: a table bucketed by key, so that joins on the key move only the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["cache_key", "model", "completion", "prompt_tokens", "completion_tokens", "cost_usd", "latency_s", "created_at", "max_tokens"]
BUCKETS = 64


def put(rows: DataFrame, name: str, buckets: int = BUCKETS) -> None:
    """Appends answers to the cache; the last one of a key, by created_at, counts. Each put is one file a bucket and task at most."""
    rows.select(*COLUMNS).repartition(buckets, "cache_key").write.mode("append").bucketBy(buckets, "cache_key").sortBy("cache_key").format("parquet").saveAsTable(name)


def read(spark: SparkSession, name: str) -> DataFrame:
    """The last answer of each key; grouped within buckets, without a shuffle."""
    rest = [c for c in COLUMNS if c != "cache_key"]
    last = F.max_by(F.struct(*rest), F.struct("created_at", "max_tokens", "completion"))
    return spark.table(name).groupBy("cache_key").agg(last.alias("x")).select("cache_key", "x.*")


def compact(spark: SparkSession, name: str, into: str, buckets: int = BUCKETS) -> None:
    """Writes the cache's last answers as a new table: one file a bucket, bucket by bucket. The old one stays for its readers."""
    read(spark, name).select(*COLUMNS).write.mode("error").bucketBy(buckets, "cache_key").sortBy("cache_key").format("parquet").saveAsTable(into)
