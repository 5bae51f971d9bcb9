"""The size of Arrow batches that go to Python workers."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Most rows and bytes of a batch: a worker holds one batch of long texts at a time, whatever the size of the input.
LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def small_batches(spark: SparkSession) -> None:
    """The session's batches have so many rows and bytes at most from now on; lower limits stay, no limit is a number below 1."""
    parsed = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name, most in LIMITS.items():
        now = spark.conf.get(name)
        if now.startswith("-") or not 0 < parsed(now) <= most:
            spark.conf.set(name, str(most))
