"""Structured Streaming over call ledgers: running totals, exactly-once calls, upserts, online routing.

Every stream here takes what is there and ends (availableNow), with its checkpoint in a folder given by the caller,
so it can go on where it was when more has come.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tierwise.operators.metrics import predictions
from tierwise.operators.routing import escalates
from tierwise.sources.io import read_upserted, write_upsert


def file_stream(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", **options: str) -> DataFrame:
    """New files under a path (or glob) as a stream."""
    return spark.readStream.schema(schema).options(**options).format(kind).load(path)


def finish(query) -> None:
    """Waits for a stream that ends by itself, and stops it whatever happens."""
    try:
        query.awaitTermination()
    finally:
        query.stop()


def into_table(rows: DataFrame, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream of bounded results into a table in memory."""
    name = f"stream_{uuid.uuid4().hex}"
    finish(rows.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    return rows.sparkSession.table(name)


def into_files(rows: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream into Parquet files, each row once."""
    finish(rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def running_totals(ledger: DataFrame) -> DataFrame:
    """tier, usd, calls so far; works on a stream and on a table."""
    return ledger.groupBy("tier").agg(F.sum("usd").alias("usd"), F.count("*").alias("calls"))


def once(calls: DataFrame, keys: Sequence[str], time: str | None = None, late: str = "1 day") -> DataFrame:
    """Each call once. With a time column, state older than the watermark is let go."""
    if time is None:
        return calls.dropDuplicates(list(keys))
    return calls.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def upsert_stream(rows: DataFrame, path: str, keys: Sequence[str], checkpoint: str) -> DataFrame:
    """Merges each micro-batch into a table of versions; a batch that is run again gives the same table."""
    finish(rows.writeStream.foreachBatch(lambda batch, _: write_upsert(batch, path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    return read_upserted(rows.sparkSession, path, rows.schema)


def route(logits: DataFrame, tau: float, temperature: float = 1.0) -> DataFrame:
    """query_id, predicted, confidence, escalated, served: a stateless decision for each row of a stream or table."""
    p = predictions(logits, temperature)
    up = escalates(F.col("confidence"), F.lit(tau), F.col("predicted"))
    return p.select("query_id", "predicted", "confidence", up.alias("escalated"), (F.col("predicted") + up.cast("int")).alias("served"))


def hourly_spend(ledger: DataFrame, time: str = "ts", late: str = "2 hours") -> DataFrame:
    """An extension: hour, tier, usd over tumbling windows with a watermark."""
    return ledger.withWatermark(time, late).groupBy(F.window(time, "1 hour"), "tier").agg(F.sum("usd").alias("usd")).select(F.col("window.start").alias("hour"), "tier", "usd")


def hourly_files(ledger: DataFrame, path: str, checkpoint: str, time: str = "ts", late: str = "2 hours") -> DataFrame:
    """hourly_spend() as files: each micro-batch writes the hours that it has changed, and the last of each hour and tier counts.

    Nothing is kept in the driver; hours behind the watermark leave the state.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    rows = hourly_spend(ledger, time, late)
    finish(rows.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    found = rows.sparkSession.read.parquet(path)
    return found.groupBy("hour", "tier").agg(F.max_by("usd", "batch").alias("usd"))
