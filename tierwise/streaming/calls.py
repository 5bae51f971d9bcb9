"""Calls in batches and streams: each key is called once, spending is logged before answers, a canary goes first."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructField, StructType, BooleanType

from tierwise.operators import calls as C
from tierwise.sources import cache
from tierwise.streaming.ledger import finish


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def answered(calls: DataFrame, name: str, client: C.Client, prices: DataFrame, path: str, batch: str, cap: int, buckets: int = cache.BUCKETS, **policy) -> DataFrame:
    """The runs of a batch of calls; new answers go to the cache table of this name.

    1. The first calls of keys without a usable answer are made and written under path/answers/batch. Spark commits each task's
       output once, so a task that runs again, on another executor, leaves its answers and their cost once.
    2. Their spending is written under path/ledger/batch: before the answers are used, so that no spending is lost.
    3. Then the answers join the cache, and all calls of the batch take theirs.

    A batch that is run again under its name goes on from what it has written: no call of a finished step is made again.
    Keys stand for prompts: they are worked out once and written under path/calls/batch; only calls to be made meet their prompts again.
    """
    spark = calls.sparkSession
    keyed, listed = C.keyed(calls), f"{path}/calls/batch={batch}"
    keyed.select("query_id", "tier_rank", "model", "cache_key").write.mode("overwrite").option("compression", "zstd").parquet(listed)
    marked = C.duplicates(spark.read.schema(keyed.select("query_id", "tier_rank", "model", "cache_key").schema).parquet(listed))
    staged = f"{path}/answers/batch={batch}"
    have = spark.catalog.tableExists(name)
    known = cache.read(spark, name) if have else spark.createDataFrame([], "cache_key string, model string, completion string, prompt_tokens bigint, completion_tokens bigint, cost_usd double, latency_s double, created_at timestamp, max_tokens int")
    if not exists(spark, f"{staged}/_SUCCESS"):
        todo = C.uncached_calls(marked.where("not cached"), known, cap)
        todo = C.with_prompts(todo, keyed)
        C.priced(C.complete(todo, client, **policy), prices).withColumn("created_at", F.current_timestamp()).write.mode("overwrite").parquet(staged)
    answers = spark.read.parquet(staged)
    paid = answers.where("error is null").select(F.col("created_at").alias("ts"), "model", "prompt_tokens", "completion_tokens", F.col("cost_usd").alias("usd"), (F.col("latency_s") * 1000).alias("latency_ms"))
    paid.write.mode("overwrite").json(f"{path}/ledger/batch={batch}")
    runs = f"{path}/runs/batch={batch}"
    C.fanned_out(marked, known.join(answers.select("cache_key"), "cache_key", "left_anti"), answers, cap).write.mode("overwrite").parquet(runs)
    cache.put(answers.where("error is null").withColumn("max_tokens", F.lit(cap)), name, buckets)
    return spark.read.parquet(runs)


def canary(calls: DataFrame, client: C.Client, **policy) -> None:
    """The first call of each model must be answered; an error names those that were not, and nothing else has been called."""
    if failed := C.canary_failures(C.complete(C.keyed(C.first_of_each(calls)), client, **policy)):
        raise RuntimeError(f"canary failed: {'; '.join(failed)}")


def gated(rows: DataFrame, checkpoint: str, marker: str, first: Callable[[DataFrame], None], admit: Callable[[DataFrame, int], None]) -> None:
    """A stream whose first row must pass before any other is admitted.

    first gets one row and raises if it fails, which ends the stream before its batch is admitted; run again, it goes on from its
    checkpoint with the same batch. Once passed, a marker is written beside the checkpoint, and first is not called again.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not exists(spark, marker):
            one = batch.limit(1)
            if one.isEmpty():
                return
            first(one)
            spark.createDataFrame([(number,)], "batch bigint").coalesce(1).write.mode("overwrite").json(marker)
        admit(batch, number)

    finish(rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def seen_before(calls: DataFrame, order: str = "call_id") -> DataFrame:
    """A stream of calls (cache_key) with cached: false for the first call of each key, in flight or answered, true for all later ones.

    The state is one row a key. Within a micro-batch the first is the smallest by order.
    """
    out = StructType([*calls.schema.fields, StructField("cached", BooleanType())])

    def mark(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, best, held = state.exists, None, []
        for frame in frames:
            if not seen and len(frame):
                low = frame[order].min()
                best = low if best is None else min(best, low)
                held.append(frame)
            elif len(frame):
                yield frame.assign(cached=True)
        for frame in held:
            yield frame.assign(cached=frame[order] != best)
        state.update((True,))

    return calls.groupBy("cache_key").applyInPandasWithState(mark, out, "seen boolean", "append", GroupStateTimeout.NoTimeout)
