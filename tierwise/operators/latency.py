"""How long a router takes for one query at a time, measured where it would serve: in the partitions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tierwise.operators.metrics import percentiles
from tierwise.sources.batches import small_batches
from tierwise.sources.io import written

#: A router: made once in each partition, then called with a prompt. It returns the name of a tier.
Router = Callable[[], Callable[[str], str]]

WARM_UP = 2


def timed_routes(rows: DataFrame, router: Router, warm_up: int = WARM_UP, key: str = "query_id", prompt: str = "prompt") -> DataFrame:
    """key, tier, latency_ms of each row with a text; the router's first calls in a partition are not timed.

    Another evaluation of the plan measures anew: write the result before several passes read it.
    """
    schema = StructType([rows.schema[key], *StructType.fromDDL("tier string, latency_ms double").fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        route = None
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(1)
            if route is None:
                route = router()
                for i in range(warm_up):
                    route(texts[i % len(texts)].as_py())
            tiers, took = [], []
            for text in (x.as_py() for x in texts):
                began = time.perf_counter()
                tiers.append(route(text))
                took.append((time.perf_counter() - began) * 1e3)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tiers, pa.string()), pa.array(took, pa.float64())], names=names)

    small_batches(rows.sparkSession)
    return rows.select(key, F.col(prompt).cast("string")).where(F.length(prompt) > 0).mapInArrow(run, schema)


def latency(timed: DataFrame) -> DataFrame:
    """One row: n, mean, p50, p95, p99 of latency_ms; an error if nothing was timed."""
    once = written(timed.select("latency_ms"))
    if once.isEmpty():
        raise ValueError("no rows with a text to time the router on")
    return once.agg(F.count("*").alias("n"), F.avg("latency_ms").alias("mean")).crossJoin(percentiles(once, "latency_ms"))
