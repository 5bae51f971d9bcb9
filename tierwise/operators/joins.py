"""Joins in which a few keys may stand for much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more than a HEAVY-th of all rows behind them are at most HEAVY.
HEAVY = 4096


def frequent(rows: DataFrame, keys: Sequence[str], share: int = HEAVY) -> DataFrame:
    """Keys that more than a share-th of all rows have: share rows at most, whatever the data. rows is read twice."""
    total = rows.agg((F.count("*") / share).alias("__least"))
    return rows.groupBy(*keys).agg(F.count("*").alias("__n")).crossJoin(F.broadcast(total)).where("__n > __least").select(*keys)


def lookup(rows: DataFrame, values: DataFrame, keys: Sequence[str], heavy: DataFrame | None = None) -> DataFrame:
    """rows left-joined with values (one row a key): frequent keys meet a broadcast, the rest a shuffle, so no key is one task.

    heavy is a DataFrame of at most HEAVY keys, by default frequent(rows, keys).
    """
    keys = list(keys)
    heavy = frequent(rows, keys) if heavy is None else heavy
    some = values.join(F.broadcast(heavy), keys, "left_semi")
    marked = rows.join(F.broadcast(heavy.withColumn("__heavy", F.lit(True))), keys, "left")
    near = marked.where("__heavy").drop("__heavy").join(F.broadcast(some), keys, "left")
    far = marked.where("__heavy is null").drop("__heavy").join(values, keys, "left")
    return near.unionByName(far)
