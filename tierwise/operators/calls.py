"""Model calls as data: content-addressed answers, duplicates within a batch, calls by a client made in each partition.

A call is a row with query_id, tier_rank, prompt and model. Its answer belongs to the pair of prompt and model, by hash: two queries
with one prompt share an answer, another model does not. Of several calls of one key only the first, by query and tier, is
made; the others take its answer as a cached one, errors included.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwise.functions.exprs import cache_key
from tierwise.operators.costs import RETRYABLE, cut_off
from tierwise.operators.joins import lookup
from tierwise.sources.batches import small_batches

#: A client: made once in each partition, then called with a prompt and a model. It returns completion, prompt_tokens, completion_tokens and usd (None if it knows no price), or raises.
Client = Callable[[], Callable[[str, str], dict[str, Any]]]

ANSWER = "cache_key string, model string, completion string, prompt_tokens bigint, completion_tokens bigint, usd double, latency_s double, error string, attempts int"


def keyed(calls: DataFrame) -> DataFrame:
    """calls with cache_key; a null prompt is an empty one."""
    return calls.withColumn("cache_key", cache_key(F.coalesce("prompt", F.lit("")), F.col("model")))


def usable(cache: DataFrame, cap: int) -> DataFrame:
    """Cached answers that were not cut off below the cap."""
    return cut_off(cache, cap).where("not coalesce(cut_off, false)").drop("cut_off")


def cached_calls(calls: DataFrame, cache: DataFrame, cap: int) -> DataFrame:
    """keyed calls with hit, and the cached answer's completion and cost."""
    answers = usable(cache, cap).select("cache_key", F.lit(True).alias("hit"), F.col("completion").alias("known"), F.col("cost_usd").alias("known_usd"))
    return lookup(calls, answers, ["cache_key"]).withColumn("hit", F.coalesce("hit", F.lit(False)))


def uncached_calls(calls: DataFrame, cache: DataFrame, cap: int) -> DataFrame:
    """keyed calls without a usable answer; a bucketed cache is not shuffled."""
    return calls.join(usable(cache, cap).select("cache_key"), "cache_key", "left_anti")


def duplicates(calls: DataFrame, order: Sequence[str] = ("query_id", "tier_rank")) -> DataFrame:
    """keyed calls with cached: false for the first call of each key, which is the one to make, true for all others.

    The first is a minimum, summed map-side, and comes back by a lookup, so a prompt that much of a batch repeats is not one task.
    """
    first = calls.groupBy("cache_key").agg(F.min(F.struct(*order)).alias("__first"))
    return lookup(calls, first, ["cache_key"]).withColumn("cached", F.struct(*order) != F.col("__first")).drop("__first")


def with_prompts(todo: DataFrame, calls: DataFrame, order: Sequence[str] = ("query_id", "tier_rank")) -> DataFrame:
    """Those of keyed calls that are in todo (cache_key and order), with their prompts: these meet one shuffle, unsorted, and no key is one task."""
    wanted = todo.select(F.col("cache_key").alias("__key"), *(F.col(c).alias(f"__{c}") for c in order)).distinct()
    same = F.col("cache_key") == F.col("__key")
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return calls.join(wanted.hint("shuffle_hash"), same, "left_semi")


def delay(key: str, attempt: int, base: float, most: float) -> float:
    """Seconds before the next attempt: doubled each time up to a limit, times 0.5 to 1 by a hash of key and attempt."""
    unit = int.from_bytes(hashlib.sha256(f"{key}:{attempt}".encode()).digest()[:8]) / 2**64
    return min(most, base * 2**attempt) * (0.5 + unit / 2)


def retryable(error: BaseException) -> bool:
    """By the names of an error's class and its bases."""
    return any(c.__name__ in RETRYABLE for c in type(error).__mro__)


def attempted(ask: Callable[[str, str], dict[str, Any]], key: str, prompt: str, model: str, retries: int, base: float, most: float, sleep: Callable[[float], None]) -> tuple:
    """One row of ANSWER: the answer, or the error of the last attempt as a value."""
    attempt = 0
    while True:
        began = time.perf_counter()
        try:
            r = ask(prompt, model)
            return (key, model, r.get("completion") or "", int(r.get("prompt_tokens") or 0), int(r.get("completion_tokens") or 0), r.get("usd"), time.perf_counter() - began, None, attempt + 1)
        except Exception as e:  # noqa: BLE001  a failed call is a row
            if attempt >= retries or not retryable(e):
                return (key, model, "", 0, 0, 0.0, 0.0, f"{type(e).__name__}: {e}", attempt + 1)
        sleep(delay(key, attempt, base, most))
        attempt += 1


def complete(calls: DataFrame, client: Client, retries: int = 3, base: float = 1.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """An answer of each row of calls (cache_key, prompt, model); nothing is kept back, an answer leaves with its batch.

    Plans may be evaluated again: write the result before anything depends on it (see streaming.calls.answered).
    """
    names = [x.split()[0] for x in ANSWER.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ask = ask or client()
            rows = zip(*batch.columns, strict=True)
            out = [attempted(ask, key.as_py(), prompt.as_py() or "", model.as_py(), retries, base, most, sleep) for key, prompt, model in rows]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    small_batches(calls.sparkSession)
    return calls.select("cache_key", "prompt", "model").mapInArrow(run, ANSWER)


def priced(answers: DataFrame, prices: DataFrame) -> DataFrame:
    """answers with cost_usd: the configured price of a model (model, p_in, p_out, one row each), else the client's own, else 0."""
    configured = F.col("prompt_tokens") * F.col("p_in") + F.col("completion_tokens") * F.col("p_out")
    cost = F.when(F.col("error").isNull(), F.coalesce(configured, "usd", F.lit(0.0))).otherwise(0.0)
    return answers.join(prices.select("model", "p_in", "p_out"), "model", "left").withColumn("cost_usd", cost).drop("p_in", "p_out")


def fanned_out(calls: DataFrame, cache: DataFrame, answers: DataFrame, cap: int) -> DataFrame:
    """query_id, tier_rank, model, completion, prompt_tokens, completion_tokens, cost_usd, latency_s, cached, error of each of duplicates().

    calls take a usable cached answer, else the new one of their key. Cached answers cost nothing and take no time.
    """
    parts = ["completion", "prompt_tokens", "completion_tokens"]
    old = usable(cache, cap).select("cache_key", F.lit(True).alias("known"), *parts, F.lit(0.0).alias("cost_usd"), F.lit(0.0).alias("latency_s"), F.lit(None).cast("string").alias("error"))
    new = answers.join(old.select("cache_key"), "cache_key", "left_anti").select("cache_key", F.lit(False).alias("known"), *parts, "cost_usd", "latency_s", "error")
    found = lookup(calls, old.unionByName(new), ["cache_key"])
    late = F.col("known") | F.col("cached")
    free = lambda x: F.when(late, 0.0).otherwise(F.col(x))
    return found.select("query_id", "tier_rank", "model", *parts, free("cost_usd").alias("cost_usd"), free("latency_s").alias("latency_s"), (late & F.col("error").isNull()).alias("cached"), "error")


def canary_failures(answers: DataFrame) -> list[str]:
    """The errors of a canary's few answers, as model and error."""
    return sorted(f"{r.model}: {r.error}" for r in answers.where("error is not null").select("model", "error").collect())


def first_of_each(calls: DataFrame, order: Sequence[str] = ("query_id",)) -> DataFrame:
    """The first call of each model: a canary's rows."""
    rest = [c for c in calls.columns if c not in (*order, "model")]
    return calls.groupBy("model").agg(F.min(F.struct(*order, *rest)).alias("__x")).select("model", "__x.*").select(*calls.columns)

