"""Seed prompts: sources interleaved, filtered, deduplicated, limited."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierwise.functions.exprs import normalize, query_id, seed_tokens, strip
from tierwise.operators.ranking import RANGES, ranked

MAX_CHARS = 1500


def first_user_turn(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key, prompt: the text of each conversation's first user turn, if it is not empty; later turns do not stand in."""
    first = turns.where(F.col("role") == "user").groupBy(key).agg(F.min_by("text", order).alias("prompt"))
    return first.where(F.length("prompt") > 0)


def first_user_message(messages: Column) -> Column:
    """The first user message of an array of (role, content); null if there is none or it is empty."""
    content = F.get(F.filter(messages, lambda m: m["role"] == "user"), F.lit(0))["content"]
    return F.when(F.length(content) > 0, content)


def sources_of(registry: Mapping[str, Callable[[], DataFrame]], names: Sequence[str]) -> list[tuple[str, DataFrame]]:
    """(name, rows) of the named sources; no name or an unknown one is an error."""
    if not names:
        raise ValueError("no sources given")
    if unknown := [x for x in names if x not in registry]:
        raise ValueError(f"unknown sources: {unknown}; have {sorted(registry)}")
    return [(x, registry[x]()) for x in names]


def interleave(sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of all sources (pos, text, domain) with source, ordinal and turn.

    turn counts a source's rows from 1 in the order of pos, a number, before any filter. A source is ranked in ranges
    between approximate quantiles (a bounded array for each source). Sources are read three times.
    """
    parts = [rows.select(F.lit(name).alias("source"), F.lit(i).alias("ordinal"), F.col("pos"), F.col("text"), F.col("domain")) for i, (name, rows) in enumerate(sources)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # a row of bounded size for each source named in the call
    cuts = every.groupBy(F.col("ordinal").alias("__ordinal")).agg(F.approx_percentile("pos", [i / RANGES for i in range(1, RANGES)], RANGES * 20).alias("__cuts"))
    cut = every.join(F.broadcast(cuts), F.col("ordinal") == F.col("__ordinal")).drop("__ordinal")
    place = F.size(F.filter(F.coalesce("__cuts", F.array().cast("array<double>")), lambda c: c.cast("double") < F.col("pos").cast("double")))
    found = ranked(cut.withColumn("__place", place).drop("__cuts"), ["source", "ordinal"], ["pos"], F.col("__place"))
    return found.withColumn("turn", (F.col("__rank") + 1).cast("int")).drop("__rank", "__size", "__place")


def seed_prompts(interleaved: DataFrame, limit: int, max_chars: int = MAX_CHARS) -> DataFrame:
    """The first limit prompts in turn: stripped, not empty, not too long, the first of each normal form."""
    prompt = strip(F.col("text"))
    rows = interleaved.withColumn("prompt", prompt).where((F.length("prompt") > 0) & (F.length("prompt") <= max_chars)).withColumn("key", normalize(F.col("prompt")))
    first = rows.groupBy("key").agg(F.min_by(F.struct("turn", "ordinal", "prompt", "source", "domain"), F.struct("turn", "ordinal")).alias("x")).select("x.*")
    return first.orderBy("turn", "ordinal").limit(limit).select(query_id(F.col("prompt")).alias("query_id"), "prompt", "source", "domain", seed_tokens(F.col("prompt")).alias("token_estimate"), "turn", "ordinal")


def dedup_normalized(rows: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """The first row, by order, of each normal form of a text."""
    return rows.groupBy(normalize(F.col(text)).alias("key")).agg(F.min_by(F.struct(*rows.columns), order).alias("x")).select("x.*")
