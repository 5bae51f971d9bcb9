"""What a fine-tuning run reads and measures: epochs in a replayable order, options in slots, losses by question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwise.functions.exprs import hash_unit, log_sum_exp, query_id
from tierwise.operators.ranking import RANGES, ranked
from tierwise.tiers import SPLITS, TIERS


def epoch_order(rows: DataFrame, seed: int, epochs: Sequence[int], key: str = "query_id") -> DataFrame:
    """epoch, place (from 0), key: each epoch's order by a hash of seed, epoch and id, so a run that goes on sees the same batches.

    An epoch is ranked in ranges of the hash, whose sizes are added up; it is never one sorted task.
    """
    each = rows.select(key, F.explode(F.array(*map(F.lit, epochs))).alias("epoch"))
    unit = each.withColumn("__unit", hash_unit(F.lit(seed), F.lit("order"), F.col("epoch"), F.col(key)))
    found = ranked(unit, ["epoch"], ["__unit", key], F.floor(F.col("__unit") * RANGES).cast("int"))
    return found.select("epoch", F.col("__rank").cast("long").alias("place"), key)


def slots(rows: DataFrame, seed: int, options: int, label: str = "y", key: str = "query_id") -> DataFrame:
    """rows with option_order (the option that each slot shows) and slot (where the label's option is), by a hash of each option."""
    drawn = F.array(*(F.struct(hash_unit(F.lit(seed), F.lit("slot"), F.col(key), F.lit(i)).alias("u"), F.lit(i).alias("i")) for i in range(options)))
    shown = rows.withColumn("option_order", F.transform(F.sort_array(drawn), lambda x: x["i"]))
    return shown.withColumn("slot", (F.array_position("option_order", F.col(label)) - 1).cast("int"))


def slot_loss(logits: Sequence[Column], slot: Column) -> Column:
    """Cross-entropy of the slot that shows the label's option; logits are those of the slots, in order."""
    return log_sum_exp(logits) - F.get(F.array(*logits), slot)


def margin_loss(true_logit: Column, false_logit: Column, y: Column) -> Column:
    """Binary cross-entropy of the true option's logit less the false one's: the same as slot_loss over both."""
    m = true_logit - false_logit
    return F.greatest(m, F.lit(0.0)) - m * y.cast("double") + F.log1p(F.exp(-F.abs(m)))


def question_losses(rows: DataFrame, loss: str = "loss", question: str = "question") -> DataFrame:
    """question, n, loss: the mean of each question."""
    return rows.groupBy(question).agg(F.count("*").alias("n"), F.avg(loss).alias("loss"))


def synthetic_examples(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """n labelled examples made from hashes of their number, for trying out what reads examples: query_id, prompt, source, split, tier, needs_tools, needs_rag."""
    unit = lambda what: hash_unit(F.lit(seed), F.lit(what), F.col("id"))
    one_of = lambda what, names: F.get(F.array(*map(F.lit, names)), F.floor(unit(what) * len(names)).cast("int"))
    prompt = F.concat(F.lit("made-up prompt "), F.col("id").cast("string"), F.lit(" of seed "), F.lit(str(seed)))
    split = F.when(unit("split") < 0.7, SPLITS[0]).when(unit("split") < 0.85, SPLITS[1]).otherwise(SPLITS[2])
    rows = spark.range(n).select(prompt.alias("prompt"), F.lit("synthetic").alias("source"), split.alias("split"), one_of("tier", TIERS).alias("tier"), (unit("tools") < 0.2).alias("needs_tools"), (unit("rag") < 0.2).alias("needs_rag"))
    return rows.select(query_id(F.col("prompt")).alias("query_id"), *rows.columns)
