"""Training histories, of any length: what depends on all steps before is a prefix scan over ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierwise.operators.ranking import in_ranges, scan


def early_stopping(history: DataFrame, patience: int, order: str = "step", loss: str = "loss") -> DataFrame:
    """One row: best_step, best_loss, stop_step (null if training went on): it stops after patience losses in a row that are no new best.

    A loss is a new best if it is below the minimum before it; a row's streak is its place less that of the last new best. Both
    are prefix scans over ranges of steps, so a history of any length is many tasks.
    """
    rows = scan(in_ranges(history, order), order, {"__low": (F.col(loss), "min"), "__before": (F.lit(1), "sum")}, before=True)
    marked = rows.withColumn("__better", F.col("__low").isNull() | (F.col(loss) < F.col("__low"))).withColumn("__place", F.col("__before") + 1)
    streak = scan(marked, order, {"__last": (F.when(F.col("__better"), F.col("__place")), "max")})
    stop = streak.where(F.col("__place") - F.col("__last") >= patience).agg(F.min(order).alias("stop_step"))
    seen = streak.crossJoin(F.broadcast(stop)).where(F.col("__better") & (F.col("stop_step").isNull() | (F.col(order) <= F.col("stop_step"))))
    return seen.agg(F.max_by(order, order).alias("best_step"), F.max_by(loss, order).alias("best_loss"), F.max("stop_step").alias("stop_step"))


def learning_rate(step: Column, total: int, warmup_ratio: float) -> Column:
    """Factor of the learning rate: linear warm-up, then linear decay."""
    warm = int(total * warmup_ratio)
    decay = F.greatest(F.lit(0.0), (F.lit(total) - step) / F.lit(float(max(1, total - warm))))
    return F.when(step < warm, (step + 1) / F.lit(float(warm or 1))).otherwise(decay)


def progress_marks(rows: DataFrame, key: str, total: int, share: float = 0.05) -> DataFrame:
    """done, key of the rows at which progress is told: about every 5 %, and the last. total is the number of rows."""
    every = max(1, round(total * share))
    done = scan(in_ranges(rows, key), key, {"done": (F.lit(1), "sum")})
    return done.where((F.col("done") % every == 0) | (F.col("done") == total)).select("done", key)


def with_validation(history: DataFrame, validation: DataFrame, order: str = "step") -> DataFrame:
    """Training points with the validation values measured at the same step, null where none was."""
    return history.join(validation, order, "left")


def holdout_loss(parts: DataFrame) -> DataFrame:
    """step, loss: for each question the mean over rows (parts hold a mean loss and its rows n), summed over questions."""
    each = parts.groupBy("step", "question").agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))
    return each.groupBy("step").agg(F.sum("loss").alias("loss"))


def micro_batches(parts: DataFrame, accumulate: int) -> DataFrame:
    """step, loss: the mean over the micro-batches between optimizer steps."""
    return parts.groupBy(F.floor(F.col("micro") / accumulate).alias("step")).agg(F.avg("loss").alias("loss"))
