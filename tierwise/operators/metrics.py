"""Classification and calibration metrics over predictions: y, predicted, confidence, probs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierwise.functions.exprs import BINS, argmax, bin_edges, one_hot, softmax
from tierwise.operators.ranking import running_sums
from tierwise.tiers import TIERS, tiers


def predictions(logits: DataFrame, temperature: Column | float = 1.0, columns: Sequence[str] = ("z0", "z1", "z2")) -> DataFrame:
    """logits with probs, predicted and confidence."""
    probs = logits.withColumn("probs", softmax(F.array(*columns), temperature))
    return probs.withColumn("predicted", argmax(F.col("probs"))).withColumn("confidence", F.array_max("probs"))


def check(rows: DataFrame, classes: int = len(TIERS)) -> DataFrame:
    """rows as they are; an error if there are none, or if a confidence or label is out of range. Runs at once."""
    bad = F.sum((~F.col("confidence").between(0.0, 1.0 + 1e-12) | ~F.col("y").between(0, classes - 1) | F.col("y").isNull()).cast("long"))
    found = rows.agg(F.count("*").alias("n"), bad.alias("bad")).first()
    if not found.n or found.bad:
        raise ValueError(f"{found.n} rows, {found.bad} out of range")
    return rows


def accuracy(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg((F.col("y") == F.col("predicted")).cast("double")).alias("accuracy"))


def class_counts(rows: DataFrame, labels: Sequence[int] | None = None) -> DataFrame:
    """label, tp, fp, fn for the given labels, or for all seen as truth or prediction."""
    y, p = F.col("y").cast("int"), F.col("predicted").cast("int")
    sides = F.explode(F.when(y == p, F.array(F.struct(y.alias("label"), F.lit("tp").alias("kind")))).otherwise(F.array(F.struct(y.alias("label"), F.lit("fn").alias("kind")), F.struct(p.alias("label"), F.lit("fp").alias("kind")))))
    counts = rows.select(sides.alias("x")).groupBy("x.label").agg(*(F.sum((F.col("x.kind") == k).cast("long")).alias(k) for k in ("tp", "fp", "fn")))
    if labels is not None:
        every = rows.sparkSession.createDataFrame([(int(x),) for x in labels], "label int")
        counts = every.join(counts, "label", "left").na.fill(0, ["tp", "fp", "fn"])
    return counts


def macro_f1(rows: DataFrame, labels: Sequence[int] | None = None) -> DataFrame:
    """Mean F1 over classes; a class with no support and no prediction scores 0."""
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return class_counts(rows, labels).agg(F.avg(f1).alias("macro_f1"))


def brier(rows: DataFrame, k: int = len(TIERS)) -> DataFrame:
    """Mean over rows of the squared distance of probabilities and the one-hot truth."""
    gap = F.aggregate(F.zip_with("probs", one_hot(F.col("y"), k), lambda p, t: (p - t) * (p - t)), F.lit(0.0), lambda a, b: a + b)
    return rows.agg(F.avg(gap).alias("brier"))


def bins(spark: SparkSession, n: int = BINS) -> DataFrame:
    edges = bin_edges(n)
    return spark.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(n)], "bin int, lo double, hi double")


def binned(rows: DataFrame, n: int = BINS) -> DataFrame:
    """bin, n, sum_confidence, hits of bins that have rows: the first closed, the others open on the left.

    The bin is found in a constant array of edges, so no row is compared with all bins by a join.
    """
    edges = F.array(*(F.lit(e) for e in bin_edges(n)[1:-1]))
    at = F.size(F.filter(edges, lambda e: e < F.col("confidence")))
    hit = (F.col("y") == F.col("predicted")).cast("long")
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.sum("confidence").alias("sum_confidence"), F.sum(hit).alias("hits"))


def ece(rows: DataFrame, n: int = BINS) -> DataFrame:
    """Expected calibration error: bins weighted by their rows."""
    gap = F.abs(F.col("sum_confidence") / F.col("n") - F.col("hits") / F.col("n"))
    return binned(rows, n).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def reliability(rows: DataFrame, n: int = BINS) -> DataFrame:
    """bin, lo, hi, n, confidence, accuracy of all bins; the means of an empty one are null."""
    out = bins(rows.sparkSession, n).join(binned(rows, n), "bin", "left")
    return out.select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"), (F.col("sum_confidence") / F.col("n")).alias("confidence"), (F.col("hits") / F.col("n")).alias("accuracy"))


def confusion(rows: DataFrame) -> DataFrame:
    """true_tier, predicted_tier, n, share of the true tier's rows (null if it has none): all nine cells."""
    spark = rows.sparkSession
    cells = tiers(spark).select(F.col("tier_rank").alias("y"), F.col("tier").alias("true_tier")).crossJoin(tiers(spark).select(F.col("tier_rank").alias("predicted"), F.col("tier").alias("predicted_tier")))
    counts = rows.groupBy(F.col("y").cast("int").alias("y"), F.col("predicted").cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    full = cells.join(counts, ["y", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy("y")), F.lit(0))
    return full.select("true_tier", "predicted_tier", "n", share.alias("share"))


def support(rows: DataFrame) -> DataFrame:
    """tier, n: rows of each true tier, 0 if it has none."""
    counts = rows.groupBy(F.col("y").cast("int").alias("tier_rank")).agg(F.count("*").alias("n"))
    return tiers(rows.sparkSession).join(counts, "tier_rank", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"))


def risk_coverage(rows: DataFrame) -> DataFrame:
    """confidence, coverage, risk, n: what is covered and wrong at each distinct confidence, ties let in together."""
    wrong = (F.col("y") != F.col("predicted")).cast("long")
    points = rows.groupBy("confidence").agg(F.count("*").alias("n"), F.sum(wrong).alias("wrong"))
    run = running_sums(points, "confidence", ["n", "wrong"], descending=True)
    total = points.agg(F.sum("n").alias("rows"))
    return run.crossJoin(F.broadcast(total)).select("confidence", (F.col("running_n") / F.col("rows")).alias("coverage"), (F.col("running_wrong") / F.col("running_n")).alias("risk"), "n")


def risk_coverage_series(rows: DataFrame) -> DataFrame:
    """coverage, risk: the points of a figure, which begins at coverage 0 with the risk of the most confident rows."""
    points = risk_coverage(rows).select("coverage", "risk")
    first = points.agg(F.min_by("risk", "coverage").alias("risk")).where("risk is not null").select(F.lit(0.0).alias("coverage"), "risk")
    return first.unionByName(points)


def risk_coverage_auc(rows: DataFrame) -> DataFrame:
    """Mean risk over rows, each at its own confidence."""
    return risk_coverage(rows).agg((F.sum(F.col("risk") * F.col("n")) / F.sum("n")).alias("auc"))


def percentiles(rows: DataFrame, column: str) -> DataFrame:
    """p50, p95, p99 with linear interpolation, exact: ranks are summed in ranges, no task holds all values. Nulls do not count."""
    points = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("n"))
    placed = running_sums(points, "x", ["n"]).crossJoin(F.broadcast(points.agg((F.sum("n") - 1).alias("last"))))
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    at = {name: F.col("last") * p for name, p in shares.items()}
    near = [F.min(F.when(F.col("running_n") > f(x), F.col("x"))).alias(f"{name}_{f.__name__}") for name, x in at.items() for f in (F.floor, F.ceil)]
    found = placed.agg(F.max("last").alias("last"), *near)
    return found.select(*((F.col(f"{name}_floor") + (F.col(f"{name}_ceil") - F.col(f"{name}_floor")) * (x - F.floor(x))).alias(name) for name, x in at.items()))
