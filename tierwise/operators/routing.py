"""Threshold routing: a query is served by its predicted tier, or by the next one if its confidence is below tau."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierwise.operators.labels import known_sufficient
from tierwise.operators.ranking import running_sums
from tierwise.sources.io import written
from tierwise.tiers import FRONTIER, TIERS

ABOVE_ONE = 1.0000000000000002


def unpriced(runs: DataFrame, rates: DataFrame) -> DataFrame:
    """tier, answers: tiers that answered but have no rate; eval_queries() would leave out all their queries."""
    return runs.where("error is null").groupBy("tier").agg(F.count("*").alias("answers")).join(rates.select("tier"), "tier", "left_anti")


def check_rates(runs: DataFrame, rates: DataFrame) -> DataFrame:
    """rates as they are; an error that names the tiers that answered without one. Runs at once."""
    if missing := sorted(r.tier for r in unpriced(runs, rates).collect()):
        raise ValueError(f"no rates for {missing}")
    return rates


def eval_queries(predicted: DataFrame, runs: DataFrame, verdicts: DataFrame, rates: DataFrame, strict: bool = False) -> DataFrame:
    """query_id, predicted, confidence, cost0 .. cost2, ok0 .. ok2: predictions of queries that all three tiers answered.

    strict makes a prediction without three answers an error.
    """
    ok = runs.where("error is null").select("query_id", "tier_rank", "tier", "prompt_tokens", "completion_tokens")
    judged = verdicts.select("query_id", "tier_rank", "verdict")
    priced = ok.join(F.broadcast(rates), "tier").join(judged, ["query_id", "tier_rank"], "left")
    usd = F.col("prompt_tokens") * F.col("prompt_rate") + F.col("completion_tokens") * F.col("completion_rate")
    rows = priced.select("query_id", "tier_rank", usd.alias("usd"), known_sufficient(F.col("tier_rank"), F.col("verdict")).alias("ok"))
    wide = rows.groupBy("query_id").agg(F.count("*").alias("answers"), *(F.max(F.when(F.col("tier_rank") == i, F.col(c))).alias(f"{n}{i}") for i in range(len(TIERS)) for c, n in (("usd", "cost"), ("ok", "ok"))))
    out = predicted.select("query_id", "predicted", "confidence").join(wide, "query_id", "left" if strict else "inner")
    complete = F.coalesce(F.col("answers") == len(TIERS), F.lit(False))
    if strict:
        if not out.where(~complete).isEmpty():
            raise ValueError("some predictions lack an answer of a tier")
        return out.drop("answers")
    return out.where(complete).drop("answers")


def escalates(confidence: Column, tau: Column, predicted: Column) -> Column:
    return (confidence < tau) & (predicted < FRONTIER)


def candidate_taus(rows: DataFrame) -> DataFrame:
    """tau: 0, every distinct confidence, and the next number above 1."""
    ends = rows.sparkSession.createDataFrame([(0.0,), (ABOVE_ONE,)], "tau double")
    return rows.select(F.col("confidence").alias("tau")).unionByName(ends).distinct()


def _at(name: str, rank: Column) -> Column:
    return F.when(rank == 0, F.col(f"{name}0")).when(rank == 1, F.col(f"{name}1")).otherwise(F.col(f"{name}2"))


def served(queries: DataFrame, tau: float) -> DataFrame:
    """query_id, served, escalated, usd, ok at one threshold."""
    up = escalates(F.col("confidence"), F.lit(tau), F.col("predicted"))
    rank = F.col("predicted") + up.cast("int")
    return queries.select("query_id", rank.alias("served"), up.alias("escalated"), _at("cost", rank).alias("usd"), _at("ok", rank).alias("ok"))


def _outcome(sums: DataFrame) -> DataFrame:
    retained = F.when(F.col("frontier_usd") == 0, F.lit(float("nan"))).otherwise(F.col("total_usd") / F.nullif(F.col("frontier_usd"), F.lit(0.0)))
    return sums.select("tau", "n", "escalated", "total_usd", "frontier_usd", retained.alias("cost_retained"), (F.col("good") / F.col("n")).alias("quality_retained"), "unknown_quality")


def sweep(queries: DataFrame, taus: DataFrame | None = None) -> DataFrame:
    """The outcome at each tau, in one pass: a query changes its tier once, at the first tau above its confidence.

    The changes are summed for each confidence, in the one pass over queries, and written: the thresholds, the sums over all
    queries and the three readings of running_sums() start there. Queries never meet thresholds.
    """
    low, high = F.col("predicted"), F.least(F.col("predicted") + 1, F.lit(FRONTIER))
    good = lambda r: F.coalesce(_at("ok", r), F.lit(False)).cast("long")
    unknown = lambda r: _at("ok", r).isNull().cast("long")
    each = queries.select(
        F.col("confidence").alias("tau"), (F.col("predicted") < FRONTIER).cast("long").alias("d_up"), (_at("cost", high) - _at("cost", low)).alias("d_usd"),
        (good(high) - good(low)).alias("d_good"), (unknown(high) - unknown(low)).alias("d_unknown"), _at("cost", low).alias("b_usd"), F.col("cost2").alias("frontier_usd"), good(low).alias("b_good"), unknown(low).alias("b_unknown"),
    )
    steps, totals = ["d_up", "d_usd", "d_good", "d_unknown"], ["b_usd", "frontier_usd", "b_good", "b_unknown"]
    points = written(each.groupBy("tau").agg(F.count("*").alias("n"), *(F.sum(x).alias(x) for x in [*steps, *totals])))
    base = points.agg(*(F.sum(x).alias(x) for x in ["n", *totals]))
    taus = candidate_taus(points.withColumnRenamed("tau", "confidence")) if taus is None else taus
    marks = taus.select("tau", *(F.lit(0).cast("double" if x == "d_usd" else "long").alias(x) for x in steps), F.lit(1).alias("wanted"))
    along = points.select("tau", *steps, F.lit(0).alias("wanted")).unionByName(marks).groupBy("tau").agg(*(F.sum(x).alias(x) for x in steps), F.max("wanted").alias("wanted"))
    run = running_sums(along, "tau", steps, before=True).where("wanted = 1").crossJoin(F.broadcast(base))
    return _outcome(run.select("tau", "n", F.col("running_d_up").alias("escalated"), (F.col("b_usd") + F.col("running_d_usd")).alias("total_usd"), "frontier_usd", (F.col("b_good") + F.col("running_d_good")).alias("good"), (F.col("b_unknown") + F.col("running_d_unknown")).alias("unknown_quality")))


def sweep_crossed(queries: DataFrame, taus: DataFrame) -> DataFrame:
    """The same by its definition, for a handful of thresholds: each query at each of them."""
    up = escalates(F.col("confidence"), F.col("tau"), F.col("predicted"))
    rank = F.col("predicted") + up.cast("int")
    ok = _at("ok", rank)
    rows = queries.crossJoin(F.broadcast(taus)).groupBy("tau")
    return _outcome(rows.agg(F.count("*").alias("n"), F.sum(up.cast("long")).alias("escalated"), F.sum(_at("cost", rank)).alias("total_usd"), F.sum("cost2").alias("frontier_usd"), F.sum(F.coalesce(ok, F.lit(False)).cast("long")).alias("good"), F.sum(ok.isNull().cast("long")).alias("unknown_quality")))


def select_tau(outcomes: DataFrame, target: float) -> DataFrame:
    """One row: the cheapest tau whose quality meets the target (then the smallest), else the best quality, then the cheapest."""
    met = F.col("quality_retained") >= target
    order = F.when(met, F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("q"), F.col("cost_retained").alias("c"), F.col("tau").alias("t"))).otherwise(F.struct(F.lit(1).alias("k"), (-F.col("quality_retained")).alias("q"), F.col("cost_retained").alias("c"), F.col("tau").alias("t")))
    best = outcomes.agg(F.min_by(F.struct("*"), order).alias("x"), F.bool_or(met).alias("target_met"))
    return best.select("x.*", "target_met")


def tier_means(queries: DataFrame) -> DataFrame:
    """One row: mean cost and quality of each tier if it served everything."""
    return queries.agg(*(F.avg(f"cost{i}").alias(f"usd{i}") for i in range(len(TIERS))), *(F.avg(F.coalesce(F.col(f"ok{i}"), F.lit(False)).cast("double")).alias(f"q{i}") for i in range(len(TIERS))))


def random_router(queries: DataFrame, taus: DataFrame) -> DataFrame:
    """tau, usd_per_1k, quality: what a router blind to the query expects with the same share of each tier.

    For a bounded set of thresholds.
    """
    up = escalates(F.col("confidence"), F.col("tau"), F.col("predicted"))
    rank = F.col("predicted") + up.cast("int")
    shares = queries.select("predicted", "confidence").crossJoin(F.broadcast(taus)).groupBy("tau").agg(*(F.avg((rank == i).cast("double")).alias(f"s{i}") for i in range(len(TIERS))))
    mixed = shares.crossJoin(F.broadcast(tier_means(queries)))
    add = lambda x: sum((F.col(f"s{i}") * F.col(f"{x}{i}") for i in range(1, len(TIERS))), F.col("s0") * F.col(f"{x}0"))
    return mixed.select("tau", (add("usd") * 1000).alias("usd_per_1k"), add("q").alias("quality"))


def always_frontier(queries: DataFrame) -> DataFrame:
    """One point: the frontier's cost, and quality 1 by definition."""
    return queries.agg((F.avg("cost2") * 1000).alias("usd_per_1k")).withColumn("quality", F.lit(1.0))
