"""Call ledgers: history, totals, recovered prices, estimates of calls still to make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwise.functions.exprs import cache_key, cost_tokens, error_class, round_even
from tierwise.operators.joins import lookup
from tierwise.operators.judging import judge_prompt
from tierwise.tiers import FRONTIER

ANSWER_TOKENS, VERDICT_TOKENS, LEAST_ROWS = 400, 60, 3
#: Fixed values that must equal the reference's: names of error classes worth another try.
RETRYABLE = ["TimeoutError", "ConnectionError", "RateLimitError", "APIConnectionError", "Timeout", "ServiceUnavailableError", "InternalServerError", "BadGatewayError"]


def run_counts(runs: DataFrame) -> DataFrame:
    """tier, runs, ok, failed, retryable."""
    ok = F.col("error").isNull()
    again = F.coalesce(error_class(F.col("error")).isin(*RETRYABLE), F.lit(False))
    return runs.groupBy("tier").agg(F.count("*").alias("runs"), F.sum(ok.cast("long")).alias("ok"), F.sum((~ok).cast("long")).alias("failed"), F.sum(again.cast("long")).alias("retryable"))


def ledger_history(ledger: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """model, completion_tokens, latency_ms (means), n for models with enough rows."""
    return ledger.groupBy("model").agg(F.avg("completion_tokens").alias("completion_tokens"), F.avg("latency_ms").alias("latency_ms"), F.count("*").alias("n")).where(F.col("n") >= least)


def ledger_totals(ledger: DataFrame) -> DataFrame:
    """tier, usd of each tag and of 'total'."""
    out = ledger.rollup("tier").agg(F.grouping("tier").alias("__all"), F.sum("usd").alias("usd"))
    return out.select(F.when(F.col("__all") == 1, "total").otherwise(F.col("tier")).alias("tier"), F.coalesce("usd", F.lit(0.0)).alias("usd"))


def answered_only(ledger: DataFrame, runs: DataFrame) -> DataFrame:
    """Ledger rows of real tiers whose (tier, model) answered; these pairs are as few as models, so they are broadcast."""
    pairs = runs.where("error is null").select("tier", "model").distinct()
    return ledger.where("tier <> 'judge'").join(F.broadcast(pairs), ["tier", "model"], "left_semi")


def token_rates(ledger: DataFrame) -> DataFrame:
    """tier, prompt_rate, completion_rate: USD a token by least squares without intercept.

    The system is singular if all rows have one share of prompt tokens; shares of counts below 2**26 are told apart
    exactly. A singular system or a negative rate falls back to one blended rate; rates are not below 0, and 0 without tokens.
    """
    p, c, u = F.col("prompt_tokens"), F.col("completion_tokens"), F.col("usd")
    wide = lambda x: F.sum(x.cast("decimal(19,0)"))
    # usd is scaled so that products with token counts keep their precision
    share = F.try_divide(p, p + c)
    sums = ledger.groupBy("tier").agg((F.min(share) < F.max(share)).alias("several"), wide(p * p).alias("pp"), wide(p * c).alias("pc"), wide(c * c).alias("cc"), F.sum(p * u * 1e6).alias("pu"), F.sum(c * u * 1e6).alias("cu"), F.sum(p + c).alias("tokens"), F.sum(u * 1e6).alias("usd"))
    d = lambda x: F.col(x).cast("double")
    det = d("pp") * d("cc") - d("pc") * d("pc")
    exact = F.coalesce(F.col("several"), F.lit(False))
    solved = sums.withColumn("a", F.when(exact, (d("pu") * d("cc") - d("cu") * d("pc")) / F.nullif(det, F.lit(0.0)))).withColumn("b", F.when(exact, (d("cu") * d("pp") - d("pu") * d("pc")) / F.nullif(det, F.lit(0.0))))
    good = F.coalesce((F.col("a") >= -1e-6) & (F.col("b") >= -1e-6), F.lit(False))
    blended = F.coalesce(F.try_divide(d("usd"), d("tokens")), F.lit(0.0))
    rate = lambda x: F.greatest(F.when(good, F.col(x)).otherwise(blended), F.lit(0.0)) / 1e6
    return solved.select("tier", rate("a").alias("prompt_rate"), rate("b").alias("completion_rate"))


def cut_off(cache: DataFrame, cap: int) -> DataFrame:
    """cache with cut_off: the answer filled its limit and the cap is higher now."""
    return cache.withColumn("cut_off", (F.col("completion_tokens") >= F.col("max_tokens")) & (F.lit(cap) > F.col("max_tokens")))


def uncached(calls: DataFrame, cache: DataFrame, cap: int, keys: list[str]) -> DataFrame:
    """Calls without a usable cached answer."""
    usable = cut_off(cache, cap).where("not cut_off").select(*keys)
    return calls.join(usable, keys, "left_anti")


def estimate(calls: DataFrame, cache: DataFrame, ledger: DataFrame, prices: DataFrame, cap: int) -> DataFrame:
    """One row for each tier: calls, cached, prompt and completion tokens, ceiling, usd, usd_max, hosted.

    calls: query_id, tier_rank, tier, model, prompt; prices: tier_rank, p_in, p_out, local. A cache with cache_key is
    content-addressed and met by prompt and model, any other by query and tier.
    """
    by_key = "cache_key" in cache.columns
    keys = ["cache_key"] if by_key else ["query_id", "tier_rank"]
    calls = calls.withColumn("cache_key", cache_key(F.coalesce("prompt", F.lit("")), F.col("model"))) if by_key else calls
    # counted before a join, so that no text is shuffled
    calls = calls.select("tier_rank", "tier", "model", *(k for k in keys if k != "tier_rank"), cost_tokens(F.col("prompt")).alias("asked"))
    hits = cut_off(cache, cap).where("not cut_off").select(*keys, F.lit(True).alias("hit"))
    marked = lookup(calls, hits, keys) if by_key else calls.join(hits, keys, "left")
    new = F.col("hit").isNull()
    sums = marked.groupBy("tier_rank", "tier", "model").agg(F.count("*").alias("calls"), F.sum((~new).cast("long")).alias("cached"), F.coalesce(F.sum(F.when(new, F.col("asked"))), F.lit(0)).alias("prompt_tokens"))
    history = ledger_history(ledger).select("model", round_even(F.col("completion_tokens")).alias("expected"))
    out = sums.join(history, "model", "left").join(prices, "tier_rank", "left").withColumn("new_calls", F.col("calls") - F.col("cached"))
    out = out.withColumn("completion_tokens", F.col("new_calls") * F.coalesce("expected", F.lit(ANSWER_TOKENS))).withColumn("completion_ceiling", F.col("new_calls") * cap)
    usd = lambda x: F.col("prompt_tokens") * F.col("p_in") + F.col(x) * F.col("p_out")
    return out.select("tier", "model", "calls", "cached", "new_calls", "prompt_tokens", "completion_tokens", "completion_ceiling", usd("completion_tokens").alias("usd"), usd("completion_ceiling").alias("usd_max"), (~F.col("local")).alias("hosted"))


def judge_pairs(runs: DataFrame) -> DataFrame:
    """query_id, tier_rank of every successful cheaper answer to a query with a frontier answer, with both runs' columns."""
    ok = runs.where("error is null")
    front = ok.where(F.col("tier_rank") == FRONTIER).select("query_id", F.col("model").alias("reference_model"), F.col("completion_tokens").alias("reference_tokens"))
    return ok.where(F.col("tier_rank") < FRONTIER).join(front, "query_id")


def judge_estimate(runs: DataFrame, template_tokens: int, judge_model: str, ledger: DataFrame, cap: int) -> DataFrame:
    """One row: calls, prompt tokens (template, question, expected answers), completion tokens and ceiling of the judge.

    Questions are counted before they meet a join, and pairs are summed by their two models before the models' history comes
    in: no text is shuffled, and no model is one task.
    """
    history = ledger_history(ledger).select("model", round_even(F.col("completion_tokens")).alias("expected"))
    asked = runs.select("query_id", "tier_rank", "model", "completion_tokens", "error", cost_tokens(F.col("prompt")).alias("asked"))
    # a pair without a question counts as a call, but has no tokens
    by_models = judge_pairs(asked).groupBy("model", "reference_model").agg(F.count("*").alias("calls"), F.count("asked").alias("known"), F.sum("asked").alias("asked"))
    of_models = by_models.join(history.withColumnRenamed("expected", "own"), "model", "left").join(history.select(F.col("model").alias("reference_model"), F.col("expected").alias("ref")), "reference_model", "left")
    answers = F.coalesce("own", F.lit(ANSWER_TOKENS)) + F.coalesce("ref", F.lit(ANSWER_TOKENS))
    tokens = F.coalesce("asked", F.lit(0)) + F.col("known") * (template_tokens + answers)
    sums = of_models.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.coalesce(F.sum(tokens), F.lit(0)).alias("prompt_tokens"))
    each = history.where(F.col("model") == judge_model).agg(F.coalesce(F.max("expected"), F.lit(VERDICT_TOKENS)).alias("each"))
    return sums.crossJoin(F.broadcast(each)).select("calls", "prompt_tokens", (F.col("calls") * F.col("each")).alias("completion_tokens"), (F.col("calls") * cap).alias("completion_ceiling"))


def judge_stage(calls: DataFrame, answers: DataFrame, judged: DataFrame, judge_model: str, template_tokens: int, ledger: DataFrame, cap: int, runs: bool) -> DataFrame:
    """One row: calls, cached, new_calls, prompt tokens, completion tokens and ceiling of the judge's stage.

    calls: query_id, tier_rank, prompt, model of every pair of query and tier; answers: query_id, tier_rank, completion of those known: with
    runs what was answered (queries without a frontier answer, and candidates without an answer, are left out), else what the cache of
    answers knows. Where both answers are known the judge's prompt is too: it may be in the judge's own cache (judged: keys and
    limits), else its exact length counts. Otherwise it has the template, the question and the answers as long as their models' answers usually are.
    """
    history = ledger_history(ledger).select("model", round_even(F.col("completion_tokens")).alias("expected"))
    known = calls.join(answers.select("query_id", "tier_rank", "completion"), ["query_id", "tier_rank"], "left").join(F.broadcast(history), "model", "left")
    known = known.withColumn("expected", F.coalesce("expected", F.lit(ANSWER_TOKENS)))
    front = known.where(F.col("tier_rank") == FRONTIER).select("query_id", F.col("completion").alias("reference"), F.col("expected").alias("ref"))
    pairs = known.where(F.col("tier_rank") < FRONTIER).join(front, "query_id")
    if runs:
        pairs = pairs.where("reference is not null and completion is not null")
    prompt = F.when(F.col("reference").isNotNull() & F.col("completion").isNotNull(), judge_prompt(F.coalesce("prompt", F.lit("")), F.col("reference"), F.col("completion")))
    tokens = F.coalesce(cost_tokens(prompt), F.lit(template_tokens) + cost_tokens(F.coalesce("prompt", F.lit(""))) + F.col("expected") + F.col("ref"))
    pairs = pairs.select(tokens.alias("tokens"), cache_key(prompt, F.lit(judge_model)).alias("cache_key"))
    hits = cut_off(judged, cap).where("not cut_off").select("cache_key", F.lit(True).alias("hit"))
    sums = pairs.join(hits, "cache_key", "left").agg(F.count("*").alias("calls"), F.count("hit").alias("cached"), F.coalesce(F.sum(F.when(F.col("hit").isNull(), F.col("tokens"))), F.lit(0)).alias("prompt_tokens"))
    each = history.where(F.col("model") == judge_model).agg(F.coalesce(F.max("expected"), F.lit(VERDICT_TOKENS)).alias("each"))
    new = F.col("calls") - F.col("cached")
    return sums.crossJoin(F.broadcast(each)).select("calls", "cached", new.alias("new_calls"), "prompt_tokens", (new * F.col("each")).alias("completion_tokens"), (new * cap).alias("completion_ceiling"))


def estimate_totals(stages: DataFrame) -> DataFrame:
    """One row: calls to make, usd, usd_max, needs_confirmation (a hosted call), unpriced (models without a price, sorted)."""
    return stages.agg(
        F.sum("new_calls").alias("new_calls"), F.sum(F.coalesce("usd", F.lit(0.0))).alias("usd"), F.sum(F.coalesce("usd_max", F.lit(0.0))).alias("usd_max"),
        F.bool_or((F.col("new_calls") > 0) & F.col("hosted")).alias("needs_confirmation"),
        F.array_join(F.sort_array(F.collect_set(F.when((F.col("new_calls") > 0) & F.col("usd").isNull(), F.col("model")))), ",").alias("unpriced"),
    )


def gate(totals: DataFrame, yes: bool) -> str:
    """'dry run' for hosted calls without consent, 'refused' for unpriced ones, else 'go'. One row is read."""
    row = totals.first()
    if row.needs_confirmation and not yes:
        return "dry run"
    return "refused" if row.unpriced else "go"
