"""Queries on ledgers, caches and cost estimates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tierwise.operators import calls as A
from tierwise.operators import costs as C
from tierwise.operators.judging import TEMPLATE
from tierwise.registry import query
from tierwise.sources import cache
from tierwise.sources.io import shared_place
from tierwise.sources.views import oracle, view
from tierwise.streaming import calls as S

CAP = 4096
TEMPLATE_TOKENS = 250
KEY = "sha256(coalesce(r.prompt, '') || chr(0) || r.model)"
_HISTORY = "hist as (select model, avg(completion_tokens) as c, avg(latency_ms) as l, count(*) as n from v_ledger group by model having count(*) >= 3)"
_STAGES = _HISTORY + """, usable as (select cache_key from v_answers where not (completion_tokens >= max_tokens and 4096 > max_tokens)),
st as (select r.tier_rank, r.tier, r.model, count(*) as calls, count(u.cache_key) as cached, count(*) - count(u.cache_key) as new_calls, coalesce(sum(case when u.cache_key is null then length(r.prompt) // 4 + 8 end), 0)::bigint as prompt_tokens
  from v_runs r left join usable u on u.cache_key = """ + KEY + """ group by r.tier_rank, r.tier, r.model),
es as (select st.tier, st.model, calls, cached, new_calls, prompt_tokens, (new_calls * coalesce(round_even(c, 0), 400))::bigint as completion_tokens, new_calls * 4096 as completion_ceiling, p_in, p_out, st.tier_rank > 0 as hosted
  from st left join hist on hist.model = st.model join v_tiers t on t.tier_rank = st.tier_rank),
ez as (select *, prompt_tokens * p_in + completion_tokens * p_out as usd, prompt_tokens * p_in + completion_ceiling * p_out as usd_max from es)"""


@query("ledger_history", oracle("select model, round(avg(completion_tokens), 6) as completion_tokens, round(avg(latency_ms), 6) as latency_ms, count(*) as n from v_ledger group by model having count(*) >= 3"))
def ledger_history(spark, sf_dir):
    return C.ledger_history(view(spark, sf_dir, "v_ledger")).select("model", F.round("completion_tokens", 6).alias("completion_tokens"), F.round("latency_ms", 6).alias("latency_ms"), "n")


@query("ledger_totals", oracle("select coalesce(tier, 'total') as tier, round(sum(usd), 8) as usd from v_ledger group by rollup (tier)"))
def ledger_totals(spark, sf_dir):
    return C.ledger_totals(view(spark, sf_dir, "v_ledger")).withColumn("usd", F.round("usd", 8))


_RATES = """with s as (select tier, sum(prompt_tokens * prompt_tokens)::double as pp, sum(prompt_tokens * completion_tokens)::double as pc, sum(completion_tokens * completion_tokens)::double as cc,
  sum(prompt_tokens * usd * 1e6) as pu, sum(completion_tokens * usd * 1e6) as cu, sum(prompt_tokens + completion_tokens)::double as t, sum(usd * 1e6) as u from {rows} group by tier),
d as (select *, case when pp * cc > pc * pc then (pu * cc - cu * pc) / (pp * cc - pc * pc) end as a, case when pp * cc > pc * pc then (cu * pp - pu * pc) / (pp * cc - pc * pc) end as b from s)
select tier, round(greatest(case when a >= -1e-6 and b >= -1e-6 then a else u / t end, 0), 6) as prompt_rate, round(greatest(case when a >= -1e-6 and b >= -1e-6 then b else u / t end, 0), 6) as completion_rate from d"""


def _rates(ledger):
    # USD a million tokens: rounded rates keep their digits
    return C.token_rates(ledger).select("tier", F.round(F.col("prompt_rate") * 1e6, 6).alias("prompt_rate"), F.round(F.col("completion_rate") * 1e6, 6).alias("completion_rate"))


@query("token_rates", oracle(_RATES.format(rows="v_ledger where tier <> 'judge'")))
def token_rates(spark, sf_dir):
    return _rates(C.answered_only(view(spark, sf_dir, "v_ledger"), view(spark, sf_dir, "v_runs")))


@query("token_rates_blended", oracle(_RATES.format(rows="(select tier, 2 * (event_id % 50 + 1) as prompt_tokens, event_id % 50 + 1 as completion_tokens, usd from v_ledger)")))
def token_rates_blended(spark, sf_dir):
    one = F.col("event_id") % 50 + 1
    return _rates(view(spark, sf_dir, "v_ledger").select("tier", (2 * one).alias("prompt_tokens"), one.alias("completion_tokens"), "usd"))


@query("cut_off_cache", oracle("select query_id, tier_rank, completion_tokens >= max_tokens and 4096 > max_tokens as cut_off from v_cache"))
def cut_off_cache(spark, sf_dir):
    return C.cut_off(view(spark, sf_dir, "v_cache"), CAP).select("query_id", "tier_rank", "cut_off")


@query("uncached_calls", oracle(f"select query_id, tier_rank from v_runs r where not exists (select 1 from v_answers c where c.cache_key = {KEY} and not (c.completion_tokens >= c.max_tokens and 4096 > c.max_tokens))"))
def uncached_calls(spark, sf_dir):
    return A.uncached_calls(A.keyed(view(spark, sf_dir, "v_runs")).select("query_id", "tier_rank", "cache_key"), view(spark, sf_dir, "v_answers"), CAP).select("query_id", "tier_rank")


@query("cached_calls", oracle(f"select r.query_id, r.tier_rank, c.cache_key is not null as hit, c.completion as known, round(c.cost_usd, 9) as known_usd from v_runs r left join v_answers c on c.cache_key = {KEY} and not (c.completion_tokens >= c.max_tokens and 4096 > c.max_tokens)"))
def cached_calls(spark, sf_dir):
    calls = A.keyed(view(spark, sf_dir, "v_runs")).select("query_id", "tier_rank", "cache_key")
    return A.cached_calls(calls, view(spark, sf_dir, "v_answers"), CAP).select("query_id", "tier_rank", "hit", "known", F.round("known_usd", 9).alias("known_usd"))


@query("duplicate_calls", oracle(f"select query_id, tier_rank, row_number() over (partition by {KEY} order by query_id, tier_rank) > 1 as cached from v_runs r"))
def duplicate_calls(spark, sf_dir):
    return A.duplicates(A.keyed(view(spark, sf_dir, "v_runs")).select("query_id", "tier_rank", "cache_key")).select("query_id", "tier_rank", "cached")


def _estimate(spark, sf_dir, unpriced: int | None = None):
    """Stages of all runs; one tier may be without a price."""
    price = lambda c: F.when(F.col("tier_rank") != unpriced, F.col(c)) if unpriced is not None else F.col(c)
    prices = view(spark, sf_dir, "v_tiers").select("tier_rank", price("p_in").alias("p_in"), price("p_out").alias("p_out"), (F.col("tier_rank") == 0).alias("local"))
    return C.estimate(view(spark, sf_dir, "v_runs"), view(spark, sf_dir, "v_answers"), view(spark, sf_dir, "v_ledger"), prices, CAP)


@query("cost_estimate", oracle(f"with {_STAGES} select tier, model, calls, cached, new_calls, prompt_tokens, completion_tokens, completion_ceiling, round(usd, 8) as usd, round(usd_max, 8) as usd_max, hosted from ez"))
def cost_estimate(spark, sf_dir):
    return _estimate(spark, sf_dir).withColumn("usd", F.round("usd", 8)).withColumn("usd_max", F.round("usd_max", 8))


@query("estimate_totals", oracle(f"with {_STAGES} select sum(new_calls)::bigint as new_calls, round(sum(case when tier = 'mid_tier' then 0 else usd end), 8) as usd, round(sum(case when tier = 'mid_tier' then 0 else usd_max end), 8) as usd_max, bool_or(new_calls > 0 and hosted) as needs_confirmation, string_agg(distinct model, ',' order by model) filter (tier = 'mid_tier' and new_calls > 0) as unpriced from ez"))
def estimate_totals(spark, sf_dir):
    # the mid tier has no price
    return C.estimate_totals(_estimate(spark, sf_dir, 1)).withColumn("usd", F.round("usd", 8)).withColumn("usd_max", F.round("usd_max", 8))


@query("judge_pairs", oracle("select c.query_id, c.tier_rank from v_runs c join v_runs f on f.query_id = c.query_id and f.tier_rank = 2 and f.error is null where c.tier_rank < 2 and c.error is null"))
def judge_pairs(spark, sf_dir):
    return C.judge_pairs(view(spark, sf_dir, "v_runs")).select("query_id", "tier_rank")


@query("judge_pair_counts", oracle("select c.tier_rank, count(*) as expected, count(v.query_id) as verdicts, count(*) - count(v.query_id) as failures from v_runs c join v_runs f on f.query_id = c.query_id and f.tier_rank = 2 and f.error is null left join v_verdicts v on v.query_id = c.query_id and v.tier_rank = c.tier_rank where c.tier_rank < 2 and c.error is null group by c.tier_rank"))
def judge_pair_counts(spark, sf_dir):
    pairs = C.judge_pairs(view(spark, sf_dir, "v_runs")).select("query_id", "tier_rank")
    got = pairs.join(view(spark, sf_dir, "v_verdicts").select("query_id", "tier_rank", F.lit(1).alias("one")), ["query_id", "tier_rank"], "left")
    return got.groupBy("tier_rank").agg(F.count("*").alias("expected"), F.count("one").alias("verdicts")).withColumn("failures", F.col("expected") - F.col("verdicts"))


@query("judge_estimate", oracle(f"with {_HISTORY} select count(*) as calls, sum({TEMPLATE_TOKENS} + length(c.prompt) // 4 + 8 + coalesce(round_even(h.c, 0), 400) + coalesce(round_even(g.c, 0), 400))::bigint as prompt_tokens, (count(*) * (select coalesce(max(round_even(c, 0)), 60) from hist where model = 'o/judge'))::bigint as completion_tokens, count(*) * 4096 as completion_ceiling from v_runs c join v_runs f on f.query_id = c.query_id and f.tier_rank = 2 and f.error is null left join hist h on h.model = c.model left join hist g on g.model = f.model where c.tier_rank < 2 and c.error is null"))
def judge_estimate(spark, sf_dir):
    return C.judge_estimate(view(spark, sf_dir, "v_runs"), TEMPLATE_TOKENS, "o/judge", view(spark, sf_dir, "v_ledger"), CAP)


_JUDGE = """exact as (select c.query_id, c.tier_rank, c.prompt, cm.completion as own, fm.completion as ref, coalesce(round_even(h.c, 0), 400) as eo, coalesce(round_even(g.c, 0), 400) as er from v_runs c join v_runs f on f.query_id = c.query_id and f.tier_rank = 2
  left join known cm on cm.query_id = c.query_id and cm.tier_rank = c.tier_rank left join known fm on fm.query_id = c.query_id and fm.tier_rank = 2 left join hist h on h.model = c.model left join hist g on g.model = f.model where c.tier_rank < 2),
texts as (select *, '{t0}' || coalesce(prompt, '') || '{t1}' || ref || '{t2}' || own || '{t3}' as jp from exact {only}),
judged as (select cache_key from v_judged where not (completion_tokens >= max_tokens and 4096 > max_tokens)),
js as (select count(*) as calls, count(j.cache_key) as cached, coalesce(sum(case when j.cache_key is null then coalesce(length(jp) // 4 + 8, 250 + length(coalesce(prompt, '')) // 4 + 8 + eo + er) end), 0)::bigint as prompt_tokens from texts left join judged j on j.cache_key = sha256(jp || chr(0) || 'o/judge')),
je as (select coalesce(max(round_even(c, 0)), 60) as each from hist where model = 'o/judge')
select calls, cached, calls - cached as new_calls, prompt_tokens, ((calls - cached) * each)::bigint as completion_tokens, (calls - cached) * 4096 as completion_ceiling from js cross join je"""
_PARTS = {f"t{i}": x.replace("'", "''") for i, x in enumerate(TEMPLATE.split("%s"))}


def _judge_stage(spark, sf_dir, answers, runs):
    calls = view(spark, sf_dir, "v_runs").select("query_id", "tier_rank", "prompt", "model")
    return C.judge_stage(calls, answers, view(spark, sf_dir, "v_judged"), "o/judge", TEMPLATE_TOKENS, view(spark, sf_dir, "v_ledger"), CAP, runs)


@query("judge_estimate_runs", oracle(f"with {_HISTORY}, known as (select query_id, tier_rank, completion from v_runs where error is null), " + _JUDGE.format(only="where own is not null and ref is not null", **_PARTS)))
def judge_estimate_runs(spark, sf_dir):
    return _judge_stage(spark, sf_dir, view(spark, sf_dir, "v_runs").where("error is null"), True)


@query("judge_estimate_cached", oracle(f"with {_HISTORY}, known as (select r.query_id, r.tier_rank, a.completion from v_runs r join v_answers a on a.cache_key = {KEY} and not (a.completion_tokens >= a.max_tokens and 4096 > a.max_tokens)), " + _JUDGE.format(only="", **_PARTS)))
def judge_estimate_cached(spark, sf_dir):
    calls = A.keyed(view(spark, sf_dir, "v_runs")).select("query_id", "tier_rank", "cache_key")
    known = A.cached_calls(calls, view(spark, sf_dir, "v_answers"), CAP).where("hit").select("query_id", "tier_rank", F.col("known").alias("completion"))
    return _judge_stage(spark, sf_dir, known, False)


def echo():
    """A deterministic client: some prompts fail for good, some once, and one model knows its own price."""
    tried: set[tuple[str, str]] = set()

    def ask(prompt: str, model: str) -> dict:
        n = len(prompt)
        if n % 13 == 5:
            raise ValueError("refused")
        if n % 7 == 3 and (prompt, model) not in tried:
            tried.add((prompt, model))
            raise TimeoutError("once")
        return {"completion": f"{model}:{n}", "prompt_tokens": n // 4 + 8, "completion_tokens": n % 400 + 1, "usd": n * 1e-6 if model == "m/frontier" else None}

    return ask


@query("completed_calls", oracle(f"""with k as (select r.*, {KEY} as key, length(coalesce(r.prompt, '')) as len, a.cache_key is not null as hit, a.completion as ac, a.prompt_tokens as ap, a.completion_tokens as an from v_runs r left join v_answers a on a.cache_key = {KEY} and not (a.completion_tokens >= a.max_tokens and 4096 > a.max_tokens)),
d as (select *, hit or row_number() over (partition by key order by query_id, tier_rank) > 1 as late, not hit and len % 13 = 5 as bad from k)
select query_id, tier_rank, case when hit then ac when bad then '' else model || ':' || len end as completion, case when hit then ap when bad then 0 else len // 4 + 8 end as prompt_tokens, case when hit then an when bad then 0 else len % 400 + 1 end as completion_tokens,
  round(case when late or bad then 0 when tier_rank = 0 then 0 when tier_rank = 1 then (len // 4 + 8) * 1e-6 + (len % 400 + 1) * 4e-6 else len * 1e-6 end, 9) as cost_usd, late and not bad as cached, case when bad then 'ValueError: refused' end as error from d"""))
def completed_calls(spark, sf_dir):
    name, place = f"answers_{uuid.uuid4().hex}", shared_place(spark)
    answers = view(spark, sf_dir, "v_answers").withColumn("latency_s", F.lit(0.5)).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    cache.put(answers, name, 8)
    prices = view(spark, sf_dir, "v_tiers").where("tier_rank < 2").select(F.concat(F.lit("m/"), "tier").alias("model"), "p_in", "p_out")
    runs = S.answered(view(spark, sf_dir, "v_runs").select("query_id", "tier_rank", "prompt", "model"), name, echo, prices, place, "1", CAP, 8, base=0.0)
    # the runs are files of their own
    spark.sql(f"drop table {name}")
    return runs.select("query_id", "tier_rank", "completion", "prompt_tokens", "completion_tokens", F.round("cost_usd", 9).alias("cost_usd"), "cached", "error")
