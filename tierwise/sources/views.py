"""The driver tables, and deterministic views over them in the shape of the routing tables.

Each view is one SQL text that Spark and DuckDB both run; only the access to array elements differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tierwise.operators.judging import TEMPLATE

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: In the order in which they may use each other.
VIEWS = {
    "v_tiers": "select * from (values (0,'local_small',0.0e0,0.0e0),(1,'mid_tier',1e-6,4e-6),(2,'frontier',1e-5,5e-5)) as t(tier_rank,tier,p_in,p_out)",
    "v_runs": """select query_id, source, prompt, tier_rank, tier, model, prompt_tokens, completion_tokens, error, completion,
       mod(query_id*3+tier_rank,5)<>0 and error is null as cached,
       case when error is not null or mod(query_id*3+tier_rank,5)<>0 then 0.0e0
            else prompt_tokens*p_in + completion_tokens*p_out end as cost_usd
from (select d.doc_id as query_id, d.source, d.text as prompt, t.tier_rank, t.tier, concat('m/',t.tier) as model, t.p_in, t.p_out,
             cast(floor(length(d.text)/4)+8 as bigint) as prompt_tokens,
             cast(50+mod(d.doc_id*(37+11*t.tier_rank)+t.tier_rank*13,400) as bigint) as completion_tokens,
             case mod(d.doc_id,9) when 0 then 'Sorry, I cannot run that code here.' when 1 then 'I am unable to browse the internet.' when 2 then 'As of my last knowledge update, yes.' else 'Yes.' end as completion,
             case when mod(d.doc_id*7+t.tier_rank*3,23)=0 then concat(case mod(d.doc_id,11) when 0 then 'TimeoutError' when 1 then 'ConnectionError' when 2 then 'RateLimitError' when 3 then 'APIConnectionError' when 4 then 'Timeout'
               when 5 then 'ServiceUnavailableError' when 6 then 'InternalServerError' when 7 then 'BadGatewayError' when 8 then 'AuthenticationError' when 9 then 'APIError' else 'BadRequestError' end, ': down') end as error
      from documents d cross join v_tiers t) x""",
    "v_verdicts": """select r.query_id, r.tier_rank, r.tier as candidate_tier, 'frontier' as reference_tier, 'o/judge' as judge_model,
       case when mod(r.query_id*13+r.tier_rank*29,10) < 3+r.tier_rank*2 then 'equivalent'
            when mod(r.query_id*13+r.tier_rank*29,10) < 4+r.tier_rank*3 then 'acceptable' else 'worse' end as verdict
from v_runs r where r.tier_rank<2 and r.error is null and mod(r.query_id*5+r.tier_rank,17)<>0""",
    "v_cache": """select r.query_id, r.tier_rank, r.model, r.prompt_tokens,
       case when mod(r.query_id,11)=0 then cast(1024 as bigint) else r.completion_tokens end as completion_tokens,
       r.prompt_tokens*t.p_in + r.completion_tokens*t.p_out as cost_usd,
       case when mod(r.query_id,4)=0 then 1024 else 4096 end as max_tokens
from v_runs r join v_tiers t on t.tier_rank=r.tier_rank where r.cached""",
    "v_ledger": """select e.event_id, e.ts, t.tier_rank, coalesce(t.tier,'judge') as tier, case when t.tier is null then 'o/judge' else concat('m/',t.tier) end as model,
       e.user_id+1 as prompt_tokens, mod(e.event_id*31,400)+1 as completion_tokens,
       (e.user_id+1)*coalesce(t.p_in,2e-6) + (mod(e.event_id*31,400)+1)*coalesce(t.p_out,8e-6) as usd, e.value as latency_ms
from events e left join v_tiers t
  on t.tier_rank = case e.event_type when 'view' then 0 when 'click' then 1 when 'purchase' then 2 else -1 end
where e.event_type<>'error'""",
    "v_logits": """select vec_id as query_id, y,
       case when mod(vec_id*7,20)<14 then 'train' when mod(vec_id*7,20)<17 then 'calibration' else 'test' end as split,
       {e1}*8 + case when y=0 then mod(vec_id*17,7)*0.6e0 else 0e0 end as z0,
       {e2}*8 + case when y=1 then mod(vec_id*17,7)*0.6e0 else 0e0 end as z1,
       {e3}*8 + case when y=2 then mod(vec_id*17,7)*0.6e0 else 0e0 end as z2
from (select vec_id, embedding, mod(label,3) as y from embeddings) x""",
    "v_replies": """select doc_id, case mod(doc_id,7)
  when 0 then '{{"verdict": "acceptable", "reason": "Correct but terse."}}'
  when 1 then concat(chr(96),chr(96),chr(96),'json',chr(10),'{{"verdict": "worse", "reason": "Wrong."}}',chr(10),chr(96),chr(96),chr(96))
  when 2 then 'Here you go: {{"verdict": "equivalent", "reason": "Same."}}'
  when 3 then '{{"verdict": " Acceptable ", "reason": "Fine.", "x": 1}}'
  when 4 then 'not json'
  when 5 then '{{"verdict": "better", "reason": "x"}}'
  else '{{"verdict": "worse"}}' end as reply from documents""",
    "v_history": "select doc_id+1 as step, 1e0/(doc_id+2) + mod(doc_id*37,11)*0.01e0 as loss from documents",
    "v_answers": """select {s0}concat(coalesce(r.prompt,''),chr(0),r.model){s1} as cache_key, r.model, min_by(r.completion,r.query_id) as completion, min_by(r.prompt_tokens,r.query_id) as prompt_tokens,
       min_by(c.completion_tokens,r.query_id) as completion_tokens, min_by(c.cost_usd,r.query_id) as cost_usd, min_by(c.max_tokens,r.query_id) as max_tokens
from v_runs r join v_cache c on c.query_id=r.query_id and c.tier_rank=r.tier_rank group by 1, 2""",
    "v_judged": """select {s0}concat('{t0}',coalesce(c.prompt,''),'{t1}',f.completion,'{t2}',c.completion,'{t3}',chr(0),'o/judge'){s1} as cache_key,
       cast(60 as bigint) as completion_tokens, max(case when mod(c.query_id,6)=0 then 60 else 4096 end) as max_tokens
from v_runs c join v_runs f on f.query_id=c.query_id and f.tier_rank=2 and f.error is null where c.tier_rank<2 and c.error is null and mod(c.query_id,3)=0 group by 1""",
    "v_options": """select l.query_id, l.split, l.y, l.z0, l.z1, l.z2, x.yt, x.a0, x.a1, x.yr, x.b0, x.b1 from v_logits l
join (select vec_id, mod(vec_id,2) as yt, {e4}*8 + case when mod(vec_id,2)=0 then mod(vec_id*13,9)*0.4e0 else 0e0 end as a0, {e5}*8 + case when mod(vec_id,2)=1 then mod(vec_id*13,9)*0.4e0 else 0e0 end as a1,
             case when mod(vec_id,5)<2 then 1 else 0 end as yr, {e6}*3 + case when mod(vec_id,5)>=2 then 0.7e0 else 0e0 end as b0, {e7}*3 + case when mod(vec_id,5)<2 then 0.7e0 else 0e0 end as b1 from embeddings) x on x.vec_id=l.query_id""",
}
_ELEMENT = {"spark": "cast(element_at(embedding,{i}) as double)", "duckdb": "cast(embedding[{i}] as double)"}

#: Views that Spark gets by another plan with the same rows: keys are worked out before the join, so no prompt is shuffled.
_SPARK = {
    "v_answers": """select k.cache_key, k.model, min_by(k.completion,k.query_id) as completion, min_by(k.prompt_tokens,k.query_id) as prompt_tokens,
       min_by(c.completion_tokens,k.query_id) as completion_tokens, min_by(c.cost_usd,k.query_id) as cost_usd, min_by(c.max_tokens,k.query_id) as max_tokens
from (select query_id, tier_rank, model, completion, prompt_tokens, {s0}concat(coalesce(prompt,''),chr(0),model){s1} as cache_key from v_runs) k
join v_cache c on c.query_id=k.query_id and c.tier_rank=k.tier_rank group by 1, 2""",
}

_HASH = {"spark": {"s0": "sha2(", "s1": ",256)"}, "duckdb": {"s0": "sha256(", "s1": ")"}}


def _chain(engine: str) -> list[str]:
    elements = {f"e{i}": _ELEMENT[engine].format(i=i) for i in range(1, 8)} | _HASH[engine] | {f"t{i}": part.replace("'", "''") for i, part in enumerate(TEMPLATE.split("%s"))}
    return [f"{name} as ({sql.format(**elements)})" for name, sql in (VIEWS | (_SPARK if engine == "spark" else {})).items()]


def oracle(sql: str) -> str:
    """DuckDB SQL that may use the views; sql may begin with its own WITH."""
    sql = sql.strip()
    own = sql[5:] if sql.lower().startswith("with ") else None
    return "with " + ", ".join(_chain("duckdb")) + (", " + own if own else " " + sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a view over them; only what it needs is planned."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    base = [f"{t} as (select * from parquet.`{sf_dir}/{t}.parquet`)" for t in ("documents", "events", "embeddings")]
    chain = _chain("spark")[: list(VIEWS).index(name) + 1]
    return spark.sql("with " + ", ".join(base + chain) + f" select * from {name}")
