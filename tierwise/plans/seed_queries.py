"""Queries on prompts: seed, ids, hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierwise.functions import exprs as X
from tierwise.operators import seed
from tierwise.registry import query
from tierwise.sources import prompts
from tierwise.sources.views import oracle, table, view

LIMIT = 200
_NORM = r"replace(replace(lower(trim(regexp_replace({}, '[\s\x1c-\x1f\p{{Z}}\x85]+', ' ', 'g'))), 'ß', 'ss'), 'ς', 'σ')"
_STRIP = r"regexp_replace({}, '^[\s\x1c-\x1f\p{{Z}}\x85]+|[\s\x1c-\x1f\p{{Z}}\x85]+$', '', 'g')"


_SEED = oracle(f"""with u as (
  select 'conversations' as source, 0 as ordinal, conv_id as pos, p as text from (select conv_id, arg_min(text, turn) filter (role = 'user') as p from conversations group by conv_id) where length(p) > 0
  union all select 'documents', 1, doc_id, text from documents union all select 'benchmark', 2, item_id, text from benchmark
), t as (select *, row_number() over (partition by source order by pos) as turn from u),
s as (select *, {_STRIP.format("text")} as prompt from t),
f as (select *, row_number() over (partition by {_NORM.format("prompt")} order by turn, ordinal) as rn from s where length(prompt) between 1 and 1500)
select sha256(prompt) as query_id, prompt, source, length(prompt) // 4 as token_estimate, turn, ordinal from f where rn = 1 order by turn, ordinal limit {LIMIT}""")


@query("seed_prompts", _SEED)
def seed_prompts(spark, sf_dir):
    registry = {
        "conversations": lambda: seed.first_user_turn(table(spark, sf_dir, "conversations")).select(F.col("conv_id").alias("pos"), F.col("prompt").alias("text"), F.lit(None).cast("string").alias("domain")),
        "documents": lambda: table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "text", F.col("lang").alias("domain")),
        "benchmark": lambda: table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), "text", F.lit(None).cast("string").alias("domain")),
    }
    every = seed.interleave(seed.sources_of(registry, ["conversations", "documents", "benchmark"]))
    return seed.seed_prompts(every, LIMIT).select("query_id", "prompt", "source", "token_estimate", F.col("turn").cast("long").alias("turn"), "ordinal")


@query("seed_prompts_pinned", _SEED)
def seed_prompts_pinned(spark, sf_dir):
    """The same prompts, with documents and benchmark read from a source at a pinned revision."""
    spark.dataSource.register(prompts.PinnedPrompts)

    def pinned(name, **columns):
        path = f"{sf_dir}/{name}.parquet"
        rows = spark.read.format("pinned_prompts").options(path=path, revision=prompts.revision(path), **columns).load()
        return rows.select(F.col("key").alias("pos"), "text", "domain")

    registry = {
        "conversations": lambda: seed.first_user_turn(table(spark, sf_dir, "conversations")).select(F.col("conv_id").alias("pos"), F.col("prompt").alias("text"), F.lit(None).cast("string").alias("domain")),
        "documents": lambda: pinned("documents", key="doc_id", domain="lang"),
        "benchmark": lambda: pinned("benchmark", key="item_id"),
    }
    every = seed.interleave(seed.sources_of(registry, ["conversations", "documents", "benchmark"]))
    return seed.seed_prompts(every, LIMIT).select("query_id", "prompt", "source", "token_estimate", F.col("turn").cast("long").alias("turn"), "ordinal")


@query("first_user_turn", "select conv_id, arg_min(text, turn) filter (role = 'user') as prompt from conversations group by conv_id having length(arg_min(text, turn) filter (role = 'user')) > 0")
def first_user_turn(spark, sf_dir):
    return seed.first_user_turn(table(spark, sf_dir, "conversations"))


@query("dedup_normalized", f"select doc_id from (select doc_id, row_number() over (partition by {_NORM.format('text')} order by doc_id) as rn from documents) where rn = 1")
def dedup_normalized(spark, sf_dir):
    return seed.dedup_normalized(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id")


@query("query_ids", "select doc_id, sha256(text) as query_id from documents")
def query_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.query_id(F.col("text")).alias("query_id"))


@query("cache_keys", oracle("select query_id, tier_rank, sha256(prompt || chr(0) || model) as cache_key from v_runs"))
def cache_keys(spark, sf_dir):
    return view(spark, sf_dir, "v_runs").select("query_id", "tier_rank", X.cache_key(F.col("prompt"), F.col("model")).alias("cache_key"))


@query("hash_unit", "select doc_id, ('0x' || substr(sha256('13:query:' || doc_id), 1, 16))::ubigint::double / 18446744073709551616::double as u from documents")
def hash_unit(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.hash_unit(F.lit(13), F.lit("query"), F.col("doc_id")).alias("u"))


@query("source_counts", "select source, count(*) as n from documents group by source")
def source_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))


@query("split_scan", oracle("select query_id, y from v_logits where split = 'calibration'"))
def split_scan(spark, sf_dir):
    return view(spark, sf_dir, "v_logits").where(F.col("split") == "calibration").select("query_id", "y")


@query("token_estimates", "select doc_id, length(text) // 4 as seed_tokens, length(text) // 4 + 8 as cost_tokens, regexp_replace(text, '^(([^ ]* ){0,127}[^ ]*).*$', '\\1', 's') as head from documents")
def token_estimates(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.seed_tokens(text).alias("seed_tokens"), X.cost_tokens(text).alias("cost_tokens"), X.truncate_words(text).alias("head"))


@query("choice_prompts", "select item_id, text || chr(10) || 'A. ' || item_id || chr(10) || 'B. x' || chr(10) || 'C. y' as prompt from benchmark")
def choice_prompts(spark, sf_dir):
    choices = F.array(F.col("item_id").cast("string"), F.lit("x"), F.lit("y"))
    return table(spark, sf_dir, "benchmark").select("item_id", X.choice_prompt(F.col("text"), choices).alias("prompt"))
