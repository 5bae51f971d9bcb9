"""Queries on labels, splits and the labelled dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierwise.operators import labels as L
from tierwise.operators import shares
from tierwise.registry import query
from tierwise.sources import io
from tierwise.sources.views import oracle, table, view
from tierwise.tiers import tier_name, tiers

SEED = 13


def unit_sql(*parts: str) -> str:
    return f"(('0x' || substr(sha256({' || \':\' || '.join(parts)}), 1, 16))::ubigint::double / 18446744073709551616::double)"


_QUERY = unit_sql(f"'{SEED}'", "'query'", "query_id")
_LABELS = """lab as (
  select query_id, coalesce(min(tier_rank) filter (verdict in ('equivalent', 'acceptable')), 2) as label_rank, max((tier_rank = 0)::int) as j0, max((tier_rank = 1)::int) as j1,
         array_to_string(list_sort(list(distinct tier_rank)), ',') as judged from v_verdicts group by query_id
), rea as (
  select q.query_id, q.source, coalesce(label_rank, 2) as label_rank, coalesce(judged, '') as judged, f.query_id is not null as answered,
         coalesce(label_rank, 2) = 0 or (coalesce(j0, 0) = 1 and (coalesce(label_rank, 2) = 1 or coalesce(j1, 0) = 1)) as det
  from (select distinct query_id, source from v_runs) q left join (select query_id from v_runs where tier_rank = 2 and error is null) f on f.query_id = q.query_id left join lab on lab.query_id = q.query_id
), exa as (
  select r.query_id, r.source, r.label_rank, t.tier, r.judged from rea r join v_tiers t on t.tier_rank = r.label_rank where answered and det
), pos as (
  select *, (row_number() over (partition by tier, source order by """ + _QUERY + """, query_id) - 1 + """ + unit_sql(f"'{SEED}'", "'stratum'", "tier", "source") + """) / count(*) over (partition by tier, source) as p from exa
), v_examples as (select *, case when p < 0.7e0 then 'train' when p < 0.85e0 then 'calibration' else 'test' end as split from pos)"""


def with_examples(sql: str) -> str:
    return oracle(f"with {_LABELS} {sql}")


def examples(spark, sf_dir):
    return L.build_examples(view(spark, sf_dir, "v_runs"), L.check_verdicts(view(spark, sf_dir, "v_verdicts")), view(spark, sf_dir, "v_cache"), SEED)


@query("min_sufficient_tier", with_examples("select query_id, label_rank, judged from lab"))
def min_sufficient_tier(spark, sf_dir):
    found = L.minimum_sufficient(view(spark, sf_dir, "v_verdicts"))
    return found.select("query_id", "label_rank", F.array_join(F.transform("judged", lambda r: r.cast("string")), ",").alias("judged"))


@query("judged_tiers", with_examples("select query_id, case judged when '0' then 'local_small' when '1' then 'mid_tier' else 'local_small,mid_tier' end as judged_tiers from lab"))
def judged_tiers(spark, sf_dir):
    return L.minimum_sufficient(view(spark, sf_dir, "v_verdicts")).select("query_id", F.array_join(F.transform("judged", tier_name), ",").alias("judged_tiers"))


@query("determined", with_examples("select query_id, det as determined from rea where answered"))
def determined(spark, sf_dir):
    found = L.reasons(view(spark, sf_dir, "v_runs"), view(spark, sf_dir, "v_verdicts"))
    return found.where("reason <> 'no frontier'").select("query_id", L.determined(F.col("label_rank"), F.col("judged")).alias("determined"))


@query("verdict_violations", oracle("""with bad as (
  select query_id, candidate_tier, reference_tier from v_verdicts union all select query_id, candidate_tier, reference_tier from v_verdicts where query_id < 20
  union all select query_id, 'frontier', 'frontier' from v_verdicts where query_id between 30 and 35 union all select query_id, candidate_tier, 'mid_tier' from v_verdicts where query_id between 40 and 45)
select distinct query_id, problem from (
  select query_id, case when reference_tier <> 'frontier' then 'reference is not the frontier' when candidate_tier = 'frontier' then 'candidate is the frontier' end as problem from bad
  union all select query_id, 'tier judged twice' from bad group by query_id, candidate_tier having count(*) > 1) where problem is not null"""))
def verdict_violations(spark, sf_dir):
    rows = view(spark, sf_dir, "v_verdicts").select("query_id", "candidate_tier", "reference_tier")
    bad = rows.unionByName(rows.where("query_id < 20"))
    bad = bad.unionByName(rows.where("query_id between 30 and 35").withColumn("candidate_tier", F.lit("frontier")).withColumn("reference_tier", F.lit("frontier")))
    return L.violations(bad.unionByName(rows.where("query_id between 40 and 45").withColumn("reference_tier", F.lit("mid_tier"))))


_PHRASES = ["", " I cannot browse the internet.", " I'm unable to run code.", " I don't have real-time weather data.", " As of my knowledge cutoff it holds.", " <tool_call>x"]


@query("needs_flags", "select doc_id, doc_id % 6 in (2, 5) as needs_tools, doc_id % 6 in (1, 3, 4) as needs_rag from documents")
def needs_flags(spark, sf_dir):
    text = F.concat(F.col("text"), F.element_at(F.array(*map(F.lit, _PHRASES)), (F.col("doc_id") % 6 + 1).cast("int")))
    tools, rag = L.needs(text)
    return table(spark, sf_dir, "documents").select("doc_id", tools.alias("needs_tools"), rag.alias("needs_rag"))


@query("split_assign", with_examples("select query_id, tier, source, split from v_examples"))
def split_assign(spark, sf_dir):
    return examples(spark, sf_dir).select("query_id", "tier", "source", "split")


@query("split_counts", with_examples("select split, count(*) as n from v_examples group by split"))
def split_counts(spark, sf_dir):
    return examples(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"))


@query("holdout_split", with_examples(f"""select query_id, case when (row_number() over (partition by tier order by {_QUERY}, query_id) - 1 + {unit_sql(f"'{SEED}'", "'stratum'", 'tier')}) / count(*) over (partition by tier) < 0.9e0 then 'fit' else 'holdout' end as split
  from v_examples where split = 'train'"""))
def holdout_split(spark, sf_dir):
    train = L.only_split(examples(spark, sf_dir).where("split = 'train'"), "train").drop("split")
    return L.holdout_split(train, ["tier"], 0.1, seed=SEED).select("query_id", "split")


@query("split_singletons", f"select doc_id, case when {unit_sql(f"'{SEED}'", "'stratum'", 'doc_id')} < 0.7e0 then 'train' when {unit_sql(f"'{SEED}'", "'stratum'", 'doc_id')} < 0.85e0 then 'calibration' else 'test' end as split from documents")
def split_singletons(spark, sf_dir):
    return L.split_rows(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], "doc_id", SEED).select("doc_id", "split")


BUILT = """select e.query_id, e.source, e.split, e.tier, e.query_id % 9 = 0 as needs_tools, e.query_id % 9 in (1, 2) as needs_rag, case e.judged when '' then '' when '0' then 'local_small' when '1' then 'mid_tier' else 'local_small,mid_tier' end as judged_tiers,
  round(coalesce(cf.cost_usd, rf.cost_usd), 9) as frontier_cost_usd, round(coalesce(cl.cost_usd, rl.cost_usd), 9) as label_cost_usd
from v_examples e left join v_runs rf on rf.query_id = e.query_id and rf.tier_rank = 2 and rf.error is null left join v_cache cf on cf.query_id = rf.query_id and cf.tier_rank = 2
left join v_runs rl on rl.query_id = e.query_id and rl.tier_rank = e.label_rank and rl.error is null left join v_cache cl on cl.query_id = rl.query_id and cl.tier_rank = rl.tier_rank"""


@query("build_examples", with_examples(BUILT))
def build_examples(spark, sf_dir):
    found = examples(spark, sf_dir)
    return found.select("query_id", "source", "split", "tier", "needs_tools", "needs_rag", F.array_join("judged_tiers", ",").alias("judged_tiers"), F.round("frontier_cost_usd", 9).alias("frontier_cost_usd"), F.round("label_cost_usd", 9).alias("label_cost_usd"))


@query("dataset_split", with_examples(BUILT + " where e.split = 'calibration'"))
def dataset_split(spark, sf_dir):
    # the dataset as written for its readers: a folder for each split, of which one is read
    place = io.shared_place(spark)
    io.write_dataset(build_examples(spark, sf_dir), place)
    return io.read_split(spark, place, "calibration")


@query("skip_reasons", with_examples("select case when not answered then 'no frontier' when not det then 'undetermined' else 'labelled' end as reason, count(*) as n from rea group by 1"))
def skip_reasons(spark, sf_dir):
    return L.reasons(view(spark, sf_dir, "v_runs"), view(spark, sf_dir, "v_verdicts")).groupBy("reason").agg(F.count("*").alias("n"))


@query("true_cost", oracle("select r.query_id, r.tier_rank, round(coalesce(c.cost_usd, r.cost_usd), 9) as true_cost from v_runs r left join v_answers c on c.cache_key = sha256(coalesce(r.prompt, '') || chr(0) || r.model)"))
def true_cost(spark, sf_dir):
    return L.true_cost(view(spark, sf_dir, "v_runs"), view(spark, sf_dir, "v_answers")).withColumn("true_cost", F.round("true_cost", 9))


@query("upsert_runs", oracle("""with old as (select query_id, tier_rank, completion_tokens, query_id as seq from v_runs where query_id % 3 <> 0),
new as (select query_id, tier_rank, completion_tokens + 1000 as completion_tokens, query_id as seq from v_runs where query_id % 2 = 0 union all select query_id, tier_rank, completion_tokens + 2000, query_id + 1 from v_runs where query_id % 4 = 0)
select query_id, tier_rank, completion_tokens from (select *, row_number() over (partition by query_id, tier_rank order by gen desc, seq desc) as rn from (select *, 0 as gen from old union all select *, 1 from new)) where rn = 1"""))
def upsert_runs(spark, sf_dir):
    runs = view(spark, sf_dir, "v_runs").select("query_id", "tier_rank", "completion_tokens", F.col("query_id").alias("seq"))
    new = runs.where("query_id % 2 = 0").withColumn("completion_tokens", F.col("completion_tokens") + 1000)
    again = runs.where("query_id % 4 = 0").select("query_id", "tier_rank", (F.col("completion_tokens") + 2000).alias("completion_tokens"), (F.col("seq") + 1).alias("seq"))
    return L.upsert(runs.where("query_id % 3 <> 0"), new.unionByName(again), ["query_id", "tier_rank"]).drop("seq")


@query("runs_cross_tiers", oracle("select d.doc_id as query_id, t.tier from documents d cross join v_tiers t"))
def runs_cross_tiers(spark, sf_dir):
    # three tiers, a constant: the one side that is broadcast without a check
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id")).crossJoin(F.broadcast(tiers(spark))).select("query_id", "tier")


@query("successful_runs", oracle("select tier, count(*) as runs, sum((error is null)::int)::bigint as ok, sum((error is not null)::int)::bigint as failed, sum((error is not null and query_id % 11 < 8)::int)::bigint as retryable from v_runs group by tier"))
def successful_runs(spark, sf_dir):
    from tierwise.operators.costs import run_counts

    return run_counts(view(spark, sf_dir, "v_runs"))


@query("label_distribution", with_examples("select t.tier, count(e.query_id) as n, round(100.0 * count(e.query_id) / sum(count(e.query_id)) over (), 6) as pct from v_tiers t left join v_examples e on e.tier = t.tier group by t.tier"))
def label_distribution(spark, sf_dir):
    return shares.distribution(examples(spark, sf_dir), "tier", tiers(spark).select("tier"))


@query("label_by_source", with_examples("select coalesce(source, 'all') as source, count(*) filter (tier = 'local_small') as local_small, count(*) filter (tier = 'mid_tier') as mid_tier, count(*) filter (tier = 'frontier') as frontier, count(*) as total from v_examples group by rollup (source)"))
def label_by_source(spark, sf_dir):
    return shares.crosstab(examples(spark, sf_dir), "source")


@query("label_by_split", with_examples("select coalesce(split, 'all') as split, count(*) filter (tier = 'local_small') as local_small, count(*) filter (tier = 'mid_tier') as mid_tier, count(*) filter (tier = 'frontier') as frontier, count(*) as total from v_examples group by rollup (split)"))
def label_by_split(spark, sf_dir):
    return shares.crosstab(examples(spark, sf_dir), "split")


@query("flag_counts", with_examples("select count(*) as n, sum((query_id % 9 in (1, 2))::int)::bigint as needs_rag, round(100.0 * sum((query_id % 9 in (1, 2))::int) / count(*), 6) as pct from v_examples"))
def flag_counts(spark, sf_dir):
    return shares.flags(examples(spark, sf_dir), F.col("needs_rag"), "needs_rag")


def digest_sql(rows: str, levels: int = 6) -> str:
    """CTEs dn (grp, n) and dg (grp, digest) of rows (grp, id): flat digests of parts by the first digits of hashed ids, folded level by level."""
    steps = [f"di as (select grp, id::varchar as id from {rows} where id is not null)", "dn as (select grp, count(*) as n, greatest(0, ceil(ln(count(*) / 4096::double) / ln(16::double)))::integer as digits from di group by grp)"]
    steps.append(f"d{levels} as (select grp, part, sha256(string_agg(id, chr(10) order by id)) as digest from (select di.grp, id, substr(sha256(id), 1, digits) as part from di join dn on dn.grp = di.grp) group by grp, part)")
    for at in range(levels, 0, -1):
        steps.append(f"d{at - 1} as (select grp, up as part, case when max(length(part)) = {at} then sha256(string_agg(digest, chr(10) order by part)) else max(digest) end as digest from (select *, case when length(part) = {at} then substr(part, 1, {at - 1}) else part end as up from d{at}) group by grp, up)")
    return ", ".join(steps) + ", dg as (select grp, digest from d0)"


@query("split_index", with_examples(f"select * from (with {digest_sql('(select split as grp, query_id as id from v_examples)')} select s.split, coalesce(n, 0) as n, coalesce(digest, sha256('')) as ids_sha256 from (values ('train'), ('calibration'), ('test')) s(split) left join dg on dg.grp = s.split left join dn on dn.grp = s.split)"))
def split_index(spark, sf_dir):
    return shares.split_index(examples(spark, sf_dir))


@query("rows_fingerprint", f"""with {digest_sql("(select case when doc_id % 10 < 9 then 'fit' else 'holdout' end as grp, doc_id as id from documents)")}
select coalesce(max(n) filter (dn.grp = 'fit'), 0) as n_fit, coalesce(max(n) filter (dn.grp = 'holdout'), 0) as n_holdout, sha256('[["' || coalesce(max(digest) filter (dg.grp = 'fit'), sha256('')) || '"], ["' || coalesce(max(digest) filter (dg.grp = 'holdout'), sha256('')) || '"]]') as rows_sha256 from dg join dn on dn.grp = dg.grp""")
def rows_fingerprint(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 10 < 9, "fit").otherwise("holdout").alias("split"), F.col("doc_id").alias("query_id"))
    return shares.rows_fingerprint(rows)


@query("pair_violations", oracle("""with r as (select query_id, tier_rank, tier, error from v_runs where query_id % 4 <> 1), ref as (select * from r where tier_rank = case when query_id % 7 = 0 then 1 else 2 end), cand as (select * from v_runs where tier_rank < 2 or query_id % 11 = 0)
select query_id, tier, case when tier_rank <> 2 then 'reference is not the frontier' else 'reference failed' end as problem from ref where tier_rank <> 2 or error is not null
union all select query_id, tier, case when tier_rank >= 2 then 'candidate is not cheaper' else 'candidate failed' end from cand where tier_rank >= 2 or error is not null
union all select query_id, tier, 'no such query' from cand where query_id % 5 = 0 union all select query_id, tier, 'no reference of this query' from cand where query_id not in (select query_id from ref)"""))
def pair_violations(spark, sf_dir):
    runs = view(spark, sf_dir, "v_runs").select("query_id", "tier_rank", "error")
    references = runs.where("query_id % 4 <> 1 and tier_rank = case when query_id % 7 = 0 then 1 else 2 end")
    records = runs.where("query_id % 5 <> 0").select("query_id").distinct()
    return L.pair_violations(records, references, runs.where("tier_rank < 2 or query_id % 11 = 0"))
