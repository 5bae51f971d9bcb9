"""Queries on judge replies, publishing, histories and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierwise.operators import history as H
from tierwise.operators import judging as J
from tierwise.operators import publishing as P
from tierwise.plans.eval_queries import rounded
from tierwise.plans.label_queries import BUILT, examples, with_examples
from tierwise.registry import query
from tierwise.sources.io import shared_place
from tierwise.sources.views import oracle, table, view
from tierwise.streaming import calls as SC
from tierwise.streaming import ledger as S


@query("parse_judge_replies", oracle(r"""with j as (select doc_id, regexp_extract(reply, '(?s)\{.*\}') as b from v_replies),
k as (select doc_id, case when json_valid(b) and json_type(b, '$.reason') = 'VARCHAR' and json_type(b, '$.verdict') = 'VARCHAR' then lower(trim(json_extract_string(b, '$.verdict'))) end as v, case when json_valid(b) then json_extract_string(b, '$.reason') end as r from j)
select doc_id, case when v in ('equivalent', 'acceptable', 'worse') then v end as verdict, case when v in ('equivalent', 'acceptable', 'worse') then r end as reason from k"""))
def parse_judge_replies(spark, sf_dir):
    return J.parse_replies(view(spark, sf_dir, "v_replies")).select("doc_id", "verdict", "reason")


_T0, _T1, _T2, _T3 = (x.replace("'", "''") for x in J.TEMPLATE.split("%s"))


@query("judge_prompts", f"select doc_id, sha256('{_T0}' || source || '{_T1}' || text || '{_T2}' || lang || '{_T3}') as prompt_sha256 from documents")
def judge_prompts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(J.judge_prompt(F.col("source"), F.col("text"), F.col("lang")), 256).alias("prompt_sha256"))


_R1, _R2, _R3 = (x.replace("'", "''") for x in J.RETRY.split("%s")[1:])


@query("retry_prompts", oracle(rf"""with j as (select doc_id, reply, regexp_extract(reply, '(?s)\{{.*\}}') as b from v_replies),
k as (select doc_id, reply, json_valid(b) as object, case when json_valid(b) and json_type(b, '$.reason') = 'VARCHAR' and json_type(b, '$.verdict') = 'VARCHAR' then lower(trim(json_extract_string(b, '$.verdict'))) end as v from j)
select k.doc_id, sha256('{_T0}' || source || '{_T1}' || text || '{_T2}' || lang || '{_T3}{_R1}' || substr(reply, 1, {J.CLIP}) || '{_R2}' || case when object then '{J.PROBLEMS[1]}' else '{J.PROBLEMS[0]}' end || '{_R3}') as retry_sha256
from k join documents d on d.doc_id = k.doc_id where v is null or v not in ('equivalent', 'acceptable', 'worse')"""))
def retry_prompts(spark, sf_dir):
    asked = table(spark, sf_dir, "documents").select("doc_id", J.judge_prompt(F.col("source"), F.col("text"), F.col("lang")).alias("prompt"))
    return J.retries(view(spark, sf_dir, "v_replies").join(asked, "doc_id")).select("doc_id", F.sha2("retry", 256).alias("retry_sha256"))


@query("judge_independence", oracle("select distinct split_part(model, '/', 2) as name from v_runs where tier = 'frontier'"))
def judge_independence(spark, sf_dir):
    # one more judge, which is the frontier's model at another provider
    judges = view(spark, sf_dir, "v_verdicts").select("judge_model").unionByName(spark.createDataFrame([("p/frontier",)], "judge_model string"))
    return J.judge_independence(judges, view(spark, sf_dir, "v_runs"))


@query("tier_models", with_examples("select tier, array_to_string(list_sort(list(distinct model)), ',') as models from v_runs where error is null and query_id in (select query_id from v_examples where split = 'test') group by tier"))
def tier_models(spark, sf_dir):
    found = P.tier_models(view(spark, sf_dir, "v_runs"), examples(spark, sf_dir).where("split = 'test'"))
    return found.select("tier", F.array_join("models", ",").alias("models"))


def _terms(spark):
    # sources with a number divisible by 5 have no terms, so they are withheld
    return spark.createDataFrame([(f"src{i}", i % 2 == 0) for i in range(20) if i % 5], "source string, redistribute_text boolean")


_OK = "(source in ({}))".format(", ".join(f"'src{i}'" for i in range(0, 20, 2) if i % 5))
_PUBLIC = f"pub as (select b.* replace (sha256(d.text) as query_id), case when d.{_OK[1:-1]} then d.text end as prompt, case when d.{_OK[1:-1]} and d.doc_id % 4 = 0 then d.lang end as conversation_summary, sha256(d.text) as text_sha256, d.{_OK[1:-1]} as text_included from ({BUILT}) b join documents d on d.doc_id = b.query_id)"


def _public(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("prompt"), F.expr("case when doc_id % 4 = 0 then lang end").alias("conversation_summary"))
    rows = examples(spark, sf_dir).join(texts, "query_id").withColumn("query_id", F.sha2("prompt", 256))
    return P.public_frame(P.check_hashes(rows), _terms(spark))


def _public_sql(sql: str) -> str:
    return with_examples(f", {_PUBLIC} {sql}").replace(" ,", ",")


@query("public_frame", _public_sql("select * from pub"))
def public_frame(spark, sf_dir):
    usd = {c: F.round(c, 9) for c in ("frontier_cost_usd", "label_cost_usd")}
    return _public(spark, sf_dir).withColumns({"judged_tiers": F.array_join("judged_tiers", ","), **usd})


@query("inclusion", _public_sql("select coalesce(source, 'all') as source, count(*) as rows, sum(text_included::int)::bigint as text_rows, sum((not text_included)::int)::bigint as withheld_rows from pub group by rollup (source)"))
def inclusion(spark, sf_dir):
    return P.inclusion(_public(spark, sf_dir))


_TEXTS = "tx as (select distinct source, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as text from documents where doc_id % 7 <> 0), res as (select p.query_id, coalesce(p.prompt, t.text) as prompt, p.source, text_included from pub p left join tx t on t.source = p.source and sha256(t.text) = p.text_sha256)"


def _texts(spark, sf_dir):
    return P.candidate_texts(table(spark, sf_dir, "documents").where("doc_id % 7 <> 0").withColumn("pos", F.col("doc_id")))


@query("restore_text", _public_sql(f", {_TEXTS} select query_id, prompt, source from res where prompt is not null"))
def restore_text(spark, sf_dir):
    rows, _ = P.restore_dataset(_public(spark, sf_dir), _texts(spark, sf_dir))
    return rows.select("query_id", "prompt", "source")


@query("restore_report", _public_sql(f", {_TEXTS} select count(prompt) as rows, sum((not text_included)::int)::bigint as withheld, sum((not text_included and prompt is not null)::int)::bigint as recovered, sum((prompt is null)::int)::bigint as dropped from res"))
def restore_report(spark, sf_dir):
    return P.restore_dataset(_public(spark, sf_dir), _texts(spark, sf_dir))[1]


@query("early_stopping", oracle("""with a as (select step, loss, min(loss) over (order by step rows between unbounded preceding and 1 preceding) as b from v_history), c as (select *, b is null or loss < b as better, sum((b is null or loss < b)::int) over (order by step) as run from a),
d as (select *, row_number() over (partition by run order by step) - 1 as bad from c), e as (select min(step) as stop_step from d where bad >= 3)
select max(step) as best_step, round(arg_max(loss, step), 8) as best_loss, max(stop_step) as stop_step from d cross join e where better and (stop_step is null or step <= stop_step)"""))
def early_stopping(spark, sf_dir):
    return rounded(H.early_stopping(view(spark, sf_dir, "v_history"), 3), "best_loss")


@query("lr_schedule", oracle("select step, round(case when step - 1 < n // 10 then step / (n // 10)::double else greatest(0, (n - (step - 1)) / (n - n // 10)::double) end, 8) as factor from v_history cross join (select count(*) as n from v_history)"))
def lr_schedule(spark, sf_dir):
    rows = view(spark, sf_dir, "v_history")
    return rows.select("step", F.round(H.learning_rate(F.col("step") - 1, rows.count(), 0.1), 8).alias("factor"))


@query("progress_marks", oracle("select rn as done, step from (select step, row_number() over (order by step) as rn, count(*) over () as n from v_history) where rn % greatest(1, round_even(n * 0.05, 0)::bigint) = 0 or rn = n"))
def progress_marks(spark, sf_dir):
    rows = view(spark, sf_dir, "v_history")
    return H.progress_marks(rows, "step", rows.count()).select(F.col("done").cast("long").alias("done"), "step")


@query("holdout_loss", oracle("select step, round(sum(l), 8) as loss from (select step // 4 as step, step % 2 as q, sum(loss * (step % 3 + 1)) / sum(step % 3 + 1) as l from v_history group by 1, 2) group by step"))
def holdout_loss(spark, sf_dir):
    parts = view(spark, sf_dir, "v_history").select(F.floor(F.col("step") / 4).alias("step"), (F.col("step") % 2).alias("question"), "loss", (F.col("step") % 3 + 1).alias("n"))
    return rounded(H.holdout_loss(parts), "loss")


@query("micro_batch_loss", oracle("select (step - 1) // 2 as step, round(avg(loss), 8) as loss from v_history group by 1"))
def micro_batch_loss(spark, sf_dir):
    return rounded(H.micro_batches(view(spark, sf_dir, "v_history").select((F.col("step") - 1).alias("micro"), "loss"), 2), "loss")


def _events(spark, sf_dir):
    rows = S.file_stream(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema)
    return rows.withColumnsRenamed({"event_type": "tier", "value": "usd"})


@query("stream_ledger_totals", "select event_type as tier, round(sum(value), 6) as usd, count(*) as calls from events group by event_type")
def stream_ledger_totals(spark, sf_dir):
    return rounded(S.into_table(S.running_totals(_events(spark, sf_dir)), shared_place(spark)), "usd", digits=6)


@query("stream_dedup", "select distinct user_id, event_type as tier from events")
def stream_dedup(spark, sf_dir):
    place = shared_place(spark)
    return S.into_files(S.once(_events(spark, sf_dir), ["user_id", "tier"]).select("user_id", "tier"), f"{place}/out", f"{place}/state")


@query("stream_upsert", "select user_id, event_type as tier, max(event_id) as seq, arg_max(value, event_id) as usd from events group by user_id, event_type")
def stream_upsert(spark, sf_dir):
    place = shared_place(spark)
    rows = _events(spark, sf_dir).select("user_id", "tier", F.col("event_id").alias("seq"), "usd")
    return S.upsert_stream(rows, f"{place}/out", ["user_id", "tier"], f"{place}/state")


@query("stream_route", oracle("""with m as (select vec_id as query_id, embedding[1]::double * 8 as a, embedding[2]::double * 8 as b, embedding[3]::double * 8 as c from embeddings), p as (select query_id, case when a >= b and a >= c then 0 when b >= c then 1 else 2 end as predicted, 1 / (exp(a - greatest(a, b, c)) + exp(b - greatest(a, b, c)) + exp(c - greatest(a, b, c))) as confidence from m)
select query_id, predicted, round(confidence, 8) as confidence, confidence < 0.6e0 and predicted < 2 as escalated, case when confidence < 0.6e0 and predicted < 2 then predicted + 1 else predicted end as served from p"""))
def stream_route(spark, sf_dir):
    place = shared_place(spark)
    rows = S.file_stream(spark, f"{sf_dir}/embeddings.parquet*", table(spark, sf_dir, "embeddings").schema)
    logits = rows.select(F.col("vec_id").alias("query_id"), *((F.get("embedding", F.lit(i)).cast("double") * 8).alias(f"z{i}") for i in range(3)))
    return rounded(S.into_files(S.route(logits, 0.6), f"{place}/out", f"{place}/state"), "confidence")


@query("hourly_spend", "select date_trunc('hour', ts) as hour, event_type as tier, round(sum(value), 6) as usd from events group by 1, 2")
def hourly_spend(spark, sf_dir):
    place = shared_place(spark)
    out = S.hourly_files(_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), f"{place}/out", f"{place}/state")
    return rounded(out.withColumn("hour", F.col("hour").cast("timestamp_ntz")), "usd", digits=6)


@query("stream_duplicate_calls", "select event_type as tier, count(*) as calls, count(*) - count(distinct user_id) as cached from events group by event_type")
def stream_duplicate_calls(spark, sf_dir):
    place = shared_place(spark)
    key = F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), "tier"), 256)
    marked = SC.seen_before(_events(spark, sf_dir).select(key.alias("cache_key"), "tier", F.col("event_id").alias("call_id")))
    out = S.into_files(marked, f"{place}/out", f"{place}/state")
    return out.groupBy("tier").agg(F.count("*").alias("calls"), F.sum(F.col("cached").cast("long")).alias("cached"))


@query("stream_canary", "select event_type as tier, count(*) as admitted, round(sum(value), 6) as usd from events group by event_type")
def stream_canary(spark, sf_dir):
    place = shared_place(spark)

    def first(one):
        if not one.where("usd is null").isEmpty():
            raise RuntimeError("the first call has no cost")

    SC.gated(_events(spark, sf_dir).select("tier", "usd"), f"{place}/state", f"{place}/admitted", first, lambda batch, n: batch.write.mode("overwrite").parquet(f"{place}/out/batch={n}"))
    out = spark.read.schema("tier string, usd double").parquet(f"{place}/out")
    return rounded(out.groupBy("tier").agg(F.count("*").alias("admitted"), F.sum("usd").alias("usd")), "usd", digits=6)


@query("validation_history", oracle("select h.step, round(h.loss, 8) as loss, round(v.validation, 8) as validation from v_history h left join (select step, loss * 1.5e0 as validation from v_history where step % 4 = 0) v on v.step = h.step"))
def validation_history(spark, sf_dir):
    rows = view(spark, sf_dir, "v_history")
    return rounded(H.with_validation(rows, rows.where("step % 4 = 0").select("step", (F.col("loss") * 1.5).alias("validation"))), "loss", "validation")
