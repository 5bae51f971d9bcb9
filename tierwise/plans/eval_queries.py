"""Queries on predictions, routing and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierwise.operators import calibration as K
from tierwise.operators import costs as C
from tierwise.operators import latency as Y
from tierwise.operators import metrics as M
from tierwise.operators import routing as R
from tierwise.operators import training as T
from tierwise.plans.cost_queries import _RATES
from tierwise.plans.label_queries import unit_sql
from tierwise.registry import query
from tierwise.sources import io
from tierwise.sources.views import oracle, table, view
from tierwise.tiers import TIERS

TARGET = 0.9
GRID = [round(0.5 + 0.05 * i, 2) for i in range(91)]
_P = """pr as (select query_id, y, split, greatest(z0, z1, z2) as m, z0, z1, z2 from v_logits),
pe as (select query_id, y, split, z0, z1, z2, exp(z0 - m) as a, exp(z1 - m) as b, exp(z2 - m) as c from pr),
p as (select query_id, y, split, z0, z1, z2, a / (a + b + c) as p0, b / (a + b + c) as p1, c / (a + b + c) as p2, case when a >= b and a >= c then 0 when b >= c then 1 else 2 end as predicted, greatest(a, b, c) / (a + b + c) as confidence from pe)"""


def with_p(sql: str, more: str = "") -> str:
    return oracle(f"with {_P}{more} {sql}")


def predicted(spark, sf_dir, split: str | None = "test"):
    logits = view(spark, sf_dir, "v_logits")
    return M.predictions(logits if split is None else logits.where(F.col("split") == split))


def rounded(df, *names, digits=8):
    return df.select(*(F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns))


@query("softmax_probs", with_p("select query_id, round(p0, 8) as p0, round(p1, 8) as p1, round(p2, 8) as p2 from p"))
def softmax_probs(spark, sf_dir):
    p = predicted(spark, sf_dir, None)
    return p.select("query_id", *(F.round(F.get("probs", F.lit(i)), 8).alias(f"p{i}") for i in range(3)))


@query("predictions", with_p("select query_id, predicted, round(confidence, 8) as confidence from p"))
def predictions(spark, sf_dir):
    return predicted(spark, sf_dir, None).select("query_id", "predicted", F.round("confidence", 8).alias("confidence"))


@query("accuracy", with_p("select round(avg((y = predicted)::int), 8) as accuracy from p where split = 'test'"))
def accuracy(spark, sf_dir):
    return rounded(M.accuracy(M.check(predicted(spark, sf_dir))), "accuracy")


@query("macro_f1", with_p("select round(avg(coalesce(2.0e0 * tp / nullif(2 * tp + fp + fn, 0), 0)), 8) as macro_f1 from (select k, sum((y = k and predicted = k)::int) as tp, sum((y <> k and predicted = k)::int) as fp, sum((y = k and predicted <> k)::int) as fn from p cross join (values (0), (1), (2), (3)) c(k) where split = 'test' group by k)"))
def macro_f1(spark, sf_dir):
    return rounded(M.macro_f1(predicted(spark, sf_dir), [0, 1, 2, 3]), "macro_f1")


@query("brier", with_p("select round(avg((p0 - (y = 0)::int) ** 2 + (p1 - (y = 1)::int) ** 2 + (p2 - (y = 2)::int) ** 2), 8) as brier from p where split = 'test'"))
def brier(spark, sf_dir):
    return rounded(M.brier(predicted(spark, sf_dir)), "brier")


_BINS = ", bi as (select i, i * (1.0e0 / 15) as lo, case when i = 14 then 1.0e0 else (i + 1) * (1.0e0 / 15) end as hi from range(15) r(i)), bj as (select i, lo, hi, confidence, (y = predicted)::int as hit from bi left join (select * from p where split = 'test') q on (confidence > lo or (i = 0 and confidence = lo)) and confidence <= hi)"


@query("ece", with_p("select round(sum(n * abs(c - a)) / sum(n), 8) as ece from (select count(*) as n, avg(confidence) as c, avg(hit) as a from bj where confidence is not null group by i)", _BINS))
def ece(spark, sf_dir):
    return rounded(M.ece(predicted(spark, sf_dir)), "ece")


@query("reliability_bins", with_p("select i::int as bin, round(lo, 8) as lo, round(hi, 8) as hi, count(confidence) as n, round(avg(confidence), 8) as confidence, round(avg(hit) filter (confidence is not null), 8) as accuracy from bj group by i, lo, hi", _BINS))
def reliability_bins(spark, sf_dir):
    return rounded(M.reliability(predicted(spark, sf_dir)), "lo", "hi", "confidence", "accuracy")


@query("confusion", with_p("select t.tier as true_tier, u.tier as predicted_tier, count(query_id) as n, round(count(query_id) / nullif(sum(count(query_id)) over (partition by t.tier), 0), 8) as share from v_tiers t cross join v_tiers u left join p on y = t.tier_rank and predicted = u.tier_rank and split = 'test' group by t.tier, u.tier"))
def confusion(spark, sf_dir):
    return rounded(M.confusion(predicted(spark, sf_dir)), "share")


@query("tier_support", with_p("select tier, count(query_id) as n from v_tiers t left join p on y = t.tier_rank and split = 'test' group by tier"))
def tier_support(spark, sf_dir):
    return M.support(predicted(spark, sf_dir))


_RC = ", rc as (select round(confidence, 8) as conf, confidence, (y <> predicted)::int as w from p where split = 'test'), rw as (select conf, confidence, sum(w) over o / count(*) over o as risk, count(*) over o / count(*) over () as coverage from rc window o as (order by confidence desc range unbounded preceding))"


@query("risk_coverage_curve", with_p("select distinct round(confidence, 8) as confidence, round(coverage, 8) as coverage, round(risk, 8) as risk from rw", _RC))
def risk_coverage_curve(spark, sf_dir):
    return rounded(M.risk_coverage(predicted(spark, sf_dir)).drop("n"), "confidence", "coverage", "risk")


@query("risk_coverage_auc", with_p("select round(avg(risk), 8) as auc from rw", _RC))
def risk_coverage_auc(spark, sf_dir):
    return rounded(M.risk_coverage_auc(predicted(spark, sf_dir)), "auc")


@query("latency_percentiles", "select round(quantile_cont(value, 0.5), 8) as p50, round(quantile_cont(value, 0.95), 8) as p95, round(quantile_cont(value, 0.99), 8) as p99 from events")
def latency_percentiles(spark, sf_dir):
    return rounded(M.percentiles(table(spark, sf_dir, "events"), "value"), "p50", "p95", "p99")


def _by_length():
    names = list(TIERS)
    return lambda text: names[len(text) % len(names)]


@query("timed_routes", "select doc_id as query_id, ['local_small', 'mid_tier', 'frontier'][length(text) % 3 + 1] as tier, true as timed from documents where length(text) > 0")
def timed_routes(spark, sf_dir):
    found = Y.timed_routes(table(spark, sf_dir, "documents"), _by_length, key="doc_id", prompt="text")
    # how long it took differs from run to run
    return found.select(F.col("doc_id").alias("query_id"), "tier", (F.col("latency_ms") >= 0).alias("timed"))


def _queries(spark, sf_dir, split):
    rates = C.token_rates(C.answered_only(view(spark, sf_dir, "v_ledger"), view(spark, sf_dir, "v_runs")))
    return R.eval_queries(predicted(spark, sf_dir, split), view(spark, sf_dir, "v_runs"), view(spark, sf_dir, "v_verdicts"), rates)


_EVAL = (
    ", rates as ("
    + _RATES.format(rows="v_ledger where tier <> 'judge'").replace("round(greatest(", "(greatest(").replace(", 0), 6)", ", 0) / 1e6)")
    + """), tr as (select r.query_id, r.tier_rank, r.prompt_tokens * prompt_rate + r.completion_tokens * completion_rate as usd, case when r.tier_rank = 2 then true else v.verdict in ('equivalent', 'acceptable') end as ok
  from v_runs r join rates on rates.tier = r.tier left join v_verdicts v on v.query_id = r.query_id and v.tier_rank = r.tier_rank where r.error is null),
full3 as (select query_id from tr group by query_id having count(*) = 3),
eq as (select p.query_id, split, predicted, confidence from p join full3 using (query_id)),
taus as (select split, confidence as tau from eq union select split, 0.0e0 from eq union select split, 1.0000000000000002e0 from eq),
sv as (select e.split, tau, e.query_id, predicted, case when confidence < tau and predicted < 2 then predicted + 1 else predicted end as served from eq e join taus t on t.split = e.split),
sw as (select split, tau, count(*) as n, sum((served > predicted)::int)::bigint as escalated, sum(a.usd) as total_usd, sum(f.usd) as frontier_usd, sum(a.usd) / sum(f.usd) as cost_retained, sum(coalesce(a.ok, false)::int) / count(*) as quality_retained, sum((a.ok is null)::int)::bigint as unknown_quality
  from sv join tr a on a.query_id = sv.query_id and a.tier_rank = sv.served join tr f on f.query_id = sv.query_id and f.tier_rank = 2 group by split, tau),
best as (select tau, cost_retained, quality_retained, quality_retained >= 0.9e0 as target_met from (select *, row_number() over (order by case when quality_retained >= 0.9e0 then 0 else 1 end, case when quality_retained >= 0.9e0 then 0 else -quality_retained end, round(cost_retained, 10), tau) as rn from sw where split = 'calibration') where rn = 1)"""
)


@query("candidate_taus", with_p("select round(tau, 8) as tau from taus where split = 'test'", _EVAL))
def candidate_taus(spark, sf_dir):
    return rounded(R.candidate_taus(_queries(spark, sf_dir, "test")), "tau")


@query("served_tiers", with_p("select query_id, case when confidence < 0.55e0 and predicted < 2 then predicted + 1 else predicted end as served, confidence < 0.55e0 and predicted < 2 as escalated from eq where split = 'test'", _EVAL))
def served_tiers(spark, sf_dir):
    return R.served(_queries(spark, sf_dir, "test"), 0.55).select("query_id", "served", "escalated")


def _sweep_rounded(df):
    df = df.withColumn("total_usd", F.col("total_usd") * 1e3).withColumn("frontier_usd", F.col("frontier_usd") * 1e3)
    return rounded(df, "tau", "total_usd", "frontier_usd", "cost_retained", "quality_retained", digits=6)


@query("routing_sweep", with_p("select round(tau, 6) as tau, n, escalated, round(total_usd * 1e3, 6) as total_usd, round(frontier_usd * 1e3, 6) as frontier_usd, round(cost_retained, 6) as cost_retained, round(quality_retained, 6) as quality_retained, unknown_quality from sw where split = 'test'", _EVAL))
def routing_sweep(spark, sf_dir):
    return _sweep_rounded(R.sweep(_queries(spark, sf_dir, "test")))


@query("select_tau", with_p("select round(tau, 6) as tau, round(cost_retained, 6) as cost_retained, round(quality_retained, 6) as quality_retained, target_met from best", _EVAL))
def select_tau(spark, sf_dir):
    best = R.select_tau(R.sweep(_queries(spark, sf_dir, "calibration")).withColumn("cost_retained", F.round("cost_retained", 10)), TARGET)
    return rounded(best.select("tau", "cost_retained", "quality_retained", "target_met"), "tau", "cost_retained", "quality_retained", digits=6)


@query("operating_point", with_p("select round(b.tau, 6) as tau, s.n, s.escalated, round(s.cost_retained, 6) as cost_retained, round(s.quality_retained, 6) as quality_retained, target_met from (select (select tau from best) as tau, (select target_met from best) as target_met) b join (select tau, count(*) as n, sum((served > predicted)::int)::bigint as escalated, sum(a.usd) / sum(f.usd) as cost_retained, sum(coalesce(a.ok, false)::int) / count(*) as quality_retained from (select best.tau, e.query_id, predicted, case when confidence < best.tau and predicted < 2 then predicted + 1 else predicted end as served from eq e cross join best where split = 'test') sv join tr a on a.query_id = sv.query_id and a.tier_rank = sv.served join tr f on f.query_id = sv.query_id and f.tier_rank = 2 group by tau) s on s.tau = b.tau", _EVAL))
def operating_point(spark, sf_dir):
    # tau comes from calibration rows alone, one row, and is joined to the test rows
    best = R.select_tau(R.sweep(_queries(spark, sf_dir, "calibration")).withColumn("cost_retained", F.round("cost_retained", 10)), TARGET).select("tau", "target_met")
    out = R.sweep(_queries(spark, sf_dir, "test"), best.select("tau")).join(F.broadcast(best), "tau")
    return rounded(out.select("tau", "n", "escalated", "cost_retained", "quality_retained", "target_met"), "tau", "cost_retained", "quality_retained", digits=6)


@query("cost_curves", with_p("select 'routed' as series, round(tau, 6) as tau, round(total_usd / n * 1000, 6) as usd_per_1k, round(quality_retained, 6) as quality from sw where split = 'test' union all select 'always frontier', null, round(avg(usd) * 1000, 6), 1.0e0 from tr join eq using (query_id) where tier_rank = 2 and split = 'test'", _EVAL))
def cost_curves(spark, sf_dir):
    queries = _queries(spark, sf_dir, "test")
    routed = R.sweep(queries).select(F.lit("routed").alias("series"), "tau", (F.col("total_usd") / F.col("n") * 1000).alias("usd_per_1k"), F.col("quality_retained").alias("quality"))
    top = R.always_frontier(queries).select(F.lit("always frontier").alias("series"), F.lit(None).cast("double").alias("tau"), "usd_per_1k", "quality")
    return rounded(routed.unionByName(top), "tau", "usd_per_1k", "quality", digits=6)


@query("random_router", with_p("select tau, round(sum(share * u) * 1000, 6) as usd_per_1k, round(sum(share * q), 6) as quality from (select x.tau, k, avg((case when confidence < x.tau and predicted < 2 then predicted + 1 else predicted end = k)::int) as share from eq cross join (values (0.0e0), (0.55e0), (0.95e0)) x(tau) cross join (values (0), (1), (2)) t(k) where split = 'test' group by x.tau, k) s join (select tier_rank, avg(usd) as u, avg(coalesce(ok, false)::int) as q from tr join eq using (query_id) where split = 'test' group by tier_rank) m on m.tier_rank = s.k group by tau", _EVAL))
def random_router(spark, sf_dir):
    taus = spark.createDataFrame([(0.0,), (0.55,), (0.95,)], "tau double")
    return rounded(R.random_router(_queries(spark, sf_dir, "test"), taus), "usd_per_1k", "quality", digits=6)


_NLL = "least(greatest(z0, z1, z2) / {t} + ln(exp((z0 - greatest(z0, z1, z2)) / {t}) + exp((z1 - greatest(z0, z1, z2)) / {t}) + exp((z2 - greatest(z0, z1, z2)) / {t})) - (case y when 0 then z0 when 1 then z1 else z2 end) / {t}, -ln(1e-12))"
_TG = f", tg as (select t, avg({_NLL.format(t='t')}) as nll, count(*) as n from p cross join (select 0.5e0 + 0.05e0 * i as t0, round(0.5e0 + 0.05e0 * i, 2) as t from range(91) r(i)) where split = 'calibration' group by t)"


@query("temperature_grid", with_p("select t as temperature, round(nll, 8) as nll, n from tg", _TG))
def temperature_grid(spark, sf_dir):
    return rounded(K.temperature_grid(view(spark, sf_dir, "v_logits").where("split = 'calibration'"), GRID), "nll")


@query("temperature_fit", with_p("select t as temperature, round(nll, 8) as nll, n from tg order by nll, t limit 1", _TG))
def temperature_fit(spark, sf_dir):
    return rounded(K.best_temperature(K.temperature_grid(view(spark, sf_dir, "v_logits").where("split = 'calibration'"), GRID)), "nll")


_REPORT = """select '{stage}' as stage, (select count(*) from c{i}) as n, (select round(avg({nll}), 6) from c{i}) as nll, (select round(sum(n * abs(c - a)) / sum(n), 6) from (select count(*) as n, avg(confidence) as c, avg((y = predicted)::int) as a from c{i} group by greatest(ceil(confidence * 15), 1))) as ece,
(select round(avg((p0 - (y = 0)::int) ** 2 + (p1 - (y = 1)::int) ** 2 + (p2 - (y = 2)::int) ** 2), 6) from c{i}) as brier"""
_SCALED = "c{i} as (select y, z0, z1, z2, a / (a + b + c) as p0, b / (a + b + c) as p1, c / (a + b + c) as p2, case when a >= b and a >= c then 0 when b >= c then 1 else 2 end as predicted, greatest(a, b, c) / (a + b + c) as confidence from (select y, z0, z1, z2, exp((z0 - greatest(z0, z1, z2)) / {t}) as a, exp((z1 - greatest(z0, z1, z2)) / {t}) as b, exp((z2 - greatest(z0, z1, z2)) / {t}) as c from v_logits where split = 'calibration'))"


@query("calibration_report", with_p(_REPORT.format(stage="before", i=1, nll=_NLL.format(t="1.0e0")) + " union all " + _REPORT.format(stage="after", i=2, nll=_NLL.format(t="1.25e0")), ", " + _SCALED.format(i=1, t="1.0e0") + ", " + _SCALED.format(i=2, t="1.25e0")))
def calibration_report(spark, sf_dir):
    return rounded(K.report(view(spark, sf_dir, "v_logits").where("split = 'calibration'"), 1.25), "nll", "ece", "brier", digits=6)


@query("leak_guard", oracle("select query_id from v_logits where split = 'train' intersect select case when query_id * 7 % 20 = 14 then query_id + 1 else query_id end from v_logits where split = 'calibration'"))
def leak_guard(spark, sf_dir):
    rows = view(spark, sf_dir, "v_logits")
    # the first calibration rows of each twenty ids are given the id of their neighbour, which is a train row's
    calibration = rows.where("split = 'calibration'").withColumn("query_id", F.expr("case when query_id * 7 % 20 = 14 then query_id + 1 else query_id end"))
    return K.leaked(rows.where("split = 'train'"), calibration)


QUESTIONS = {"tier": ("choice", ["z0", "z1", "z2"], "y"), "tools": ("noul", ["a0", "a1"], "yt"), "rag": ("noul", ["b0", "b1"], "yr")}
_QUESTIONS = "qs as (select query_id, split, 'choice' as qtype, y::integer as y, z0, z1, z2 from v_options union all select query_id, split, 'noul', yt::integer, a0, a1, null from v_options union all select query_id, split, 'noul', yr::integer, b0, b1, null from v_options)"
_QNLL = "least(greatest(z0, z1, z2) / {t} + ln(exp((z0 - greatest(z0, z1, z2)) / {t}) + exp((z1 - greatest(z0, z1, z2)) / {t}) + coalesce(exp((z2 - greatest(z0, z1, z2)) / {t}), 0)) - case y when 0 then z0 when 1 then z1 else z2 end / {t}, -ln(1e-12::double))"
_FIT = f"""{_QUESTIONS}, cq as (select * from qs where split = 'calibration'),
g1 as (select qtype, h, round(avg({_QNLL.format(t="(h / 100::double)")}), 10) as nll from cq cross join (select 50 + 10 * i as h from range(46) r(i)) group by qtype, h),
b1 as (select qtype, h as around from g1 qualify row_number() over (partition by qtype order by nll, h) = 1),
g2 as (select cq.qtype, h, count(*) as n, round(avg({_QNLL.format(t="(h / 100::double)")}), 10) as nll from cq join (select distinct qtype, greatest(50, least(500, around + i - 10)) as h from b1 cross join range(21) r(i) union select qtype, 100 from b1) p on p.qtype = cq.qtype group by cq.qtype, h),
at1 as (select qtype, n, nll from g2 where h = 100),
b2 as (select g2.qtype, h, g2.nll from g2 join b1 on b1.qtype = g2.qtype where abs(h - around) <= 10 qualify row_number() over (partition by g2.qtype order by g2.nll, h) = 1),
ft as (select t.qtype, coalesce(n, 0) as n, case when n >= 30 and b2.nll < at1.nll then h / 100::double else 1.0::double end as temperature, at1.nll as nll_before, case when n >= 30 and b2.nll < at1.nll then b2.nll else at1.nll end as nll_after
  from (values ('choice'), ('score'), ('noul')) t(qtype) left join at1 on at1.qtype = t.qtype left join b2 on b2.qtype = t.qtype)"""


def _questions(spark, sf_dir):
    return K.questions(view(spark, sf_dir, "v_options"), QUESTIONS).where("split = 'calibration'")


@query("temperature_by_type", oracle(f"with {_FIT} select qtype, n, temperature, round(nll_before, 8) as nll_before, round(nll_after, 8) as nll_after from ft"))
def temperature_by_type(spark, sf_dir):
    return rounded(K.temperature_by_type(_questions(spark, sf_dir)), "nll_before", "nll_after")


_BY_TYPE = """{qs}, tt(qtype, stage, t) as (values ('choice', 'before', 1.0::double), ('noul', 'before', 1.0::double), ('choice', 'after', 1.25::double), ('noul', 'after', 0.8::double)),
sc as (select qs.qtype, stage, y, {nll} as nll, greatest(z0, z1, z2) as m, exp((z0 - greatest(z0, z1, z2)) / t) as a, exp((z1 - greatest(z0, z1, z2)) / t) as b, coalesce(exp((z2 - greatest(z0, z1, z2)) / t), 0) as c, z0, z1, z2 from qs join tt on tt.qtype = qs.qtype where split = 'calibration'),
pc as (select qtype, stage, y, nll, a / (a + b + c) as p0, b / (a + b + c) as p1, c / (a + b + c) as p2, case when z0 = m then 0 when z1 = m then 1 else 2 end as predicted from sc),
ce as (select qtype, stage, count(*) as n, sum(nll) as nll, sum((p0 - (y = 0)::int) ** 2 + (p1 - (y = 1)::int) ** 2 + (p2 - (y = 2)::int) ** 2) as brier, avg(greatest(p0, p1, p2)) as cf, avg((predicted = y)::int) as ac from pc group by qtype, stage, greatest(ceil(greatest(p0, p1, p2) * 15), 1)),
li as (select qtype, stage, sum(n) as n, sum(nll) / sum(n) as nll, sum(n * abs(cf - ac)) / sum(n) as ece, sum(brier) / sum(n) as brier from ce group by qtype, stage)
select qtype, max(n)::bigint as n, {wide} from li group by qtype"""
_WIDE = ", ".join(f"round(max({m}) filter (stage = '{s}'), 6) as {m}_{s}" for s in ("before", "after") for m in ("nll", "ece", "brier"))


@query("calibration_by_type", oracle("with " + _BY_TYPE.format(qs=_QUESTIONS, nll=_QNLL.format(t="t"), wide=_WIDE)))
def calibration_by_type(spark, sf_dir):
    fixed = spark.createDataFrame([("choice", 1.25), ("noul", 0.8)], "qtype string, temperature double")
    return rounded(K.report_by_type(_questions(spark, sf_dir), fixed), *(f"{m}_{s}" for s in ("before", "after") for m in ("nll", "ece", "brier")), digits=6)


_BUNDLE = {"logits_tier": ["z0", "z1", "z2"], "logits_tools": ["a0", "a1"], "logits_rag": ["b0", "b1"]}


@query("logits_bundle", oracle("select query_id, split, y, " + ", ".join(f"round({c}::float::double, 4) as {c}" for columns in _BUNDLE.values() for c in columns) + " from v_options where split <> 'train'"))
def logits_bundle(spark, sf_dir):
    place = io.shared_place(spark)
    rows = view(spark, sf_dir, "v_options").where("split <> 'train'")
    io.export_logits(K.bundle(rows, _BUNDLE, "5f", ["query_id", "split", "y"]), place)
    found = K.unbundled(spark.read.parquet(place), _BUNDLE, "5f")
    return rounded(found, *(c for columns in _BUNDLE.values() for c in columns), digits=4)


@query("unpriced_tiers", oracle("with rates as (" + _RATES.format(rows="v_ledger where tier <> 'judge' and tier_rank <> 1") + ") select tier, count(*) as answers from v_runs where error is null and tier not in (select tier from rates) group by tier"))
def unpriced_tiers(spark, sf_dir):
    # a ledger that lost the calls of one tier
    rates = C.token_rates(view(spark, sf_dir, "v_ledger").where("tier <> 'judge' and tier_rank <> 1"))
    return R.unpriced(view(spark, sf_dir, "v_runs"), rates)


_UNIT = unit_sql("'7'", "'order'", "epoch", "query_id")


@query("epoch_order", oracle(f"select epoch, row_number() over (partition by epoch order by {_UNIT}, query_id) - 1 as place, query_id from v_logits cross join (values (1), (2)) e(epoch) where split = 'train'"))
def epoch_order(spark, sf_dir):
    return T.epoch_order(view(spark, sf_dir, "v_logits").where("split = 'train'"), 7, [1, 2])


def _slot_sql(n: int) -> str:
    return "list_transform(list_sort([" + ", ".join(f"{{'u': {unit_sql(chr(39) + '7' + chr(39), chr(39) + 'slot' + chr(39), 'query_id', chr(39) + str(i) + chr(39))}, 'i': {i}}}" for i in range(n)) + "]), lambda x: x.i)"


@query("slot_loss", oracle(f"""with s as (select query_id, y, z0, z1, z2, yt, a0, a1, {_slot_sql(3)} as o3, {_slot_sql(2)} as o2 from v_options)
select query_id, array_to_string(o3, ',') as option_order, list_position(o3, y)::integer - 1 as slot, round(ln(exp(z0) + exp(z1) + exp(z2)) - [z0, z1, z2][y + 1], 8) as loss, list_position(o2, yt)::integer - 1 as tools_slot, round(ln(exp(a0) + exp(a1)) - [a0, a1][yt + 1], 8) as tools_loss from s"""))
def slot_loss(spark, sf_dir):
    shown = T.slots(view(spark, sf_dir, "v_options"), 7, 3)
    loss = T.slot_loss([F.get(F.array("z0", "z1", "z2"), F.get("option_order", F.lit(i))) for i in range(3)], F.col("slot"))
    rows = shown.select("query_id", F.array_join(F.transform("option_order", lambda x: x.cast("string")), ",").alias("order3"), F.col("slot").alias("slot3"), loss.alias("loss"), "yt", "a0", "a1")
    two = T.slots(rows, 7, 2, "yt").select("query_id", F.col("order3").alias("option_order"), F.col("slot3").alias("slot"), "loss", F.col("slot").alias("tools_slot"), T.margin_loss(F.col("a1"), F.col("a0"), F.col("yt")).alias("tools_loss"))
    return rounded(two, "loss", "tools_loss")


@query("risk_coverage_series", with_p("select coverage, risk from (select 0e0 as coverage, round(risk, 8) as risk from (select risk, coverage from rw order by coverage limit 1) union all select distinct round(coverage, 8), round(risk, 8) from rw)", _RC))
def risk_coverage_series(spark, sf_dir):
    return rounded(M.risk_coverage_series(predicted(spark, sf_dir)), "coverage", "risk")
