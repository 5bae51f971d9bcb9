"""Hand-computed values of operators."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tierwise.functions import exprs as X
from tierwise.operators import calibration, costs, history, judging, labels, publishing, routing, seed, shares
from tierwise.operators import metrics as M
from tierwise.operators.ranking import running_sums
from tierwise.sources import io
from tierwise.tiers import parse_tiers, tier_rank, tiers


def one(df):
    return df.first()[0]


def preds(spark, y, p, conf=None, probs=None):
    n = len(y)
    rows = [(a, b, float((conf or [0.5] * n)[i]), (probs or [[0.0, 0.0, 0.0]] * n)[i]) for i, (a, b) in enumerate(zip(y, p, strict=True))]
    return spark.createDataFrame(rows, "y int, predicted int, confidence double, probs array<double>")


def test_accuracy_and_f1(spark):
    rows = preds(spark, [0, 1, 2, 2, 1], [0, 2, 2, 2, 1])
    assert one(M.accuracy(rows)) == pytest.approx(4 / 5)
    assert one(M.macro_f1(rows)) == pytest.approx(37 / 45)
    assert one(M.macro_f1(rows, [0, 1, 2, 3])) == pytest.approx(37 / 60)
    assert one(M.macro_f1(preds(spark, [0, 0, 1, 1], [0, 2, 1, 1]))) == pytest.approx(5 / 9)


def test_brier(spark):
    rows = preds(spark, [0, 2, 2], [0, 1, 2], probs=[[0.7, 0.2, 0.1], [0.1, 0.6, 0.3], [0.2, 0.2, 0.6]])
    assert one(M.brier(rows)) == pytest.approx(1.24 / 3)


def test_ece_and_bins(spark):
    hits = [1, 0, 1, 1, 1, 0, 0, 0]
    rows = preds(spark, [1] * 8, hits, [0.95] * 2 + [0.65] * 4 + [0.35] * 2)
    assert one(M.ece(rows)) == pytest.approx(0.25)
    assert one(M.ece(preds(spark, [0, 1], [1, 1], [1.0, 0.0]))) == pytest.approx(1.0)
    bins = M.reliability(rows).orderBy("bin").collect()
    assert len(bins) == 15 and sum(b.n for b in bins) == 8
    assert bins[0].confidence is None and bins[0].accuracy is None
    # edges belong to the bin below them, 0 to the first
    edges = M.binned(preds(spark, [0, 0], [0, 0], [1 / 15, 0.0])).collect()
    assert [(b.bin, b.n) for b in edges] == [(0, 2)]


def test_risk_coverage(spark):
    rows = preds(spark, [1] * 4, [1, 0, 1, 0], [0.9, 0.9, 0.6, 0.3])
    curve = [(r.confidence, r.coverage, r.risk) for r in M.risk_coverage(rows).orderBy(F.desc("confidence")).collect()]
    assert curve == [(0.9, 0.5, 0.5), (0.6, 0.75, pytest.approx(1 / 3)), (0.3, 1.0, 0.5)]
    assert one(M.risk_coverage_auc(preds(spark, [1] * 4, [1, 0, 1, 1], [0.9, 0.8, 0.7, 0.6]))) == pytest.approx(13 / 48)
    assert one(M.risk_coverage_auc(preds(spark, [1] * 3, [1, 0, 1], [0.9, 0.9, 0.5]))) == pytest.approx(4 / 9)


def test_running_sums_meet_a_plain_window(spark):
    rows = spark.range(1000).select(((F.col("id") * 37) % 1000 / 7.0).alias("k"), (F.col("id") % 5).alias("v"))
    got = {r.k: r.running_v for r in running_sums(rows, "k", ["v"], ranges=16).collect()}
    total = 0
    for r in sorted(rows.collect(), key=lambda r: r.k):
        total += r.v
        assert got[r.k] == total
    down = {r.k: r.running_v for r in running_sums(rows, "k", ["v"], descending=True, before=True, ranges=16).collect()}
    assert down[max(down)] == 0 and down[min(down)] == total - next(r.v for r in rows.collect() if r.k == min(down))


def test_percentiles(spark):
    row = M.percentiles(spark.range(1, 101).select(F.col("id").cast("double").alias("x")), "x").first()
    assert list(row) == pytest.approx([50.5, 95.05, 99.01])


def test_confusion_and_support(spark):
    rows = preds(spark, [0, 0, 2, 1], [0, 1, 2, 2])
    cells = {(r.true_tier, r.predicted_tier): (r.n, r.share) for r in M.confusion(rows).collect()}
    assert len(cells) == 9 and cells["local_small", "mid_tier"] == (1, 0.5) and cells["frontier", "frontier"] == (1, 1.0)
    assert {r.tier: r.n for r in M.support(preds(spark, [0], [1])).collect()} == {"local_small": 1, "mid_tier": 0, "frontier": 0}


def test_checks_fire(spark):
    with pytest.raises(ValueError):
        M.check(preds(spark, [], []))
    with pytest.raises(ValueError):
        M.check(preds(spark, [3], [0]))
    with pytest.raises(ValueError):
        M.check(preds(spark, [0], [0], [1.5]))


def test_softmax_and_argmax(spark):
    row = spark.createDataFrame([([0.0, math.log(3), 0.0],)], "z array<double>").select(X.softmax(F.col("z")).alias("a"), X.softmax(F.col("z"), 2.0).alias("b"), X.argmax(F.col("z")).alias("c")).first()
    assert row.a == pytest.approx([0.2, 0.6, 0.2])
    assert row.b[1] == pytest.approx(math.sqrt(3) / (2 + math.sqrt(3)))
    assert row.c == 1
    assert spark.range(1).select(X.argmax(F.array(F.lit(1.0), F.lit(1.0)))).first()[0] == 0


def test_casefold(spark):
    """Every letter with a case, alone, between others and at the end of a word."""
    letters = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and (c.casefold() != c or c.lower() != c or c.upper() != c)]
    texts = [t for c in letters for t in (c, f"aI{c}ıΣ {c}", f"x{c}")]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", X.casefold(F.col("t")).alias("f")).collect()
    assert [r.t for r in rows if r.f != r.t.casefold()] == [] and len(letters) > 2500
    assert spark.range(1).select(X.casefold(F.lit(None).cast("string"))).first()[0] is None


def test_text_functions(spark):
    rows = spark.createDataFrame([("  A  b\x1cSTRASSE ß\n",), ("",)], "t string").select(X.normalize(F.col("t")), X.strip(F.col("t"))).collect()
    assert rows[0][0] == "a b strasse ss" and rows[0][1] == "A  b\x1cSTRASSE ß" and rows[1][0] == ""
    row = spark.range(1).select(X.choice_prompt(F.lit("Q"), F.array(F.lit("x"), F.lit("y"))), X.base_model(F.lit("a/B ")), X.round_even(F.lit(2.5)), X.percent_text(F.lit(1), F.lit(0)), X.percent_text(F.lit(1), F.lit(16)), X.error_class(F.lit("E: m"))).first()
    assert list(row) == ["Q\nA. x\nB. y", "b", 2, "-", "6.2%", "E"]


def test_hash_unit_meets_python(spark):
    import hashlib

    got = [r[0] for r in spark.range(50).select(X.hash_unit(F.lit(1), F.lit("query"), F.col("id"))).collect()]
    assert got == [int(hashlib.sha256(f"1:query:{i}".encode()).hexdigest()[:16], 16) / 2**64 for i in range(50)]
    key = spark.range(1).select(X.cache_key(F.lit("p"), F.lit("m"))).first()[0]
    assert key == hashlib.sha256(b"p\x00m").hexdigest()


def test_price(spark):
    schema = "i double, o double, l boolean"
    price = lambda *r: spark.createDataFrame([r], schema).select(X.price(F.col("i"), F.col("o"), F.col("l")).alias("p")).first().p
    assert price(1.0, 2.0, True).prompt == 1e-6 and price(None, None, True).prompt == 0 and price(None, None, False) is None
    with pytest.raises(Exception, match="only one"):
        price(1.0, None, False)


def test_tiers(spark):
    assert parse_tiers("frontier, local_small") == ["local_small", "frontier"] and len(parse_tiers("all")) == 3
    with pytest.raises(ValueError):
        parse_tiers("huge")
    assert [r[0] for r in tiers(spark).orderBy("tier_rank").select(tier_rank(F.col("tier"))).collect()] == [0, 1, 2]


@pytest.mark.parametrize(
    ("verdicts", "label"),
    [({}, None), ({0: "equivalent", 1: "equivalent"}, 0), ({0: "acceptable", 1: "worse"}, 0), ({0: "worse", 1: "equivalent"}, 1), ({0: "worse", 1: "acceptable"}, 1), ({0: "worse", 1: "worse"}, 2), ({0: "equivalent"}, 0), ({1: "acceptable"}, 1), ({0: "worse"}, 2), ({1: "worse"}, 2)],
)
def test_labels(spark, verdicts, label):
    rows = spark.createDataFrame([(1, r, v) for r, v in verdicts.items()], "query_id int, tier_rank int, verdict string")
    got = labels.minimum_sufficient(rows).collect()
    assert (got[0].label_rank if got else None) == label


@pytest.mark.parametrize(("label", "judged", "expected"), [(0, [], True), (0, [1], True), (1, [0], True), (1, [], False), (2, [0, 1], True), (2, [0], False)])
def test_determined(spark, label, judged, expected):
    row = spark.createDataFrame([(label, judged)], "r int, j array<int>").select(labels.determined(F.col("r"), F.col("j"))).first()
    assert row[0] is expected


@pytest.mark.parametrize(
    ("text", "tools", "rag"),
    [("Paris.", False, False), ("<tool_call>", True, False), ("I can't run code here", True, False), ("I’m not able to browse", False, True), ("I do not have access to real-time data", False, True), ("as of my knowledge cutoff", False, True), ("You can search the web", False, False), (None, False, False)],
)
def test_needs(spark, text, tools, rag):
    a, b = labels.needs(F.col("t"))
    assert tuple(spark.createDataFrame([(text,)], "t string").select(a, b).first()) == (tools, rag)


def test_malformed_verdicts(spark):
    schema = "query_id int, tier_rank int, candidate_tier string, reference_tier string, verdict string"
    for bad in ([(1, 0, "local_small", "mid_tier", "worse")], [(1, 2, "frontier", "frontier", "worse")], [(1, 0, "local_small", "frontier", "worse")] * 2):
        with pytest.raises(ValueError):
            labels.check_verdicts(spark.createDataFrame(bad, schema))


def test_stratified_split(spark):
    rows = spark.range(640).select(F.col("id").alias("query_id"), (F.col("id") % 3).alias("s"))
    out = labels.split_rows(rows, ["s"], seed=4)
    for r in out.groupBy("s").pivot("split", ["train", "calibration", "test"]).count().collect():
        n = r.train + r.calibration + r.test
        assert abs(r.train - 0.7 * n) <= 1 and abs(r.calibration - 0.15 * n) <= 1
    again = labels.split_rows(rows.orderBy(F.desc("query_id")).repartition(3), ["s"], seed=4)
    assert sorted(map(tuple, again.select("query_id", "split").collect())) == sorted(map(tuple, out.select("query_id", "split").collect()))
    assert labels.split_rows(rows, ["s"], seed=5).exceptAll(out).count() > 0
    single = labels.split_rows(spark.range(3000).select(F.col("id").alias("query_id")), ["query_id"]).groupBy("split").count().collect()
    assert all(abs(r["count"] / 3000 - {"train": 0.7}.get(r.split, 0.15)) < 0.03 for r in single)
    with pytest.raises(ValueError):
        labels.holdout_split(rows.limit(1), ["s"], 0.1)
    with pytest.raises(ValueError):
        labels.only_split(out, "train")


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, seq int")
    new = spark.createDataFrame([(2, "x", 1), (2, "c", 2), (3, "d", 1)], "k int, v string, seq int")
    once = labels.upsert(old, new, ["k"])
    assert sorted(map(tuple, once.select("k", "v").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, labels.upsert(once, new, ["k"]).collect())) == sorted(map(tuple, once.collect()))


def test_seed(spark):
    raw = lambda texts: spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "pos int, text string, domain string")
    every = seed.interleave([("chat", raw(["Hi there", " hi  THERE ", "x" * 2000, " ", "last"])), ("math", raw(["2+2?"])), ("quiz", raw(["Which?"]))])
    got = lambda n: [r.prompt for r in seed.seed_prompts(every, n).orderBy("turn", "ordinal").collect()]
    assert got(50) == ["Hi there", "2+2?", "Which?", "last"] and got(2) == ["Hi there", "2+2?"]
    for names in ([], ["nope"]):
        with pytest.raises(ValueError):
            seed.sources_of({"a": lambda: raw([])}, names)
    turns = "array<struct<role:string,content:string>>"
    rows = spark.createDataFrame([([("system", "s"), ("user", " q "), ("user", "z")],), ([("assistant", "a")],), ([("user", ""), ("user", "z")],), ([],), (None,)], f"m {turns}")
    assert [r[0] for r in rows.select(seed.first_user_message(F.col("m"))).collect()] == [" q ", None, None, None, None]


def test_token_rates(spark):
    schema = "tier string, prompt_tokens bigint, completion_tokens bigint, usd double"
    rows = [("m", 100, 50, 100e-6 + 50 * 4e-6), ("m", 200, 10, 200e-6 + 10 * 4e-6), ("f", 100, 100, 0.002), ("l", 5, 5, 0.0), ("l", 7, 1, 0.0), ("z", 0, 0, 0.0)]
    got = {r.tier: (r.prompt_rate, r.completion_rate) for r in costs.token_rates(spark.createDataFrame(rows, schema)).collect()}
    assert got["m"] == pytest.approx((1e-6, 4e-6)) and got["f"] == pytest.approx((1e-5, 1e-5)) and got["l"] == (0, 0) and got["z"] == (0, 0)


def test_gate(spark):
    schema = "new_calls bigint, usd double, usd_max double, hosted boolean, model string"
    total = lambda *rows: costs.estimate_totals(spark.createDataFrame(list(rows), schema))
    assert costs.gate(total((1, 1.0, 2.0, True, "m")), False) == "dry run"
    assert costs.gate(total((1, None, None, True, "m")), True) == "refused"
    assert costs.gate(total((0, None, None, True, "m"), (3, 0.0, 0.0, False, "l")), False) == "go"


def test_routing(spark):
    schema = "query_id int, predicted int, confidence double, cost0 double, cost1 double, cost2 double, ok0 boolean, ok1 boolean, ok2 boolean"
    rows = spark.createDataFrame([(1, 0, 0.5, 0.0, 0.5, 6.0, False, True, True), (2, 0, 0.9, 0.0, 0.5, 6.0, None, True, True), (3, 1, 0.8, 0.0, 0.5, 6.0, True, False, True), (4, 2, 0.4, 0.0, 0.5, 6.0, True, True, True)], schema)
    taus = routing.candidate_taus(rows)
    assert taus.count() == 6
    fast = {r.tau: tuple(r) for r in routing.sweep(rows).collect()}
    slow = {r.tau: tuple(r) for r in routing.sweep_crossed(rows, taus).collect()}
    assert fast.keys() == slow.keys()
    for k, v in fast.items():
        assert v == pytest.approx(slow[k])
    at0 = next(r for r in routing.sweep(rows).collect() if r.tau == 0)
    assert (at0.escalated, at0.total_usd, at0.quality_retained, at0.unknown_quality) == (0, 6.5, 0.25, 1)
    free = rows.withColumn("cost2", F.lit(0.0))
    assert all(math.isnan(r.cost_retained) for r in routing.sweep(free).collect())
    assert routing.select_tau(routing.sweep(rows), 0.0).first().tau == 0.0
    best = routing.select_tau(routing.sweep(rows), 2.0).first()
    assert not best.target_met and best.quality_retained == max(v[6] for v in fast.values())


def test_temperature_is_recovered(spark):
    rows = spark.range(4000).select(*(F.randn(i).alias(f"r{i}") for i in range(3)), F.rand(9).alias("u"))
    p = X.softmax(F.array("r0", "r1", "r2"))
    y = F.when(F.col("u") < F.get("p", F.lit(0)), 0).when(F.col("u") < F.get("p", F.lit(0)) + F.get("p", F.lit(1)), 1).otherwise(2)
    rows = rows.withColumn("p", p).withColumn("y", y).select("y", *((F.col(f"r{i}") * 3).alias(f"z{i}") for i in range(3))).cache()
    assert calibration.fit_temperature(rows) == pytest.approx(3.0, rel=0.1)
    assert calibration.fit_temperature(rows.limit(5)) == 1.0
    t = calibration.fit_temperature(rows)
    stages = {r.stage: r for r in calibration.report(rows, t).collect()}
    assert stages["after"].nll <= stages["before"].nll


def test_calibration_guards(spark):
    a, b = spark.range(5).withColumnRenamed("id", "query_id"), spark.range(4, 6).withColumnRenamed("id", "query_id")
    with pytest.raises(ValueError):
        calibration.check_disjoint(a, b)
    calibration.check_disjoint(a, b.where("query_id > 4"))
    good = {"fitted_on": "calibration", "checkpoint_sha256": "x", "temperature": 9.0}
    assert calibration.check_identity(good, "x") == 5.0
    for bad in ({"fitted_on": "test"}, {"checkpoint_sha256": "y"}, {"temperature": [1.0]}):
        with pytest.raises(ValueError):
            calibration.check_identity(good | bad, "x")


@pytest.mark.parametrize(
    ("reply", "verdict", "reason"),
    [
        ('{"verdict": "acceptable", "reason": "Correct but terse."}', "acceptable", "Correct but terse."), ('```json\n{"verdict": "worse", "reason": "\\n Wrong.\\nx"}\n```', "worse", "Wrong."),
        ('Here: {"verdict": " Equivalent ", "reason": "Same.", "x": 1} bye', "equivalent", "Same."), ("not json", None, None), ('{"verdict": "better", "reason": "x"}', None, None), ('{"verdict": "worse"}', None, None),
        ('{"verdict": "worse", "reason": 5}', None, None), ("{'verdict': 'worse', 'reason': 'x'}", None, None), ('{"verdict": "worse", "reason": "  "}', None, None), (None, None, None), ("}{", None, None),
    ],
)
def test_replies(spark, reply, verdict, reason):
    row = judging.parse_replies(spark.createDataFrame([(reply,)], "reply string")).first()
    assert (row.verdict, row.reason) == (verdict, reason)


def test_judge_prompts(spark):
    row = spark.range(1).select(judging.judge_prompt(F.lit("q"), F.lit("r"), F.lit("c")).alias("p"), judging.retry_prompt(F.lit("p"), F.lit("x" * 3000), F.lit("e")).alias("r")).first()
    assert "<question>\nq\n</question>" in row.p and row.r.count("x") < 2010 and "It cannot be used: e" in row.r


def test_publish_and_restore(spark):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [(sha(t), t, f"{t} before", s, "train", "frontier", False, True, ["mid_tier"], 0.5, 0.25) for t, s in [("a", "open"), ("b", "closed"), ("c", "new"), ("d", "closed")]]
    examples = spark.createDataFrame(rows, "query_id string, prompt string, conversation_summary string, source string, split string, tier string, needs_tools boolean, needs_rag boolean, judged_tiers array<string>, frontier_cost_usd double, label_cost_usd double")
    terms = spark.createDataFrame([("open", True), ("closed", False)], "source string, redistribute_text boolean")
    public = publishing.public_frame(publishing.check_hashes(examples), terms)
    assert public.columns == publishing.COLUMNS and {r.query_id: r.prompt for r in public.collect()} == {sha("a"): "a", sha("b"): None, sha("c"): None, sha("d"): None}
    assert {r.conversation_summary for r in public.collect()} == {"a before", None}
    assert {r.source: (r.rows, r.text_rows, r.withheld_rows) for r in publishing.inclusion(public).collect()} == {"open": (1, 1, 0), "closed": (2, 0, 2), "new": (1, 0, 1), "all": (4, 1, 3)}
    texts = publishing.candidate_texts(spark.createDataFrame([(0, "closed", " b "), (1, "closed", ""), (2, "other", "d"), (3, "new", "c")], "pos int, source string, text string"))
    kept, report = publishing.restore_dataset(public, texts)
    assert sorted(r.prompt for r in kept.collect()) == ["a", "b", "c"] and tuple(report.first()) == (3, 3, 2, 1)
    same, report = publishing.restore_dataset(examples, texts)
    assert same is examples and tuple(report.first()) == (4, 0, 0, 0)
    with pytest.raises(ValueError):
        publishing.check_hashes(examples.withColumn("query_id", F.lit("x")))


def test_card():
    card = "x\n[section]: # (a)\nold\n[end]: #\nmiddle\n[section]: # (b)\nstay\n[end]: #\n"
    out = publishing.fill_card(card, {"a": "new\nlines"})
    assert out == card.replace("old", "new\nlines") and publishing.fill_card(out, {}) == out
    for wrong, texts in [(card, {"c": ""}), (card.replace("[end]: #", ""), {}), (card + "[section]: # (z)\n", {})]:
        with pytest.raises(ValueError):
            publishing.fill_card(wrong, texts)


def test_markdown(spark):
    rows = spark.createDataFrame([("a", 1), ("bbbb", None)], "x string, n int")
    assert publishing.markdown(rows) == "| x    | n   |\n| ---- | --- |\n| a    | 1   |\n| bbbb | -   |\n"


def test_history(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, 0.8), (3, 0.9), (4, 0.95), (5, 0.1)], "step int, loss double")
    assert tuple(history.early_stopping(rows, 2).first()) == (2, 0.8, 4)
    assert tuple(history.early_stopping(rows, 3).first()) == (5, 0.1, None)
    factors = [r[0] for r in spark.range(10).select(history.learning_rate(F.col("id"), 10, 0.2)).collect()]
    assert factors[:3] == [0.5, 1.0, 1.0] and factors[9] == pytest.approx(1 / 8)
    assert [r.done for r in history.progress_marks(rows, "step", 5).collect()] == [1, 2, 3, 4, 5]


def test_shares(spark):
    rows = spark.createDataFrame([("a", "frontier"), ("b", "frontier"), ("a", "local_small")], "source string, tier string")
    cells = {r.source: (r.local_small, r.mid_tier, r.frontier, r.total) for r in shares.crosstab(rows, "source").collect()}
    assert cells == {"a": (1, 0, 1, 2), "b": (0, 0, 1, 1), "all": (1, 0, 2, 3)}
    assert {r.tier: r.n for r in shares.distribution(rows, "tier", tiers(spark).select("tier")).collect()}["mid_tier"] == 0
    assert shares.flags(rows.limit(0), F.col("tier") == "x", "x").first().pct is None


def test_files(spark, tmp_path):
    assert io.read_json(spark, f"{tmp_path}/none", "tier_runs").count() == 0
    with pytest.raises(Exception):  # noqa: B017
        io.read_json(spark, f"{tmp_path}/none", "ledger", required=True)
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache/a.json").write_text('{"cache_key": "k", "model": "m"}\n\n')
    assert io.read_json(spark, f"{tmp_path}/cache", "cache").first().max_tokens == 1024
    new = spark.createDataFrame([(1, "a", 1)], "k int, v string, seq int")
    io.write_upsert(new, f"{tmp_path}/t", ["k"])
    io.write_upsert(new.withColumn("v", F.lit("b")).withColumn("seq", F.lit(0)), f"{tmp_path}/t", ["k"])
    assert [r.v for r in io.read_upserted(spark, f"{tmp_path}/t", new.schema).collect()] == ["b"]
    rows = spark.createDataFrame([(1, "train"), (2, "test")], "query_id int, split string")
    io.write_dataset(rows, f"{tmp_path}/d")
    assert io.read_split(spark, f"{tmp_path}/d", "test").first().query_id == 2
    assert "PartitionFilters: [isnotnull(split" in io.read_split(spark, f"{tmp_path}/d", "test")._jdf.queryExecution().toString()
    io.append_log(rows, f"{tmp_path}/log")
    io.append_log(rows, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 4
    io.write_document(rows.limit(1), f"{tmp_path}/doc")
    assert io.read_document(spark, f"{tmp_path}/doc").first().query_id == 1
    with pytest.raises(ValueError):
        io.export_logits(rows.withColumn("prompt", F.lit("x")), f"{tmp_path}/l")
    public = spark.createDataFrame([("b", "train", True), ("a", "train", True)], "query_id string, split string, text_included boolean")
    io.stage(public, f"{tmp_path}/pub", "card", {"rebuild": "how"})
    assert not (tmp_path / "pub/rebuild").exists()
    assert [r.value for r in spark.read.text(f"{tmp_path}/pub/splits/split=train").collect()] == ["a", "b"]


def test_pinned_prompts(spark, tmp_path):
    """Positions count rows over files; a scan goes on from a position; another revision or none is an error."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tierwise.sources import prompts

    path = str(tmp_path / "prompts")
    for i, n in enumerate([2500, 0, 700]):
        (tmp_path / "prompts").mkdir(exist_ok=True)
        rows = {"id": pa.array(range(i * 10_000, i * 10_000 + n), pa.int64()), "q": pa.array([None if j % 97 == 5 else f"{i}:{j}" for j in range(n)], pa.string()), "pos": pa.array([-1] * n, pa.int64())}
        pq.write_table(pa.table(rows), f"{path}/part-{i}.parquet", row_group_size=1000)
    spark.dataSource.register(prompts.PinnedPrompts)
    now = prompts.revision(path)
    load = lambda **o: spark.read.format("pinned_prompts").options(path=path, key="id", text="q", **o).load()
    every = sorted((r.pos, r.key, r.text, r.domain) for r in load(revision=now).collect())
    keys = [*range(2500), *range(20_000, 20_700)]
    assert every == [(i, k, None if k % 10_000 % 97 == 5 else f"{k // 10_000}:{k % 10_000}", None) for i, k in enumerate(keys)]
    for start in (999, 1000, 2499, 2500, 3199, 3200, 9999):
        assert sorted(r.pos for r in load(revision=now, start=start).collect()) == list(range(start, 3200))
    assert [p.first for p in prompts.PromptReader({"path": path, "revision": now, "start": "2100"}).partitions()] == [2000, 2500]
    pq.write_table(pa.table({"id": pa.array([1], pa.int64()), "q": ["new"]}), f"{path}/part-9.parquet")
    assert prompts.revision(path) != now
    for wrong in ({"revision": now}, {}):
        with pytest.raises(Exception, match="revision"):
            load(**wrong).collect()
    with pytest.raises(FileNotFoundError):
        prompts.revision(f"{path}/absent")


def test_retries(spark):
    rows = spark.createDataFrame([(1, "p", None), (2, "p", "no"), (3, "p", '{"verdict": "worse"}'), (4, "p", '{"verdict": "worse", "reason": "x"}'), (5, None, "no"), (6, "p", "{" + "x" * 3000)], "id int, prompt string, reply string")
    found = {r.id: r.retry for r in judging.retries(rows).collect()}
    assert set(found) == {1, 2, 3, 5, 6} and found[5] is None
    assert judging.PROBLEMS[0] in found[1] and judging.PROBLEMS[0] in found[2] and judging.PROBLEMS[1] in found[3] and "x" * 1999 in found[6] and "x" * 2000 not in found[6]
    assert judging.retries(rows.limit(0)).columns == ["id", "prompt", "reply", "retry"]


def test_bundles_of_logits(spark, tmp_path):
    of = {"t": ["z0", "z1"], "u": ["a"]}
    rows = spark.createDataFrame([(1, "test", 0.1, 2.0, None), (2, "train", 1.0, -1.0, 3.0)], "query_id int, split string, z0 double, z1 double, a double")
    io.export_logits(calibration.bundle(rows, of, "s"), str(tmp_path / "b"))
    held = spark.read.parquet(str(tmp_path / "b"))
    got = calibration.unbundled(held, of, "s").orderBy("query_id").collect()
    assert got[0].z0 == pytest.approx(0.1, abs=1e-7) and got[0].a is None and (got[1].z1, got[1].a) == (-1.0, 3.0)
    for bad, sha in ((held, "other"), (held.limit(0), "s"), (held.withColumn("u", F.array()), "s"), (held.withColumn("t", F.lit(None).cast("array<float>")), "s"), (held.withColumn("checkpoint_config_sha256", F.lit(None).cast("string")), "s")):
        with pytest.raises(ValueError, match="another checkpoint or shape"):
            calibration.unbundled(bad, of, sha)


def test_rates_of_all_tiers(spark):
    runs = spark.createDataFrame([("a", None), ("b", None), ("c", "E: x")], "tier string, error string")
    rates = spark.createDataFrame([("a", 1.0)], "tier string, prompt_rate double")
    with pytest.raises(ValueError, match=r"no rates for \['b'\]"):
        routing.check_rates(runs, rates)
    assert routing.check_rates(runs.where("tier <> 'b'"), rates) is rates


def test_synthetic_examples(spark):
    from tierwise.operators import training

    rows = training.synthetic_examples(spark, 400, 3)
    got = rows.collect()
    assert len({r.query_id for r in got}) == 400 and {r.tier for r in got} == {"local_small", "mid_tier", "frontier"} and {r.split for r in got} == {"train", "calibration", "test"}
    assert sorted(training.synthetic_examples(spark, 400, 3).collect()) == sorted(got) and training.synthetic_examples(spark, 0).count() == 0
    assert publishing.check_hashes(rows) is rows and {r.prompt for r in training.synthetic_examples(spark, 5, 4).collect()}.isdisjoint(r.prompt for r in got)


def test_staged_ids_are_sorted_through_the_files(spark, tmp_path):
    rows = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("query_id"), F.when(F.col("id") % 10 < 9, "train").otherwise("test").alias("split"), F.lit(True).alias("text_included"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        io.stage(rows, str(tmp_path / "s"), "card")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "s" / "splits" / "split=train").glob("part-*.txt"))
    ids = [x for f in files for x in f.read_text().split()]
    assert len(ids) == 2700 and ids == sorted(ids) and len(files) > 1


def test_latency_of_a_router(spark, tmp_path):
    """Made once and warmed up in each partition; every text is timed once, rows without one are left out."""
    from tierwise.operators import latency

    log = str(tmp_path / "calls")

    def router():
        import time
        import uuid

        made = f"{log}-{uuid.uuid4().hex}"

        def route(text):
            with open(made, "a") as f:
                f.write(f"{text}\n")
            time.sleep(0.02 if text == "slow" else 0.0)
            return "mid_tier"

        return route

    rows = spark.createDataFrame([(i, t, 0) for i, t in enumerate(["a", "slow", None, "", "b", "a"])], "query_id long, prompt string, tier int").coalesce(1)
    got = {r.query_id: (r.tier, r.latency_ms) for r in latency.timed_routes(rows, router).collect()}
    assert set(got) == {0, 1, 4, 5} and {t for t, _ in got.values()} == {"mid_tier"} and got[1][1] >= 20 > got[0][1]
    calls = [f.read_text().split() for f in tmp_path.glob("calls-*")]
    assert calls == [["a", "slow", "a", "slow", "b", "a"]]
    told = latency.latency(latency.timed_routes(rows, router)).first()
    assert told.n == 4 and told.p50 < 20 <= told.p99 + 1 and told.p95 <= told.p99
    with pytest.raises(ValueError, match="no rows with a text"):
        latency.latency(latency.timed_routes(rows.where("prompt = ''"), router))
