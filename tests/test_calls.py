"""Calls, caches, upserts, scans, digests and calibration by type, by hand values and brute force."""

from __future__ import annotations

import hashlib
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from tierwise.operators import calibration, calls, costs, history, labels, publishing, ranking, shares, training
from tierwise.operators.joins import lookup
from tierwise.sources import cache, io
from tierwise.streaming import calls as stream
from tierwise.streaming.ledger import file_stream

CALLS = "query_id bigint, tier_rank int, prompt string, model string"


def _sha(prompt, model):
    return hashlib.sha256(f"{prompt}\0{model}".encode()).hexdigest()


def test_duplicates_share_the_first_call(spark):
    rows = [(3, 0, "a", "m"), (1, 1, "a", "m"), (2, 0, "a", "n"), (4, 0, None, "m"), (5, 0, "", "m")]
    got = {r.query_id: (r.cache_key, r.cached) for r in calls.duplicates(calls.keyed(spark.createDataFrame(rows, CALLS))).collect()}
    assert got == {1: (_sha("a", "m"), False), 3: (_sha("a", "m"), True), 2: (_sha("a", "n"), False), 4: (_sha("", "m"), False), 5: (_sha("", "m"), True)}


def test_lookup_of_frequent_keys(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)] + [(None, 1000)], "k int, v int")
    values = spark.createDataFrame([(1, "one"), (9, "nine")], "k int, x string")
    heavy = spark.createDataFrame([(1,)], "k int")
    for some in (None, heavy):
        got = sorted((r.v, r.x) for r in lookup(rows, values, ["k"], some).collect())
        assert got == sorted([(i, "one" if i % 3 else "nine" if i == 9 else None) for i in range(300)] + [(1000, None)])


@pytest.fixture
def table(spark, tmp_path):
    name = f"cache_{os.path.basename(tmp_path).replace('-', '_')}"
    yield name
    spark.sql(f"drop table if exists {name}")
    spark.sql(f"drop table if exists {name}_small")


def test_cache_is_not_shuffled(spark, table):
    answer = lambda k, text, second, most: (k, "m", text, 1, 2, 0.5, 0.1, second, most)
    schema = "cache_key string, model string, completion string, prompt_tokens bigint, completion_tokens bigint, cost_usd double, latency_s double, created_at timestamp, max_tokens int"
    at = lambda rows: spark.createDataFrame(rows, schema.replace("created_at timestamp", "created_at string")).withColumn("created_at", F.col("created_at").cast("timestamp"))
    cache.put(at([answer(f"k{i}", "old", "2024-01-01 00:00:00", 9) for i in range(50)]), table, 4)
    cache.put(at([answer("k1", "new", "2024-01-02 00:00:00", 9), answer("x", "cut", "2024-01-01 00:00:00", 2)]), table, 4)
    wanted = spark.createDataFrame([(i, f"k{i}") for i in range(60)] + [(60, "x")], "query_id int, cache_key string")
    todo = calls.uncached_calls(wanted, cache.read(spark, table), 4)
    assert sorted(r.query_id for r in todo.collect()) == [*range(50, 61)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = calls.uncached_calls(wanted, cache.read(spark, table), 4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the calls are shuffled, the cache is not
    assert plan.count("Exchange hashpartitioning(cache_key") == 1
    cache.compact(spark, table, f"{table}_small", 4)
    assert {r.cache_key: r.completion for r in cache.read(spark, f"{table}_small").collect()} == {f"k{i}": "new" if i == 1 else "old" for i in range(50)} | {"x": "cut"}


def test_calls_are_made_once_and_logged_first(spark, table, tmp_path):
    """A partition that fails after its calls runs again; every key is in the log once, duplicates share the answer, errors are values."""
    seen = tmp_path / "seen"
    seen.mkdir()

    def client():
        def ask(prompt, model):
            with open(seen / "all", "a") as f:
                f.write(f"{prompt}\n")
            if prompt == "bad":
                raise ValueError("no")
            if prompt == "slow" and open(seen / "all").read().count("slow") < 3:
                raise TimeoutError("late")
            return {"completion": prompt.upper(), "prompt_tokens": 10, "completion_tokens": 5, "usd": 0.25 if model == "priced" else None}

        return ask

    rows = [(1, 0, "one", "m"), (2, 0, "one", "m"), (3, 0, "bad", "m"), (4, 0, "slow", "m"), (5, 0, "two", "priced"), (6, 0, "bad", "m"), (7, 0, "three", "free")]
    prices = spark.createDataFrame([("m", 0.01, 0.1)], "model string, p_in double, p_out double")
    wait = []
    run = lambda batch, frame: stream.answered(frame, table, client, prices, f"{tmp_path}/place", batch, 100, 4, retries=3, base=0.0, sleep=lambda s: wait.append(s))
    frame = spark.createDataFrame(rows, CALLS)
    got = {r.query_id: (r.completion, round(r.cost_usd, 6), r.cached, r.error) for r in run("a", frame).collect()}
    assert got == {1: ("ONE", 0.6, False, None), 2: ("ONE", 0.0, True, None), 3: ("", 0.0, False, "ValueError: no"), 4: ("SLOW", 0.6, False, None), 5: ("TWO", 0.25, False, None), 6: ("", 0.0, False, "ValueError: no"), 7: ("THREE", 0.0, False, None)}
    made = open(seen / "all").read().split()
    assert sorted(made) == ["bad", "one", "slow", "slow", "slow", "three", "two"]
    # the same batch again: nothing is called, nothing is logged twice
    assert {r.query_id: r.completion for r in run("a", frame).collect()} == {k: v[0] for k, v in got.items()}
    assert open(seen / "all").read().split() == made
    # another batch finds the answers; failed calls are made again
    again = {r.query_id: (r.completion, r.cost_usd, r.cached) for r in run("b", frame).collect()}
    assert again[1] == ("ONE", 0.0, True) and again[5] == ("TWO", 0.0, True)
    assert sorted(open(seen / "all").read().split()[len(made):]) == ["bad"]
    assert sorted((r.model, r.usd) for r in spark.read.json(f"{tmp_path}/place/ledger").collect()) == [("free", 0.0), ("m", pytest.approx(0.6)), ("m", pytest.approx(0.6)), ("priced", 0.25)]


def test_failed_task_is_logged_once(spark, tmp_path, table):
    """Spark runs a task again that has already called; its answers and spending count once."""
    from pyspark import TaskContext

    def client():
        first = TaskContext.get().attemptNumber() == 0

        def ask(prompt, model):
            if prompt == "last" and first:
                os._exit(1)
            return {"completion": prompt, "prompt_tokens": 1, "completion_tokens": 1, "usd": 1.0}

        return ask

    # local mode gives a task one attempt: the batch is run again as a restarted job would
    frame = spark.createDataFrame([(i, 0, "last" if i == 19 else f"p{i}", "m") for i in range(20)], CALLS).coalesce(1)
    prices = spark.createDataFrame([], "model string, p_in double, p_out double")

    def second():
        return lambda prompt, model: {"completion": prompt, "prompt_tokens": 1, "completion_tokens": 1, "usd": 1.0}

    with pytest.raises(Exception):  # noqa: B017
        stream.answered(frame, table, client, prices, f"{tmp_path}/p", "a", 100, 4)
    assert not os.path.exists(f"{tmp_path}/p/ledger")
    assert stream.answered(frame, table, second, prices, f"{tmp_path}/p", "a", 100, 4).count() == 20
    assert spark.read.json(f"{tmp_path}/p/ledger").count() == 20


def test_delays_and_retries():
    assert all(0.5 * min(60, 2**k) <= calls.delay("key", k, 1.0, 60.0) <= min(60, 2**k) for k in range(10))
    assert calls.retryable(TimeoutError()) and calls.retryable(ConnectionResetError()) and not calls.retryable(ValueError())


def test_canary(spark):
    rows = [(2, 0, "x", "a"), (1, 0, "first", "a"), (1, 1, "first", "b")]
    asked = lambda fail: lambda: lambda prompt, model: {"completion": prompt} if prompt == "first" and model != fail else 1 / 0
    stream.canary(spark.createDataFrame(rows, CALLS), asked(None), base=0.0)
    with pytest.raises(RuntimeError, match="b: ZeroDivisionError"):
        stream.canary(spark.createDataFrame(rows, CALLS), asked("b"), base=0.0)


def test_gate_lets_nothing_past_a_failing_canary(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(10)], "id int").repartition(3).write.parquet(f"{tmp_path}/in")
    admitted, tried = [], []

    def first(one, ok):
        tried.append(one.count())
        if not ok:
            raise RuntimeError("tier is down")

    def go(ok):
        stream.gated(file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema), f"{tmp_path}/state", f"{tmp_path}/passed", lambda one: first(one, ok), lambda batch, n: admitted.append(batch.count()))

    with pytest.raises(Exception, match="tier is down"):
        go(False)
    assert admitted == [] and tried == [1]
    go(True)
    assert sum(admitted) == 10 and tried == [1, 1]
    spark.createDataFrame([(99,)], "id int").write.mode("append").parquet(f"{tmp_path}/in")
    go(False)
    assert sum(admitted) == 11 and tried == [1, 1]


def test_stream_marks_calls_of_a_key_in_flight(spark, tmp_path):
    def run(rows):
        spark.createDataFrame(rows, "cache_key string, call_id int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows = stream.seen_before(file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema))
        from tierwise.streaming.ledger import into_files

        return {r.call_id: r.cached for r in into_files(rows, f"{tmp_path}/out", f"{tmp_path}/state").collect()}

    assert run([("a", 2), ("a", 1), ("b", 3)]) == {1: False, 2: True, 3: False}
    # a later micro-batch of the same stream knows the keys
    assert run([("a", 0), ("c", 5)]) == {1: False, 2: True, 3: False, 0: True, 5: False}


def test_upsert_rewrites_only_its_buckets(spark, tmp_path):
    path = f"{tmp_path}/t"
    schema = "k int, v string, seq int"
    first = io.write_upsert(spark.createDataFrame([(i, "a", 0) for i in range(200)], schema), path, ["k"], 8)
    before = io.manifest(spark, path, first)
    assert set(before.values()) == {first} and len(before) == 8
    second = io.write_upsert(spark.createDataFrame([(7, "b", 1), (7, "c", 2)], schema), path, ["k"], 8)
    after = io.manifest(spark, path, second)
    assert sorted(after) == sorted(before) and sum(v == second for v in after.values()) == 1
    now = {r.k: r.v for r in io.read_upserted(spark, path, spark.createDataFrame([], schema).schema).collect()}
    assert now == {i: "c" if i == 7 else "a" for i in range(200)}
    old = {r.k: r.v for r in io.read_upserted(spark, path, spark.createDataFrame([], schema).schema, first).collect()}
    assert old[7] == "a" and len(old) == 200
    assert io.write_upsert(spark.createDataFrame([], schema), path, ["k"], 8) == second
    assert io.read_upserted(spark, f"{tmp_path}/none", spark.createDataFrame([], schema).schema).count() == 0


def test_scans_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i * 3 - 50, rnd.choice([None, *range(-9, 9)])) for i in range(300)]
    shuffled = spark.createDataFrame(rnd.sample(rows, len(rows)), "step int, x int").repartition(5)
    placed = ranking.in_ranges(shuffled, "step", 7)
    low = lambda v: min((x for x in v if x is not None), default=None)
    for before in (False, True):
        got = {r.step: (r.n, r.low, r.high) for r in ranking.scan(placed, "step", {"n": (F.lit(1), "sum"), "low": (F.col("x"), "min"), "high": (F.col("x"), "max")}, before).collect()}
        for i, (step, _) in enumerate(rows):
            seen = [x for _, x in rows[: i + (not before)]]
            assert got[step] == (len(seen), low(seen), max((x for x in seen if x is not None), default=None))


@pytest.mark.parametrize("patience", [1, 2, 3, 50])
def test_early_stopping_against_a_loop(spark, patience):
    rnd = random.Random(patience)
    losses = [rnd.choice([1.0, 0.9, 0.8, 0.95]) - i * 0.001 for i in range(120)]
    best, best_step, bad, stop = math.inf, None, 0, None
    for i, x in enumerate(losses):
        if x < best:
            best, best_step, bad = x, i, 0
        else:
            bad += 1
            if bad >= patience:
                stop = i
                break
    found = history.early_stopping(spark.createDataFrame(list(enumerate(losses)), "step int, loss double"), patience)
    assert tuple(found.first()) == (best_step, best, stop)
    # no row passes through one task: what is gathered in one is totals only
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window [" in plan and "windowspecdefinition(step" not in plan


def test_history_of_nothing(spark):
    none = spark.createDataFrame([], "step int, loss double")
    assert tuple(history.early_stopping(none, 2).first()) == (None, None, None)
    assert history.progress_marks(none, "step", 0).count() == 0


def _digest(ids, leaf):
    digits = max(0, math.ceil(math.log(len(ids) / leaf) / math.log(16))) if ids else 0
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    parts = {}
    for i in sorted(ids):
        parts.setdefault(sha(i)[:digits], []).append(i)
    level = {k: sha("\n".join(v)) for k, v in parts.items()}
    while "" not in level:
        up = {}
        for k in sorted(level):
            up.setdefault(k[:-1], []).append(level[k])
        level = {k: sha("\n".join(v)) for k, v in up.items()}
    return level[""]


@pytest.mark.parametrize("leaf", [4096, 100, 10, 1])
def test_digests_of_sets(spark, leaf):
    groups = {"train": [f"q{i}" for i in range(700)], "test": [f"q{i}" for i in range(1000, 1003)]}
    rows = [(s, i) for s, ids in groups.items() for i in ids]
    for parts in (1, 6):
        found = {r.split: (r.n, r.ids_sha256) for r in shares.split_index(spark.createDataFrame(rows, "split string, query_id string").repartition(parts), leaf).collect()}
        assert found == {"train": (700, _digest(groups["train"], leaf)), "test": (3, _digest(groups["test"], leaf)), "calibration": (0, hashlib.sha256(b"").hexdigest())}
    assert shares.rows_fingerprint(spark.createDataFrame([("fit", "b"), ("fit", "a")], "split string, query_id string")).first().n_fit == 2


def _options(spark, n=400, t=3.0, seed=1):
    """Logits that are t times too large, over types with three and two options."""
    rnd = random.Random(seed)
    draw = lambda z: rnd.choices(range(len(z)), [math.exp(x) for x in z])[0]
    rows = []
    for i in range(n):
        a, b = [rnd.gauss(0, 1.5) for _ in range(3)], [rnd.gauss(0, 1.5) for _ in range(2)]
        rows.append((i, "calibration", *(t * x for x in a), draw(a), *b, draw(b)))
    wide = spark.createDataFrame(rows, "query_id int, split string, z0 double, z1 double, z2 double, y int, a0 double, a1 double, ya int")
    return calibration.questions(wide, {"tier": ("choice", ["z0", "z1", "z2"], "y"), "tools": ("noul", ["a0", "a1"], "ya")})


def test_temperatures_of_types(spark):
    rows = _options(spark, 1200)
    got = {r.qtype: r for r in calibration.temperature_by_type(rows).collect()}
    assert got["choice"].temperature == pytest.approx(3.0, rel=0.1) and got["choice"].nll_after < got["choice"].nll_before
    assert 0.8 < got["noul"].temperature < 1.2 and got["noul"].nll_after <= got["noul"].nll_before
    assert (got["score"].n, got["score"].temperature) == (0, 1.0)
    report = {r.qtype: r for r in calibration.report_by_type(rows, calibration.temperature_by_type(rows)).collect()}
    assert report["choice"].n == 1200 and report["choice"].ece_after < report["choice"].ece_before and report["choice"].nll_after == pytest.approx(got["choice"].nll_after)


def test_few_rows_and_clamped_temperatures(spark):
    assert {r.temperature for r in calibration.temperature_by_type(_options(spark, 20)).collect()} == {1.0}
    assert {r.qtype: r.temperature for r in calibration.temperature_by_type(_options(spark, 300, 40.0)).collect()}["choice"] == 5.0


def test_calibration_document(spark):
    rows = _options(spark, 60)
    doc = calibration.calibration_document(rows, calibration.temperature_by_type(rows), "sha", "logits:x").first()
    assert (doc.fitted_on, doc.n_rows, doc.checkpoint_sha256, doc.logits_from) == ("calibration", 60, "sha", "logits:x")
    assert doc.query_ids_sha256 == hashlib.sha256("\n".join(sorted(str(i) for i in range(60))).encode()).hexdigest()
    assert [x.qtype for x in doc.in_sample] == ["choice", "noul"]
    with pytest.raises(ValueError):
        calibration.calibration_document(rows.withColumn("split", F.lit("train")), calibration.temperature_by_type(rows), "sha", "x")


def test_judge_stage(spark):
    pairs = spark.createDataFrame([(1, 0, "q", "a"), (1, 2, "q", "f"), (2, 0, "r", "a"), (2, 2, "r", "f"), (3, 0, "s", "a"), (3, 2, "s", "f")], CALLS)
    answers = spark.createDataFrame([(1, 0, "x"), (1, 2, "y"), (2, 0, "x"), (3, 0, "x"), (3, 2, "z")], "query_id bigint, tier_rank int, completion string")
    from tierwise.operators.judging import judge_prompt

    prompt = spark.range(1).select(judge_prompt(F.lit("q"), F.lit("y"), F.lit("x"))).first()[0]
    judged = spark.createDataFrame([(_sha(prompt, "j"), 5, 10)], "cache_key string, completion_tokens bigint, max_tokens int")
    ledger = spark.createDataFrame([], "model string, completion_tokens bigint, latency_ms double")
    exact = len(prompt) // 4 + 8
    run = lambda known: tuple(costs.judge_stage(pairs, answers, judged, "j", 250, ledger, 100, known).first())
    # with runs, query 2 has no frontier answer; query 1 is judged already
    assert run(True) == (2, 1, 1, exact, 60, 100)
    assert run(False) == (3, 1, 2, exact + 250 + 8 + 800, 120, 200)


def test_pairs_that_may_not_be_judged(spark):
    runs = "query_id int, tier_rank int, error string"
    refs = spark.createDataFrame([(1, 2, None), (2, 1, None), (3, 2, "down")], runs)
    cands = spark.createDataFrame([(1, 0, None), (1, 2, None), (2, 0, "x"), (4, 0, None)], runs)
    found = sorted(tuple(r) for r in labels.pair_violations(spark.createDataFrame([(1,), (2,), (3,)], "query_id int"), refs, cands).collect())
    assert found == [(1, "frontier", "candidate is not cheaper"), (2, "local_small", "candidate failed"), (2, "mid_tier", "reference is not the frontier"), (3, "frontier", "reference failed"), (4, "local_small", "no reference of this query"), (4, "local_small", "no such query")]


def test_publishing_needs_judges(spark):
    runs = spark.createDataFrame([("frontier", "o/big")], "tier string, model string")
    judges = lambda *names: spark.createDataFrame([(n,) for n in names], "judge_model string")
    publishing.check_judges(judges("x/judge", None), runs)
    for wrong in ([], [None], ["x/judge", "p/big"]):
        with pytest.raises(ValueError):
            publishing.check_judges(judges(*wrong), runs)


def test_losses_are_equal_and_orders_replay(spark):
    rows = spark.createDataFrame([(i, i % 2, float(i % 5) - 2, float(i % 7) - 3) for i in range(60)], "query_id int, y int, z0 double, z1 double")
    shown = training.slots(rows, 3, 2)
    slot = training.slot_loss([F.get(F.array("z0", "z1"), F.get("option_order", F.lit(i))) for i in range(2)], F.col("slot"))
    margin = training.margin_loss(F.col("z1"), F.col("z0"), F.col("y"))
    found = shown.select(slot.alias("a"), margin.alias("b"), "slot", "y", "option_order").collect()
    assert all(r.a == pytest.approx(r.b) and r.option_order[r.slot] == r.y for r in found)
    assert {tuple(r.option_order) for r in found} == {(0, 1), (1, 0)}
    order = lambda parts: [(r.epoch, r.place, r.query_id) for r in training.epoch_order(rows.repartition(parts), 5, [1, 2]).orderBy("epoch", "place").collect()]
    one = order(1)
    assert one == order(7) and [x[:2] for x in one] == [(e, p) for e in (1, 2) for p in range(60)]
    assert sorted(x[2] for x in one[:60]) == list(range(60)) and [x[2] for x in one[:60]] != [x[2] for x in one[60:]]


def _exchanges(df):
    """How rows are dealt and which columns they have in every shuffle of a plan; only broadcasts that are asked for."""
    import re

    spark = df.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = df._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.initialPlan()
        if node.nodeName() == "Exchange":
            found.append((node.outputPartitioning().toString(), [x.split("#")[0] for x in re.findall(r"\w+#\d+", node.output().mkString(","))]))
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_judge_estimate_moves_no_text(spark):
    """Prompts are counted before a shuffle, and rows of one model do not meet in one task."""
    runs = [(q, t, f"m{t}", None if q == 3 else "x" * (4 * q), 1, "no" if (q, t) in ((5, 2), (6, 0)) else None) for q in range(1, 8) for t in range(3)]
    runs = spark.createDataFrame(runs, "query_id bigint, tier_rank int, model string, prompt string, completion_tokens bigint, error string")
    ledger = spark.createDataFrame([("m0", 10)] * 3 + [("m2", 30)] * 3 + [("m1", 5)] * 2, "model string, completion_tokens bigint").withColumn("latency_ms", F.lit(1.0))
    found = costs.judge_estimate(runs, 250, "o/judge", ledger, 100)
    # m1 has too few rows of history; query 3 has no prompt, 5 no reference, 6 one candidate
    each = [250 + q + 8 + (10, 400)[t] + 30 for q in (1, 2, 4, 6, 7) for t in range(2) if (q, t) != (6, 0)]
    assert tuple(found.first()) == (11, sum(each), 11 * 60, 1100)
    assert tuple(costs.judge_estimate(runs.limit(0), 250, "o/judge", ledger, 100).first()) == (0, 0, 0, 0)
    # a shuffle by model has a row for each pair of models and task at most
    assert _exchanges(found) and all("prompt" not in columns for _, columns in _exchanges(found))
    assert all("query_id" not in columns for by, columns in _exchanges(found) if "model" in by)


def test_batches_for_python_are_bounded(spark):
    """Timed routes and calls get batches of a thousand rows and a few MB at most, however long the texts and however many."""
    import pyarrow as pa

    from tierwise.operators import latency
    from tierwise.sources.batches import LIMITS

    many = spark.range(0, 20000, 1, 1).select(F.col("id").alias("query_id"), F.expr("if(id < 300, repeat('x', 100000), 'y')").alias("prompt"), F.lit("m").alias("model"))

    def measured(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "size": [b.nbytes]})

    for call in (lambda: latency.timed_routes(many, lambda: lambda text: "mid_tier"), lambda: calls.complete(calls.keyed(many), lambda: lambda prompt, model: {"completion": prompt[:1]})):
        for name, value in (("maxRecordsPerBatch", "10000"), ("maxBytesPerBatch", "64m")):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", value)
        try:
            assert call().count() == 20000
            rows, size = many.mapInArrow(measured, "rows long, size long").agg(F.max("rows"), F.max("size")).first()
            assert rows <= 1000 and size < 8e6
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
            call()
            assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10
        finally:
            for name in LIMITS:
                spark.conf.unset(name)


def test_prompts_are_shuffled_for_calls_to_be_made_only(spark, data):
    """Keys and token counts stand for prompts; those of calls to be made come back in one shuffle that no frequent prompt makes one task."""
    from tierwise.sources.views import view

    answers, runs, ledger = (view(spark, data, name) for name in ("v_answers", "v_runs", "v_ledger"))
    prices = view(spark, data, "v_tiers").select("tier_rank", "p_in", "p_out", (F.col("tier_rank") == 0).alias("local"))
    for found in (answers, costs.estimate(runs, answers, ledger, prices, 4096)):
        assert _exchanges(found) and all(not {"prompt", "text"} & set(columns) for _, columns in _exchanges(found))
    rows = [(1, 0, "a", "m"), (2, 0, "a", "m"), (3, 1, None, "m"), (None, 2, "c", "n"), (5, None, "d", "n"), (6, 0, "e", None)]
    keyed = calls.keyed(spark.createDataFrame(rows, CALLS))
    todo = calls.duplicates(keyed.drop("prompt")).where("not cached")
    back = calls.with_prompts(todo, keyed)
    assert {(r.query_id, r.tier_rank, r.prompt) for r in back.collect()} == {(1, 0, "a"), (3, 1, None), (None, 2, "c"), (5, None, "d")}
    assert len([by for by, columns in _exchanges(back) if "prompt" in columns]) == 1
    assert all("query_id" in by for by, columns in _exchanges(back) if "prompt" in columns)
