"""Temperature scaling by a grid search over negative log-likelihoods."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierwise.functions.exprs import BINS, log_sum_exp
from tierwise.operators import metrics as M
from tierwise.operators.labels import only_split
from tierwise.operators.shares import LEAF, set_digests

LOWEST, HIGHEST, LEAST_ROWS = 0.5, 5.0, 30


def nll(columns: Sequence[str], y: Column, temperature: Column) -> Column:
    """Negative log-likelihood of the true class, its probability clipped at 1e-12."""
    z = [F.col(c) / temperature for c in columns]
    own = z[-1]
    for i in range(len(z) - 2, -1, -1):
        own = F.when(y == i, z[i]).otherwise(own)
    return F.least(log_sum_exp(z) - own, F.lit(-1.0) * F.log(F.lit(1e-12)))


def temperature_grid(rows: DataFrame, temperatures: Sequence[float], columns: Sequence[str] = ("z0", "z1", "z2"), by: Sequence[str] = ()) -> DataFrame:
    """by, temperature, nll, n for each temperature of a short constant grid: one pass, one column for each."""
    sums = [F.avg(nll(columns, F.col("y"), F.lit(t))).alias(f"t{i}") for i, t in enumerate(temperatures)]
    wide = rows.groupBy(*by).agg(F.count("*").alias("n"), *sums)
    points = F.explode(F.array(*(F.struct(F.lit(t).alias("temperature"), F.col(f"t{i}").alias("nll")) for i, t in enumerate(temperatures))))
    return wide.select(*by, "n", points.alias("x")).select(*by, "x.temperature", "x.nll", "n")


def best_temperature(grid: DataFrame, by: Sequence[str] = (), least: int = LEAST_ROWS) -> DataFrame:
    """by, temperature, nll, n: the smallest likelihood's, then the smallest; 1 with too few rows."""
    best = grid.groupBy(*by).agg(F.min(F.struct("nll", "temperature")).alias("x"), F.max("n").alias("n"))
    return best.select(*by, F.when(F.col("n") >= least, F.col("x.temperature")).otherwise(1.0).alias("temperature"), F.col("x.nll").alias("nll"), "n")


def fit_temperature(rows: DataFrame, columns: Sequence[str] = ("z0", "z1", "z2"), step: float = 0.01) -> float:
    """The temperature from 0.5 to 5 for calibration rows: a coarse grid, then a fine one around its best point. 1.0 with too few rows."""
    coarse = [LOWEST + 0.1 * i for i in range(round((HIGHEST - LOWEST) / 0.1) + 1)]
    first = best_temperature(temperature_grid(rows, coarse, columns)).first()
    if first is None or first.n < LEAST_ROWS:
        return 1.0
    fine = [min(HIGHEST, max(LOWEST, first.temperature + step * i)) for i in range(-10, 11)]
    return float(best_temperature(temperature_grid(rows, sorted({round(t, 6) for t in [*fine, 1.0]}), columns)).first().temperature)


def report(rows: DataFrame, temperature: float, columns: Sequence[str] = ("z0", "z1", "z2")) -> DataFrame:
    """stage (before, after), n, nll, ece, brier."""
    out = None
    for stage, t in (("before", 1.0), ("after", temperature)):
        p = M.predictions(rows, t, columns)
        line = p.agg(F.lit(stage).alias("stage"), F.count("*").alias("n"), F.avg(nll(columns, F.col("y"), F.lit(t))).alias("nll"))
        line = line.crossJoin(M.ece(p)).crossJoin(M.brier(p))
        out = line if out is None else out.unionByName(line)
    return out


#: Kinds of questions, and the most options that one has.
QUESTION_TYPES, OPTIONS = ["choice", "score", "noul"], ["z0", "z1", "z2"]


def questions(rows: DataFrame, of: Mapping[str, tuple[str, Sequence[str], str]], keep: Sequence[str] = ("query_id", "split")) -> DataFrame:
    """keep, question, qtype, y, z0, z1, z2: a row for each question of each row.

    of maps a question to its type, its columns of logits (up to three; null where a question has fewer options) and its label.
    """
    none = F.lit(None).cast("double")
    each = [F.struct(F.lit(q).alias("question"), F.lit(t).alias("qtype"), F.col(y).cast("int").alias("y"), *((F.col(cols[i]) if i < len(cols) else none).cast("double").alias(z) for i, z in enumerate(OPTIONS))) for q, (t, cols, y) in of.items()]
    return rows.select(*keep, F.explode(F.array(*each)).alias("x")).select(*keep, "x.*")


def bundle(rows: DataFrame, of: Mapping[str, Sequence[str]], checkpoint_sha: str, keep: Sequence[str] = ("query_id", "split")) -> DataFrame:
    """keep, an array of floats for each name of of (name -> its columns of logits), and the hash of the checkpoint they are from: what is stored."""
    arrays = [F.array(*(F.col(c).cast("float") for c in columns)).alias(name) for name, columns in of.items()]
    return rows.select(*keep, *arrays, F.lit(checkpoint_sha).alias("checkpoint_config_sha256"))


def unbundled(stored: DataFrame, of: Mapping[str, Sequence[str]], checkpoint_sha: str) -> DataFrame:
    """stored with the columns of its arrays, in double precision; an error if there are no rows, or any is of another checkpoint or has an array of another length. Runs at once."""
    bad = F.col("checkpoint_config_sha256").isNull() | (F.col("checkpoint_config_sha256") != checkpoint_sha)
    for name, columns in of.items():
        bad = bad | F.coalesce(F.size(name) != len(columns), F.lit(True))
    found = stored.agg(F.count("*").alias("n"), F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("bad")).first()
    if not found.n or found.bad:
        raise ValueError(f"{found.n} rows of logits, {found.bad} of another checkpoint or shape")
    rest = [c for c in stored.columns if c not in (*of, "checkpoint_config_sha256")]
    return stored.select(*rest, *(F.get(name, F.lit(i)).cast("double").alias(c) for name, columns in of.items() for i, c in enumerate(columns)))


def scaled(temperature: Column) -> tuple[Column, list[Column]]:
    """(log of the sum, scaled logits) over the options that a question has."""
    z = [F.col(c) / temperature for c in OPTIONS]
    top = F.greatest(*z)
    return top + F.log(sum((F.coalesce(F.exp(v - top), F.lit(0.0)) for v in z[1:]), F.coalesce(F.exp(z[0] - top), F.lit(0.0)))), z


def option_nll(temperature: Column) -> Column:
    """Negative log-likelihood of a question's label, its probability clipped at 1e-12."""
    total, z = scaled(temperature)
    return F.least(total - F.get(F.array(*z), F.col("y")), F.lit(-1.0) * F.log(F.lit(1e-12)))


def temperature_by_type(rows: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """qtype, n, temperature, nll_before, nll_after of every type, in two passes over questions().

    A coarse grid of tenths for all types at once, then hundredths around each type's best, which come to the rows by a broadcast of three
    rows. Temperatures are within 0.5 and 5; a type with fewer than least rows, or whose best point is no better than 1, has 1.
    """
    low, high = round(LOWEST * 100), round(HIGHEST * 100)
    tenths = range(low, high + 1, 10)

    def best(frame: DataFrame, points: Mapping[str, tuple[Column, Column]], *more: Column) -> DataFrame:
        """The smallest likelihood of each type, then the smallest temperature: points are name -> (hundredths, likelihood)."""
        means = frame.groupBy("qtype").agg(*(F.avg(v).alias(k) for k, (_, v) in points.items()), *(F.max(h).alias(f"h_{k}") for k, (h, _) in points.items()), *more)
        return means.withColumn("top", F.array_min(F.array(*(F.struct(F.round(k, 10).alias("nll"), F.col(f"h_{k}").alias("h")) for k in points)))).drop(*points, *(f"h_{k}" for k in points))

    hundredths = lambda h: h / F.lit(100.0)
    coarse = best(rows, {f"c{h}": (F.lit(h), option_nll(hundredths(F.lit(h)))) for h in tenths}).select("qtype", F.col("top.h").alias("around"))
    near = rows.join(F.broadcast(coarse), "qtype")
    at = {i: F.greatest(F.lit(low), F.least(F.lit(high), F.col("around") + i)) for i in range(-10, 11)}
    one = F.round(F.avg(option_nll(F.lit(1.0))), 10)
    fine = best(near, {f"f{i + 10}": (h, option_nll(hundredths(h))) for i, h in at.items()}, F.count("*").alias("n"), one.alias("nll_before"))
    good = (F.col("n") >= least) & (F.col("top.nll") < F.col("nll_before"))
    names = rows.sparkSession.createDataFrame([(t,) for t in QUESTION_TYPES], "qtype string")
    fitted = fine.select("qtype", "n", F.when(good, F.col("top.h") / 100.0).otherwise(1.0).alias("temperature"), "nll_before", F.when(good, F.col("top.nll")).otherwise(F.col("nll_before")).alias("nll_after"))
    return names.join(fitted, "qtype", "left").select("qtype", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("temperature", F.lit(1.0)).alias("temperature"), "nll_before", "nll_after")


def report_by_type(rows: DataFrame, temperatures: DataFrame, bins: int = BINS) -> DataFrame:
    """qtype, n, and nll, ece and brier before and after, of questions() with each type's temperature (qtype, temperature: a row a type)."""
    both = F.explode(F.array(F.struct(F.lit("before").alias("stage"), F.lit(1.0).alias("t")), F.struct(F.lit("after").alias("stage"), F.col("temperature").alias("t"))))
    staged = rows.join(F.broadcast(temperatures.select("qtype", "temperature")), "qtype").select("qtype", "y", *OPTIONS, both.alias("s")).select("qtype", "y", *OPTIONS, "s.stage", "s.t")
    total, z = scaled(F.col("t"))
    p = [F.exp(v - total) for v in z]
    confidence = F.greatest(*p)
    predicted = F.array_position(F.transform(F.array(*z), lambda v: F.coalesce(v, F.lit(float("-inf")))), F.greatest(*z)) - 1
    brier = sum((F.coalesce(F.pow(v - (F.col("y") == i).cast("double"), 2), F.lit(0.0)) for i, v in enumerate(p)), F.lit(0.0))
    each = staged.select("qtype", "stage", option_nll(F.col("t")).alias("nll"), confidence.alias("confidence"), (predicted == F.col("y")).cast("double").alias("right"), brier.alias("brier"))
    each = each.withColumn("bin", F.greatest(F.ceil(F.col("confidence") * bins), F.lit(1)))
    binned = each.groupBy("qtype", "stage", "bin").agg(F.count("*").alias("n"), F.sum("nll").alias("nll"), F.sum("brier").alias("brier"), F.avg("confidence").alias("c"), F.avg("right").alias("a"))
    mean = lambda x: F.sum(x) / F.sum("n")
    lines = binned.groupBy("qtype", "stage").agg(F.sum("n").alias("n"), mean("nll").alias("nll"), mean(F.col("n") * F.abs(F.col("c") - F.col("a"))).alias("ece"), mean("brier").alias("brier"))
    wide = [F.max(F.when(F.col("stage") == s, F.col(m))).alias(f"{m}_{s}") for s in ("before", "after") for m in ("nll", "ece", "brier")]
    return lines.groupBy("qtype").agg(F.max("n").alias("n"), *wide)


def calibration_document(rows: DataFrame, fitted: DataFrame, checkpoint_sha: str, origin: str, leaf: int = LEAF) -> DataFrame:
    """One row, the document of a calibration with where it comes from: temperatures and in-sample report by type, rows, digest of their ids.

    rows are questions(); an error if any is not a calibration row.
    """
    only_split(rows, "calibration")
    ids = rows.select(F.lit("calibration").alias("fitted_on"), "query_id").distinct()
    lines = report_by_type(rows, fitted).join(fitted.select("qtype", "temperature"), "qtype")
    # a line for each question type
    told = lines.agg(F.sort_array(F.collect_list(F.struct("qtype", "n", "temperature", "nll_before", "nll_after", "ece_before", "ece_after", "brier_before", "brier_after"))).alias("in_sample"))
    named = set_digests(ids, "fitted_on", "query_id", leaf).select("fitted_on", F.col("n").alias("n_rows"), F.col("digest").alias("query_ids_sha256"))
    return named.crossJoin(F.broadcast(told)).withColumn("checkpoint_sha256", F.lit(checkpoint_sha)).withColumn("logits_from", F.lit(origin))


def leaked(train: DataFrame, calibration: DataFrame, key: str = "query_id") -> DataFrame:
    """Ids on both sides."""
    return train.select(key).intersect(calibration.select(key))


def check_disjoint(train: DataFrame, calibration: DataFrame, key: str = "query_id") -> None:
    """An error before any work if a calibration row was trained on."""
    if not leaked(train, calibration, key).isEmpty():
        raise ValueError("calibration rows were trained on")


def check_identity(meta: dict, checkpoint_sha: str) -> float:
    """The temperature of a calibration that was fitted on calibration rows of this checkpoint."""
    if meta.get("fitted_on") != "calibration":
        raise ValueError(f"fitted on {meta.get('fitted_on')}")
    if meta.get("checkpoint_sha256") != checkpoint_sha:
        raise ValueError("calibration is of another checkpoint")
    value = meta["temperature"]
    if not isinstance(value, int | float):
        raise ValueError("one temperature for each option is not supported")
    return min(HIGHEST, max(LOWEST, float(value)))
