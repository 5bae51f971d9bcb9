"""Labels from verdicts, and stratified splits by deterministic hashing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierwise.functions.exprs import cache_key, hash_unit
from tierwise.operators.joins import lookup
from tierwise.operators.ranking import RANGES, ranked
from tierwise.tiers import FRONTIER, SPLITS, SUFFICIENT, TIERS, tier_name

FRACTIONS = (0.7, 0.15, 0.15)

# Fixed values that must equal the reference's, as its results depend on them: patterns that tell from an answer's text that tools or retrieval were needed.
_APOS = "['’]"
_I_CANT = rf"\bI\s*(?:can(?:not|{_APOS}t)|can\s+not|(?:am|{_APOS}m)\s+(?:unable|not\s+able)\s+to|(?:do\s+not|don{_APOS}t)\s+have\s+(?:the\s+)?(?:ability|capability|access)\s+to)\s+"
NEEDS_TOOLS = [
    r"<tool_call>|<function_call>|\"(?:tool_calls|function_call)\"\s*:|```tool_code",
    _I_CANT + rf"(?:run|execute|send|book|schedule|place|interact\s+with|make\s+(?:api|http|network|phone)|access\s+(?:your|local|the\s+user{_APOS}s))\b",
]
NEEDS_RAG = [
    _I_CANT + r"(?:browse|search|look\s+up|retrieve|access\s+(?:the\s+)?(?:internet|web|online|real[-\s]time|current|live|up[-\s]to[-\s]date|external))\b",
    rf"\b(?:do\s+not|don{_APOS}t)\s+have\s+(?:access\s+to\s+)?(?:real[-\s]time|current|up[-\s]to[-\s]date|live|the\s+latest|recent)\s+(?:[\w-]+\s+){{0,2}}(?:information|data|news|prices|updates|events)\b",
    r"\b(?:as\s+of|since)\s+my\s+(?:last\s+)?(?:knowledge|training)\s+(?:cut-?off|update)|\bmy\s+(?:knowledge|training\s+data)\s+(?:cut-?off|only\s+goes|is\s+limited|ends)",
]


def sufficient(verdict: Column) -> Column:
    """Whether a verdict lets the candidate stand in; null for no verdict."""
    return verdict.isin(*SUFFICIENT)


def known_sufficient(rank: Column, verdict: Column) -> Column:
    """Three-valued: the frontier always suffices, a verdict decides, never judged is null."""
    return F.when(rank == FRONTIER, F.lit(True)).otherwise(sufficient(verdict))


def determined(label_rank: Column, judged: Column) -> Column:
    """Every tier cheaper than the label has a verdict; judged is an array of ranks."""
    return F.forall(F.filter(F.array(*(F.lit(i) for i in range(FRONTIER))), lambda r: r < label_rank), lambda r: F.array_contains(judged, r))


def minimum_sufficient(verdicts: DataFrame) -> DataFrame:
    """query_id, label_rank, judged (sorted ranks): the cheapest sufficient tier of each judged query, else the frontier."""
    return verdicts.groupBy("query_id").agg(
        F.coalesce(F.min(F.when(sufficient(F.col("verdict")), F.col("tier_rank"))), F.lit(FRONTIER)).alias("label_rank"),
        F.sort_array(F.collect_set("tier_rank")).alias("judged"),
    )


def violations(verdicts: DataFrame) -> DataFrame:
    """query_id, problem: verdicts on the frontier, against something else, twice for a tier."""
    keyed = verdicts.select(
        "query_id",
        F.when(F.col("reference_tier") != TIERS[FRONTIER], "reference is not the frontier").when(F.col("candidate_tier") == TIERS[FRONTIER], "candidate is the frontier").alias("problem"),
    ).where("problem is not null")
    twice = verdicts.groupBy("query_id", "candidate_tier").agg(F.count("*").alias("n")).where("n > 1").select("query_id", F.lit("tier judged twice").alias("problem"))
    return keyed.unionByName(twice).distinct()


def check_verdicts(verdicts: DataFrame) -> DataFrame:
    """verdicts as they are; an error if any breaks a rule. Runs at once, so that no pruning can skip it."""
    if bad := violations(verdicts).limit(3).collect():
        raise ValueError(f"malformed verdicts: {[(r.query_id, r.problem) for r in bad]}")
    return verdicts


def needs(text: Column) -> tuple[Column, Column]:
    """(needs_tools, needs_rag) from the text of an answer."""
    any_of = lambda patterns: F.coalesce(text.rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))
    return any_of(NEEDS_TOOLS), any_of(NEEDS_RAG)


def stratified_assign(rows: DataFrame, stratum: Sequence[str], key: str, names: Sequence[str], fractions: Sequence[float], seed: int) -> DataFrame:
    """rows with a column split: systematic sampling within each stratum from a hashed start.

    Every stratum meets each fraction within one row. A stratum is ranked in RANGES pieces of the hash, so one that holds
    much of the data is not one task. rows is read twice.
    """
    unit = hash_unit(F.lit(seed), F.lit("query"), F.col(key))
    start = hash_unit(F.lit(seed), F.lit("stratum"), *(F.col(s) for s in stratum))
    found = ranked(rows.withColumn("__unit", unit), stratum, ["__unit", key], F.floor(F.col("__unit") * RANGES).cast("int"))
    placed = found.withColumn("__pos", (F.col("__rank") + start) / F.col("__size")).drop("__rank", "__size")
    split, bound = F.lit(names[-1]), 0.0
    bounds = []
    for f in fractions:
        bound += f
        bounds.append(bound)
    for name, upto in reversed(list(zip(names[:-1], bounds[:-1], strict=True))):
        split = F.when(F.col("__pos") < upto, name).otherwise(split)
    return placed.withColumn("split", split).drop("__unit", "__pos")


def split_rows(rows: DataFrame, stratum: Sequence[str], key: str = "query_id", seed: int = 0) -> DataFrame:
    """70 / 15 / 15 over train, calibration and test."""
    return stratified_assign(rows, stratum, key, SPLITS, FRACTIONS, seed)


def holdout_split(rows: DataFrame, stratum: Sequence[str], fraction: float, key: str = "query_id", seed: int = 0) -> DataFrame:
    """rows with split fit or holdout; an error if either is empty."""
    out = stratified_assign(rows, stratum, key, ["fit", "holdout"], [1 - fraction, fraction], seed)
    if out.select("split").distinct().count() < 2:
        raise ValueError("one side of the holdout split is empty")
    return out


def only_split(rows: DataFrame, name: str) -> DataFrame:
    """rows as they are; an error if any is of another split."""
    if not rows.where(F.col("split") != name).isEmpty():
        raise ValueError(f"rows outside {name}")
    return rows


def last_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row, by order, of each key: last write wins."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(x).desc() for x in order)))
    return rows.withColumn("__turn", turn).where(F.col("__turn") == 1).drop("__turn")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with rows of new in place of those of the same key, and the rest of new; the last of several in new wins by seq."""
    both = old.withColumn("gen", F.lit(0)).unionByName(new.withColumn("gen", F.lit(1)))
    return last_by(both, keys, ["gen", "seq"]).drop("gen")


def reasons(runs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """query_id, source, label_rank, judged, reason of each query: labelled, no frontier answer, or undetermined."""
    ok = runs.where("error is null")
    queries = runs.select("query_id", "source").distinct()
    answered = ok.where(F.col("tier_rank") == FRONTIER).select("query_id", F.lit(True).alias("answered"))
    labels = minimum_sufficient(verdicts)
    joined = queries.join(answered, "query_id", "left").join(labels, "query_id", "left")
    joined = joined.withColumn("label_rank", F.coalesce("label_rank", F.lit(FRONTIER))).withColumn("judged", F.coalesce("judged", F.array().cast("array<int>")))
    reason = F.when(F.col("answered").isNull(), "no frontier").when(~determined(F.col("label_rank"), F.col("judged")), "undetermined").otherwise("labelled")
    return joined.select("query_id", "source", "label_rank", "judged", reason.alias("reason"))


def true_cost(runs: DataFrame, cache: DataFrame) -> DataFrame:
    """query_id, tier_rank, true_cost: a cached answer's recorded cost, else the run's.

    A cache with cache_key is content-addressed and met by the runs' prompt and model, any other by query and tier.
    """
    if "cache_key" in cache.columns:
        keyed = runs.withColumn("cache_key", cache_key(F.coalesce("prompt", F.lit("")), F.col("model"))).select("query_id", "tier_rank", "cache_key", "cost_usd")
        joined = lookup(keyed, cache.select("cache_key", F.col("cost_usd").alias("cached_usd")), ["cache_key"])
    else:
        joined = runs.join(cache.select("query_id", "tier_rank", F.col("cost_usd").alias("cached_usd")), ["query_id", "tier_rank"], "left")
    return joined.select("query_id", "tier_rank", F.coalesce("cached_usd", "cost_usd").alias("true_cost"))


def pair_violations(records: DataFrame, references: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, tier, problem of pairs that a judge must not see: a reference that is not the frontier or failed, a candidate that is not cheaper, failed, or is of no known query.

    references and candidates: query_id, tier_rank, error.
    """
    tier = tier_name(F.col("tier_rank"))
    ref = F.when(F.col("tier_rank") != FRONTIER, "reference is not the frontier").when(F.col("error").isNotNull(), "reference failed")
    own = F.when(F.col("tier_rank") >= FRONTIER, "candidate is not cheaper").when(F.col("error").isNotNull(), "candidate failed")
    bad = references.select("query_id", tier.alias("tier"), ref.alias("problem")).unionByName(candidates.select("query_id", tier.alias("tier"), own.alias("problem"))).where("problem is not null")
    both = lambda side: side.select("query_id", tier.alias("tier"))
    strange = both(candidates).join(records.select("query_id"), "query_id", "left_anti").select("query_id", "tier", F.lit("no such query").alias("problem"))
    alone = both(candidates).join(references.select("query_id"), "query_id", "left_anti").select("query_id", "tier", F.lit("no reference of this query").alias("problem"))
    return bad.unionByName(strange).unionByName(alone)


def build_examples(runs: DataFrame, verdicts: DataFrame, cache: DataFrame, seed: int = 0, needs_of: Callable[[Column], tuple[Column, Column]] = needs, answer: str = "completion") -> DataFrame:
    """Labelled examples: query_id, source, split, tier, needs_tools, needs_rag, judged_tiers, frontier_cost_usd, label_cost_usd."""
    if not runs.groupBy("query_id", "tier_rank").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("several runs of one query and tier; keep the last first")
    labelled = reasons(runs, verdicts).where("reason = 'labelled'")
    costs = true_cost(runs.where("error is null"), cache)
    front = costs.where(F.col("tier_rank") == FRONTIER).select("query_id", F.col("true_cost").alias("frontier_cost_usd"))
    own = costs.select("query_id", F.col("tier_rank").alias("label_rank"), F.col("true_cost").alias("label_cost_usd"))
    texts = runs.where(F.col("tier_rank") == FRONTIER).select("query_id", F.col(answer).alias("__answer"))
    found = labelled.join(front, "query_id", "left").join(own, ["query_id", "label_rank"], "left").join(texts, "query_id", "left")
    tools, rag = needs_of(F.col("__answer"))
    judged = F.transform("judged", tier_name)
    found = found.select("query_id", "source", "label_rank", tier_name(F.col("label_rank")).alias("tier"), tools.alias("needs_tools"), rag.alias("needs_rag"), judged.alias("judged_tiers"), "frontier_cost_usd", "label_cost_usd")
    return split_rows(found, ["tier", "source"], "query_id", seed)
