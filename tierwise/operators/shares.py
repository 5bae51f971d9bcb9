"""Distributions, crosstabs with margins, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierwise.tiers import SPLITS, TIERS

#: Ids of a set that is digested flat, and about those of a part of a larger one.
LEAF = 4096


def distribution(rows: DataFrame, column: str, domain: DataFrame) -> DataFrame:
    """column, n, pct over all values of a small domain; absent ones have 0."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    every = domain.join(counts, column, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    # one row for each value of the domain: a window over all of them is as small as the domain
    return every.withColumn("pct", F.round(F.try_divide(100.0 * F.col("n"), F.sum("n").over(Window.partitionBy())), 6))


def crosstab(rows: DataFrame, column: str, by: str = "tier", values: list[str] = TIERS, margin: str = "all") -> DataFrame:
    """column, one count for each value, total; and a row of margins."""
    cells = [F.sum((F.col(by) == v).cast("long")).alias(v) for v in values]
    out = rows.rollup(column).agg(F.grouping(column).alias("__all"), *cells, F.count("*").alias("total"))
    return out.withColumn(column, F.when(F.col("__all") == 1, margin).otherwise(F.col(column))).drop("__all").na.fill(0, values)


def flags(rows: DataFrame, flag: Column, name: str) -> DataFrame:
    """n, the count of a flag, its percentage (null without rows)."""
    out = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(flag.cast("long")), F.lit(0)).alias(name))
    return out.withColumn("pct", F.round(F.try_divide(100.0 * F.col(name), F.col("n")), 6))


def set_digests(rows: DataFrame, by: str, key: str, leaf: int = LEAF) -> DataFrame:
    """by, n, digest of each group's set of ids, which depends on nothing but the set.

    Sets of at most ``leaf`` ids have the flat form: SHA-256 of the sorted ids, one a line. Larger ones are cut by the first hexadecimal
    digits of their ids' hashes, so many that a part has about ``leaf`` ids; parts have flat digests, and up to sixteen
    neighbours at a time are digested, in order, until one is left. No task holds more than a part.
    """
    ids = rows.where(F.col(key).isNotNull()).select(F.col(by).alias("grp"), F.col(key).cast("string").alias("id"))
    sizes = ids.groupBy("grp").agg(F.count("*").alias("n"))
    digits = F.greatest(F.lit(0), F.ceil(F.log(F.col("n") / leaf) / F.log(F.lit(16.0)))).cast("int")
    sizes = sizes.withColumn("digits", digits)
    # one row for each group of a small domain
    marked = ids.join(F.broadcast(sizes.select("grp", "digits")), "grp").withColumn("part", F.substring(F.sha2("id", 256), F.lit(1), F.col("digits")))
    parts = marked.groupBy("grp", "digits", "part").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    level = parts.select("grp", "digits", "part", F.sha2(F.array_join("ids", "\n"), 256).alias("digest"))
    deepest = sizes.agg(F.coalesce(F.max("digits"), F.lit(0)).alias("d")).first().d
    for at in range(deepest, 0, -1):
        up = F.when(F.length("part") == at, F.substring("part", 1, at - 1)).otherwise(F.col("part"))
        several = level.withColumn("up", up).groupBy("grp", "digits", "up").agg(F.sort_array(F.collect_list(F.struct("part", "digest"))).alias("x"), F.max(F.length("part")).alias("len"))
        joined = F.sha2(F.array_join(F.transform("x", lambda x: x["digest"]), "\n"), 256)
        level = several.select("grp", "digits", F.col("up").alias("part"), F.when(F.col("len") == at, joined).otherwise(F.col("x")[0]["digest"]).alias("digest"))
    return level.join(sizes.select("grp", "n"), "grp").select(F.col("grp").alias(by), "n", "digest")


def split_index(examples: DataFrame, leaf: int = LEAF) -> DataFrame:
    """split, n, ids_sha256: all three splits, empty ones too."""
    names = examples.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    found = names.join(set_digests(examples, "split", "query_id", leaf), "split", "left")
    return found.select("split", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ids_sha256"))


def rows_fingerprint(parts: DataFrame, leaf: int = LEAF) -> DataFrame:
    """One row: the digest of what a model is trained on, from rows with split 'fit' or 'holdout' and query_id."""
    found = set_digests(parts, "split", "query_id", leaf)
    of = lambda s: F.coalesce(F.max(F.when(F.col("split") == s, F.col("digest"))), F.sha2(F.lit(""), 256))
    n = lambda s: F.coalesce(F.max(F.when(F.col("split") == s, F.col("n"))), F.lit(0))
    told = found.agg(n("fit").alias("n_fit"), n("holdout").alias("n_holdout"), of("fit").alias("__fit"), of("holdout").alias("__holdout"))
    return told.select("n_fit", "n_holdout", F.sha2(F.format_string('[["%s"], ["%s"]]', "__fit", "__holdout"), 256).alias("rows_sha256"))
