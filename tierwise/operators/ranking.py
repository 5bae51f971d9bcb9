"""Running sums over a total order, without bringing all rows to one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def running_sums(rows: DataFrame, order: str, sums: Sequence[str], descending: bool = False, before: bool = False, ranges: int = RANGES) -> DataFrame:
    """rows with running_<x> of each column: the sum over rows up to this one, or only those before it.

    rows must have one row for each value of order. Ranges of about equal size come from an approximate
    quantile (one bounded array); rows are summed within a range, and the totals of the ranges, a bounded
    number of rows, are added up and joined back.
    """
    cuts = rows.agg(F.approx_percentile(order, [i / ranges for i in range(1, ranges)], ranges * 20).alias("__cuts"))
    place = F.size(F.filter(F.coalesce("__cuts", F.array().cast("array<double>")), lambda c: c.cast("double") <= F.col(order).cast("double")))
    placed = rows.crossJoin(F.broadcast(cuts)).withColumn("__range", place).drop("__cuts")
    by = lambda c: F.col(c).desc() if descending else F.col(c).asc()
    inside = Window.partitionBy("__range").orderBy(by(order)).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    totals = placed.groupBy("__range").agg(*(F.sum(x).alias(f"__{x}") for x in sums))
    ahead = Window.partitionBy().orderBy(by("__range")).rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.select("__range", *(F.coalesce(F.sum(f"__{x}").over(ahead), F.lit(0)).alias(f"__{x}") for x in sums))
    out = placed.select("*", *(F.coalesce(F.sum(x).over(inside), F.lit(0)).alias(f"running_{x}") for x in sums)).join(F.broadcast(heads), "__range")
    return out.select(*rows.columns, *((F.col(f"running_{x}") + F.col(f"__{x}")).alias(f"running_{x}") for x in sums))


def in_ranges(rows: DataFrame, order: str, ranges: int = RANGES) -> DataFrame:
    """rows with __range: about equal ranges of a number, in its order, from an approximate quantile (one bounded array)."""
    cuts = rows.agg(F.approx_percentile(order, [i / ranges for i in range(1, ranges)], ranges * 20).alias("__cuts"))
    place = F.size(F.filter(F.coalesce("__cuts", F.array().cast("array<double>")), lambda c: c.cast("double") <= F.col(order).cast("double")))
    return rows.crossJoin(F.broadcast(cuts)).withColumn("__range", place).drop("__cuts")


#: Associative aggregates of a scan: the column function, and how two results (null for none) are put together.
_ASSOCIATIVE = {"sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def scan(placed: DataFrame, order: str, values: Mapping[str, tuple[Column, str]], before: bool = False) -> DataFrame:
    """A prefix scan over in_ranges() rows: name -> (value, 'sum', 'min' or 'max') over all rows up to each, or before it.

    Rows are scanned within their range, each range is summed up in one row, these (one for each range, a bounded number) are
    scanned as an array, and what lies before a range is put together with what lies before a row within it. No window is without a key.
    """
    kinds = {name: _ASSOCIATIVE[kind] for name, (_, kind) in values.items()}
    ends = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    inside = placed.select("*", *(kinds[name][0](value).over(ends).alias(f"__in_{name}") for name, (value, _) in values.items()))
    totals = placed.groupBy("__range").agg(*(kinds[name][0](value).alias(name) for name, (value, _) in values.items()))
    every = totals.agg(F.sort_array(F.collect_list(F.struct("__range", *values))).alias("parts"))

    def ahead(name: str, i: Column) -> Column:
        # i may be 0: nothing lies before the first range
        none = F.lit(None).cast(totals.schema[name].dataType)
        return F.aggregate(F.slice("parts", 1, i), none, lambda a, x: kinds[name][1](a, x[name]).cast(totals.schema[name].dataType)).alias(f"__ahead_{name}")

    heads = every.select(F.explode(F.transform("parts", lambda x, i: F.struct(x["__range"].alias("__range"), *(ahead(n, i) for n in values)))).alias("x")).select("x.*")
    both = inside.join(F.broadcast(heads), "__range")
    return both.select(*placed.columns, *(kinds[n][1](F.col(f"__ahead_{n}"), F.col(f"__in_{n}")).alias(n) for n in values))


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[str], place: Column) -> DataFrame:
    """rows with __rank (from 0, by order) and __size within each group; nulls are a group.

    place numbers ranges that follow the order. Rows are ranked within a range, and the sizes of the ranges before it
    are added by a join, so a group that holds much of the data is as many sorted pieces as it has ranges.
    rows is read twice.
    """
    placed = rows.withColumn("__range", place)
    keys = [*group, "__range"]
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("__n"))
    own = Window.partitionBy(*group)
    upto = F.sum("__n").over(own.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    heads = sizes.select(*(F.col(x).alias(f"__of_{x}") for x in keys), F.coalesce(upto, F.lit(0)).alias("__before"), F.sum("__n").over(own).alias("__size"))
    inside = placed.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    same = F.lit(True)
    for x in keys:
        same = same & F.col(x).eqNullSafe(F.col(f"__of_{x}"))
    return inside.join(heads, same).select(*rows.columns, (F.col("__rank") + F.col("__before")).alias("__rank"), "__size")
