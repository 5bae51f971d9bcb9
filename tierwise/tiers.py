"""Model tiers, cheapest first: the only source of their order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TIERS = ["local_small", "mid_tier", "frontier"]
FRONTIER = len(TIERS) - 1
SPLITS = ["train", "calibration", "test"]
VERDICTS = ["equivalent", "acceptable", "worse"]
SUFFICIENT = VERDICTS[:2]


def tiers(spark: SparkSession) -> DataFrame:
    """tier_rank, tier: one row for each tier."""
    return spark.createDataFrame(list(enumerate(TIERS)), "tier_rank int, tier string")


def tier_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TIERS)), rank.cast("int") + 1)


def tier_rank(name: Column) -> Column:
    """Rank of a tier's name; null for what is no tier."""
    at = F.array_position(F.array(*map(F.lit, TIERS)), name)
    return F.when(at > 0, at.cast("int") - 1)


def parse_tiers(names: str | Sequence[str]) -> list[str]:
    """A subset of tiers in their order; 'all' for every one. Unknown names are an error."""
    wanted = names.split(",") if isinstance(names, str) else list(names)
    wanted = [x.strip() for x in wanted if x.strip()]
    if wanted == ["all"]:
        return list(TIERS)
    if unknown := sorted(set(wanted) - set(TIERS)):
        raise ValueError(f"unknown tiers: {unknown}")
    return [x for x in TIERS if x in wanted]
