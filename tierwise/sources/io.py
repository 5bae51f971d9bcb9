"""Readers and sinks: strict schemas, missing files as empty tables, versioned upserts, append-only logs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tierwise.operators.labels import upsert

SCHEMAS = {
    "seed": "query_id string, prompt string, source string, domain string, token_estimate bigint, collected_at timestamp",
    "tier_runs": "query_id string, tier string, model string, completion string, prompt_tokens bigint, completion_tokens bigint, cost_usd double, latency_s double, cached boolean, error string",
    "verdicts": "query_id string, candidate_tier string, reference_tier string, verdict string, reason string, judge_model string",
    "cache": "cache_key string, model string, completion string, prompt_tokens bigint, completion_tokens bigint, cost_usd double, latency_s double, created_at timestamp, max_tokens int",
    "ledger": "ts timestamp, tier string, model string, prompt_tokens bigint, completion_tokens bigint, usd double, latency_ms double",
    "dataset": "query_id string, prompt string, conversation_summary string, source string, split string, tier string, needs_tools boolean, needs_rag boolean, judged_tiers array<string>, frontier_cost_usd double, label_cost_usd double",
    "logits": "query_id string, source string, split string, tier int, needs_tools int, needs_rag int, logits_tier array<float>, logits_tools array<float>, logits_rag array<float>, checkpoint_config_sha256 string",
}
#: Columns that came later, with the value that old rows stand for.
DEFAULTS = {"cache": {"max_tokens": 1024}}


def shared_place(spark: SparkSession) -> str:
    """A new folder that all executors share, under spark.checkpoint.dir. A local one only in a session of one machine; a cluster without a shared folder raises."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tierwise-")
    return f"{base}/tierwise-{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """rows as a table in a new shared folder, read again: what several passes read is worked out once, and lineage ends there."""
    place = shared_place(rows.sparkSession)
    rows.write.option("compression", "zstd").parquet(place)
    return rows.sparkSession.read.schema(rows.schema).parquet(place)


def schema(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_json(spark: SparkSession, path: str, name: str, required: bool = False) -> DataFrame:
    """JSON lines of a known table; blank lines are skipped, a bad line is an error, a missing path is empty unless required."""
    try:
        rows = spark.read.schema(schema(name)).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if required or not _missing(e):
            raise
        return spark.createDataFrame([], schema(name))
    return rows.na.fill(DEFAULTS.get(name, {}))


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(schema(name)).parquet(path)


def head(rows: DataFrame, n: int, position: str = "pos") -> DataFrame:
    """The first n rows by an explicit position: a scan has no order."""
    return rows.orderBy(position).limit(n)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of a dataset written by write_dataset: a partition, so others are not read."""
    return spark.read.parquet(path).where(F.col("split") == split)


def write_dataset(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Appends to a log of JSON lines; written before whatever depends on it."""
    rows.write.mode("append").json(path)


def latest(spark: SparkSession, path: str) -> str | None:
    """The version that a table's pointer names."""
    try:
        rows = spark.read.text(f"{path}/_latest").collect()
    except AnalysisException as e:
        if not _missing(e):
            raise
        return None
    return rows[0].value if rows else None


def manifest(spark: SparkSession, path: str, version: str | None) -> dict[int, str]:
    """bucket -> the version that holds it: at most as many rows as buckets."""
    if version is None:
        return {}
    return {r.bucket: r.version for r in spark.read.schema("bucket int, version string").json(f"{path}/_manifests/{version}").collect()}


def write_upsert(new: DataFrame, path: str, keys: Sequence[str], buckets: int = 32) -> str:
    """Merges rows (with seq) into a table of versions, rewriting only the buckets of keys that have new rows.

    The new files come first, then a manifest that names the version of each bucket, then the pointer to it: a reader sees the old
    table or the new one. Old versions stay readable.
    """
    spark = new.sparkSession
    have = latest(spark, path)
    held = manifest(spark, path, have)
    bucket = F.pmod(F.hash(*keys), F.lit(buckets)).cast("int")
    touched = sorted(r.bucket for r in new.select(bucket.alias("bucket")).distinct().collect())
    if not touched and have is not None:
        return have
    files = [f"{path}/{held[b]}/__bucket={b}" for b in touched if b in held]
    old = spark.read.schema(new.schema).parquet(*files) if files else new.limit(0)
    version = f"v-{uuid.uuid4().hex}"
    upsert(old, new, keys).withColumn("__bucket", bucket).write.partitionBy("__bucket").parquet(f"{path}/{version}")
    named = sorted((held | dict.fromkeys(touched, version)).items())
    spark.createDataFrame(named, "bucket int, version string").coalesce(1).write.json(f"{path}/_manifests/{version}")
    spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_latest")
    return version


def read_upserted(spark: SparkSession, path: str, schema: StructType, version: str | None = None) -> DataFrame:
    """The table as of a version, by default the latest; empty if there is none."""
    held = manifest(spark, path, version or latest(spark, path))
    if not held:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/{v}/__bucket={b}" for b, v in sorted(held.items())))


def write_document(row: DataFrame, path: str) -> None:
    """A result of one row as one JSON document."""
    row.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def export_logits(rows: DataFrame, path: str, text: Sequence[str] = ("prompt", "text", "conversation_summary")) -> None:
    """Logits without any text column: one is an error."""
    if found := [c for c in rows.columns if c in text]:
        raise ValueError(f"text columns in a logits export: {found}")
    rows.write.mode("overwrite").parquet(path)


def stage(public: DataFrame, path: str, card: str, extra: Mapping[str, str] | None = None) -> None:
    """Everything to publish under one path: the dataset, ids of each split, the card; the rebuild note only if text is withheld.

    Ids are sorted through the files of a split in the order of their names: ranges of about equal size, not a task for each split.
    """
    spark = public.sparkSession
    public.write.mode("overwrite").parquet(f"{path}/dataset")
    public.select("split", F.col("query_id").cast("string").alias("value")).repartitionByRange("split", "value").sortWithinPartitions("split", "value").write.mode("overwrite").partitionBy("split").text(f"{path}/splits")
    files = {"card": card, **(extra or {})}
    if public.where("not text_included").isEmpty():
        files.pop("rebuild", None)
    for name, text in files.items():
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
