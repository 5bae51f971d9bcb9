"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WORD = r"[^\x20\x09-\x0D]+"
#: Most rows of an Arrow batch: batches of long texts stay small in the JVM and in its workers. map_arrow() lowers the session's setting to it.
BATCH_ROWS, BATCH = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Keys with more than a HEAVY-th of all rows behind them are at most HEAVY.
HEAVY = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A new local one only in a session of one machine; without a folder a cluster raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    have = spark.sparkContext.getCheckpointDir()
    if have is None:
        if found is None and not spark.sparkContext._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        have = found or tempfile.mkdtemp(prefix="tierwise-checkpoint-")
        spark.sparkContext.setCheckpointDir(have)
    return found or have


def stored(df: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends there, and every executor can read it.

    Its path is added to scratch, for discard().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tierwise-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, scratch: list[str]) -> None:
    """Deletes stored tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while scratch:
        path = jvm.org.apache.hadoop.fs.Path(scratch.pop())
        path.getFileSystem(conf).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names, so that no other column can clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def text_tag(text: str = "text") -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return (F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")) - 2**31).cast("int")


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: StructType | str, rows: int = BATCH_ROWS) -> DataFrame:
    """mapInArrow with a function of one batch; empty batches are passed over, batches of the session get so many rows at most from now on."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH)) <= rows:
        conf.set(BATCH, str(rows))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is None:
                    continue
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def schema_of(df: DataFrame, names: list[str], ddl: str) -> StructType:
    """The named columns of df, then those of a DDL string."""
    return StructType([*(df.schema[x] for x in names), *StructType.fromDDL(ddl).fields])


def looked_up(probes: DataFrame, values: DataFrame, heavy: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """probes with the value of their key, dropped where there is none: heavy ones, at most HEAVY rows, broadcast, the rest by shuffle."""
    keys = list(keys)
    tried = probes.join(F.broadcast(heavy.select(*keys, F.col(value).alias("__heavy"))), keys, "left")
    rest = tried.where("__heavy is null").drop("__heavy").join(values.select(*keys, value), keys)
    return tried.where("__heavy is not null").withColumnRenamed("__heavy", value).select(*rest.columns).unionByName(rest)
