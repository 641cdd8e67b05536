"""Shared helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session may do without the setting (it has one machine)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="rulemill-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a cut lineage that keeps column pruning
    and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rulemill/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def dropped(df: DataFrame) -> None:
    """Removes what ``stored`` wrote for ``df``, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches for long texts: by default 10,000 rows go to Python at once, here 1,000 rows or 8 MB. A session that
    has its own setting keeps it."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def released() -> None:
    """Gives a Python worker's free memory back: idle workers stay while others need the executor's memory."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def input_bytes(df: DataFrame) -> int:
    """The size of what ``df`` is read from, by Catalyst's statistics of its leaves (file sizes; no data is read). Where a
    leaf has none (rows that came from the driver) the texts are measured."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if total < 1 << 60:
        return total
    size = F.coalesce(F.octet_length("text"), F.lit(0)) if "text" in df.columns else F.lit(0)
    return int(df.agg(F.coalesce(F.sum(size + 64), F.lit(0))).first()[0])


def tasks_for(df: DataFrame, bytes_each: int, factor: float = 1.0) -> int:
    """A number of partitions that grows with the input, at least the session's shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1_000_000, -(-int(input_bytes(df) * factor) // bytes_each)))


def lower_ascii(col):
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def text_or_empty(col="text"):
    return F.coalesce(F.col(col), F.lit(""))


def words_of(col):
    """Words ``[^\\x20\\x09-\\x0D]+`` as an array; a text without words gives an empty array."""
    inner = F.trim(F.translate(col, "\t\n\x0b\x0c\r", "     "))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, " +"))
