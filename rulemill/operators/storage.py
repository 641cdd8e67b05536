"""Cutting long lineages on storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session may do without the setting (it has one machine)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="rulemill-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet under spark.checkpoint.dir and reads it back. Against a checkpoint, which computes its input
    twice and hands on the constraints of the whole plan (rounds that join their own results then take ever longer to
    plan), a table is computed once, starts a plan of its own and brings its true size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rulemill/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
