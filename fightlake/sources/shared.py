"""Tables that a plan reads more than once, written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the session's ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{(f'file://{base}' if base.startswith('/') else base).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def once(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table, worked out once; its lineage ends there, so a lost executor costs a read."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
