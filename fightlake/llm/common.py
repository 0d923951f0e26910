"""Helpers shared by the training-data operators: tables, the shared folder and row iteration."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_dir

#: Rows taken out of an Arrow batch at a time, so that long texts don't pile up as Python objects.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark only (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_dir(spark: SparkSession, *paths: str) -> None:
    """Delete folders made by :func:`fightlake.sources.shared.shared_dir` that no later plan reads."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, which cuts its lineage, and the path."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of the named columns, ``SLICE`` rows in Python at a time."""
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for at in range(0, batch.num_rows, SLICE):
            yield from zip(*(c.slice(at, SLICE).to_pylist() for c in cols), strict=True)


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 1024, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows and about ``max_bytes`` of strings."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if len(held) >= size or weight >= max_bytes:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
