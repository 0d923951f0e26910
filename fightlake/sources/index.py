"""A stored index of a folder of logs: their events by log and line, and which files they are from.

A refresh parses the files that are new or changed, replaces the partitions of their logs only, and then writes the list of files, which is what
commits it: a refresh that is broken off leaves the list as it was, so the next one does its files again. Events lie in one partition a log, sorted by
line, so a slice of a log reads that log's files only, and of these the row groups that hold its lines.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parse
from ..operators import clock
from . import logs

#: Of the parser and of what is stored; another number makes a refresh do all files again.
VERSION = 1
FILES = "name string, size long, modified timestamp, version int, n_lines long, error string"


def read_files(spark: SparkSession, store: str) -> DataFrame:
    """The list of files as the last refresh that ended has left it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/files")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    runs = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
    done = [r for r in runs if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{store}/files/{r}/_SUCCESS"))]
    return spark.read.schema(FILES).parquet(f"{store}/files/{max(done)}") if done else spark.createDataFrame([], FILES)


def _typed(spark: SparkSession, store: str) -> DataFrame:
    """Stored events with ``log_path`` as text, whatever a log's name looks like."""
    found = spark.read.parquet(f"{store}/events")
    fields = [T.StructField(f.name, T.StringType()) if f.name == "log_path" else f for f in found.schema]
    return spark.read.schema(T.StructType(fields)).parquet(f"{store}/events")


def read_events(spark: SparkSession, store: str) -> DataFrame:
    """Events of the logs that the index knows."""
    log = F.regexp_extract("name", r"^(.*?)(?:\.txt)?$", 1)
    return _typed(spark, store).join(read_files(spark, store).where("error is null").select(log.alias("log_path")), "log_path", "left_semi")


def read_slice(spark: SparkSession, store: str, log_path: str, first_line: int, last_line: int) -> DataFrame:
    """Some lines of one log, from that log's files."""
    return _typed(spark, store).where((F.col("log_path") == log_path) & F.col("line_number").between(first_line, last_line))


def refresh(spark: SparkSession, folder: str, store: str, min_bytes: int = logs.MIN_FILE_BYTES, force: bool = False, only: Column | None = None) -> DataFrame:
    """Bring the index of ``folder`` in ``store`` up to date; gives the list of files. ``only`` chooses files (name, size, modified)."""
    known = read_files(spark, store)
    files = logs.file_list(spark, folder, min_bytes)
    files = (files if only is None else files.where(only)).select("path", "name", "size", "modified")
    listed = spark.createDataFrame(files.collect(), files.schema)  # names and sizes, so that all below sees the same files
    changed = logs.changed_files(listed, known, force, VERSION)
    log = F.regexp_extract("name", r"^(.*?)(?:\.txt)?$", 1)
    if not changed.isEmpty():
        lines = logs.read_logs(spark, folder, min_bytes, changed)
        events = clock.with_clock(parse.parse_events(lines).withColumn("raw_ms", clock.day_ms(F.col("timestamp"))), chunk=1 << 18)
        # By ranges, so that a long log is several files and none has to fit in a task.
        placed = events.repartitionByRange("log_path", "line_number").sortWithinPartitions("log_path", "line_number")
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("log_path").parquet(f"{store}/events")
        sizes = _typed(spark, store).groupBy("log_path").agg(F.count("*").alias("n_lines"))
        fresh = changed.withColumn("log_path", log).join(sizes, "log_path", "left").select(
            "name", "size", "modified", F.lit(VERSION).alias("version"), F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.when(F.col("n_lines").isNull(), "no line could be read").alias("error")
        )
    else:
        fresh = spark.createDataFrame([], FILES)
    kept = known.join(changed.select("name"), "name", "left_anti").join(listed.select("name"), "name", "left_semi")
    kept.select(*[c.split()[0] for c in FILES.split(", ")]).unionByName(fresh).coalesce(1).write.parquet(f"{store}/files/run-{time.time_ns():020d}")
    return read_files(spark, store)
