"""Line dedup across documents with levelled sorted runs of line hashes.

A line's key is the line without space and U+0009..U+000D at both ends and with A-Z in lower case.
A key of at least ``min_chars`` code points that two or more documents hold stays only in the
smallest doc_id that holds it (there, all its lines stay). Lines are split at \\n.

:class:`LineIndex` keeps a log-structured index in the shared folder: each batch of documents, taken
in ascending doc_id order, is reduced to its distinct keys, merge-anti-joined with the runs, and what
is new becomes a run of level 0. ``fanout`` runs of a level are merged into one of the next level, so
a key is rewritten once a level and a batch meets at most ``fanout`` runs a level. Runs are Parquet
tables, hash-partitioned and sorted by key hash, with the first doc_id of each key; no key is in two
runs. Keys are 128 bits of xxHash64 under two seeds.

Defined cases: a null or empty text is one empty line; a null doc_id holds no keys against others
and loses none; rows that repeat a doc_id are one document for the rule and each is rewritten; keys
shorter than the limit stay; an empty table gives an empty result; other
columns pass through, but for n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_dir, shared_dir, written

MIN_CHARS = 10
#: Code points that are stripped from both ends of a line.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANK)), UPPER, LOWER)


def key_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2) of each line whose key is long enough."""
    lines = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(0x5EED), "key").alias("h2"))


class LineIndex:
    """Runs of (h1, h2, first_doc) in levels; ``add`` batches in ascending doc_id order."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = [[]]

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("h1 long, h2 long, first_doc long").parquet(*paths)

    def _write(self, run: DataFrame) -> str:
        path = shared_dir(self.spark, "line-run")
        run.sortWithinPartitions("h1", "h2").write.parquet(path)
        return path

    def paths(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def runs(self) -> DataFrame:
        """All keys seen so far with the smallest doc_id that holds each."""
        return self._read(self.paths()) if self.paths() else self.spark.createDataFrame([], "h1 long, h2 long, first_doc long")

    def add(self, keys: DataFrame) -> None:
        """Merge-anti-join a batch's (doc_id, h1, h2) with the runs; its new keys become a run."""
        new = keys.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"))
        if self.paths():
            new = new.join(self._read(self.paths()).hint("merge"), ["h1", "h2"], "left_anti")
        self.levels[0].append(self._write(new.select("h1", "h2", "first_doc")))
        level = 0
        while len(self.levels[level]) >= self.fanout:  # the runs of a full level become one of the next
            merged = self._write(self._read(self.levels[level]).repartition("h1", "h2"))
            drop_dir(self.spark, *self.levels[level])
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            level += 1
            self.levels[level].append(merged)


def _drop_lines(texts: pd.Series, drops: pd.Series) -> pd.Series:
    out = []
    for text, drop in zip(texts, drops, strict=True):
        if drop is not None and text is not None:
            gone = set(drop.tolist())
            text = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone)
        out.append(text)
    return pd.Series(out, dtype=object)


def dedup_lines(docs: DataFrame, n_batches: int = 3, fanout: int = 2, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with lines dropped from ``text``, plus ``n_lines`` (before) and ``n_dropped``.

    ``n_batches`` is how many doc_id ranges of about equal size the index takes one after another.
    """
    spark = docs.sparkSession
    cuts = docs.where("doc_id is not null").approxQuantile("doc_id", [i / n_batches for i in range(1, n_batches)], 0.01) if n_batches > 1 else []
    cuts = sorted({int(c) for c in cuts})
    batch = sum((F.when(F.col("doc_id") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    path = shared_dir(spark, "line-keys")
    key_rows(docs, min_chars).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    keys = spark.read.schema("doc_id long, text_hash long, pos int, h1 long, h2 long, batch int").parquet(path)
    index = LineIndex(spark, fanout)
    for b in range(len(cuts) + 1):
        index.add(keys.where(F.col("batch") == b))
    # Both sides are exchanged by key, so that a line that very many documents hold is split by
    # adaptive execution; a row leaves this join only where it is dropped.
    gone = keys.join(index.runs().hint("merge"), ["h1", "h2"]).where("doc_id > first_doc").select("doc_id", "text_hash", "pos")
    # A document's own lines only; the text's hash tells rows apart that share a doc_id.
    drops, _ = written(gone.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("__drop")), "line-drops")
    drop_dir(spark, path, *index.paths())
    drop_udf = F.pandas_udf(_drop_lines, "string")
    # As a struct, the input's columns can't clash with those added here.
    joined = docs.select(F.struct(*docs.columns).alias("row")).join(
        drops.toDF("id", "hash", "gone").hint("merge"), (F.col("row.doc_id") == F.col("id")) & (F.xxhash64("row.text") == F.col("hash")), "left"
    )
    size = F.size(F.split(F.coalesce("row.text", F.lit("")), "\n", -1))
    return joined.select(
        *[drop_udf("row.text", "gone").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")],
        size.cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
