"""The log clock: monotone milliseconds from times of day, and calendar times from file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HALF_DAY, DAY = 43_200_000, 86_400_000
FILE_DATE = r"combat_(\d{4}-\d{2}-\d{2})(?:_(\d{2})_(\d{2})_(\d{2}))?"


def day_ms(timestamp: Column) -> Column:
    """``HH:MM:SS(.mmm)`` in milliseconds of the day, 0 if it is none."""
    part = F.split(timestamp, "[:.]")
    whole = part[0].cast("long") * 3_600_000 + part[1].cast("long") * 60_000 + part[2].cast("long") * 1000
    rest = F.coalesce(F.rpad(F.substr(F.try_element_at(part, F.lit(4)), F.lit(1), F.lit(3)), 3, "0").cast("long"), F.lit(0))
    return F.coalesce(F.when(timestamp.rlike(r"^\d{1,2}:\d{2}:\d{2}(?:\.\d+)?$"), whole + rest), F.lit(0)).cast("long")


def with_clock(events: DataFrame, raw: str = "raw_ms", chunk: int | None = None) -> DataFrame:
    """``t_ms``, never falling within a log: a fall of over half a day in ``raw`` is midnight, a smaller one pins the clock.

    With ``chunk``, logs are cut at every so many line numbers: each stretch is summed by itself, and only a row for each stretch
    meets the others of its log, so one very long log isn't one task's work.
    """
    key = ["log_path"] if chunk is None else ["log_path", "chunk"]
    rows = events if chunk is None else events.withColumn("chunk", F.floor(F.col("line_number") / chunk))
    w = Window.partitionBy(*key).orderBy("line_number")

    def step(now: Column, before: Column) -> Column:
        return F.coalesce(F.when(now >= before, 0).when(before - now > HALF_DAY, DAY).otherwise(before - now), F.lit(0))

    rows = rows.withColumn("step", step(F.col(raw), F.lag(raw).over(w))).withColumn("inside", F.sum("step").over(w)).drop("step")
    if chunk is None:
        return rows.withColumn("t_ms", F.col(raw) + F.col("inside")).drop("inside")
    ends = rows.groupBy(*key).agg(F.min_by(raw, "line_number").alias("first"), F.max_by(raw, "line_number").alias("last"), F.max("inside").alias("total"))
    across = Window.partitionBy("log_path").orderBy("chunk")
    ends = ends.withColumn("edge", step(F.col("first"), F.lag("last").over(across)))
    ends = ends.select(*key, (F.sum(F.col("edge") + F.col("total")).over(across) - F.col("total")).alias("before"))
    return rows.join(ends, key).withColumn("t_ms", F.col(raw) + F.col("inside") + F.col("before")).drop("inside", "before", "chunk")


def with_session_date(df: DataFrame) -> DataFrame:
    """``session_date`` and ``session_time`` from the file's name, null where it has none."""
    part = lambda i: F.nullif(F.regexp_extract("log_path", FILE_DATE, i), F.lit(""))
    return df.withColumns({"session_date": F.try_to_date(part(1)), "session_time": F.concat_ws(":", part(2), part(3), part(4))})


def with_event_time(events: DataFrame) -> DataFrame:
    """``event_time``: midnight of the file's date plus the clock."""
    return with_session_date(events).withColumn("event_time", F.timestamp_millis(F.unix_millis(F.col("session_date").cast("timestamp")) + F.col("t_ms")))


def with_capped_clock(events: DataFrame, wall: str = "wall_ms") -> DataFrame:
    """``at_ms``: the time a line was seen at, which never runs ahead of the log's own clock, so lines that were written late keep their distances.

    From line to line it advances by the lesser of the two gaps, which is the log's clock plus the least lead of ``wall`` so far.
    """
    w = Window.partitionBy("log_path").orderBy("line_number")
    return events.withColumn("at_ms", F.col("t_ms") + F.min(F.col(wall) - F.col("t_ms")).over(w))
