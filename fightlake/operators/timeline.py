"""A pull in time buckets, and rotations between uses of a keyword."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import PULL, exact_sum


def bucket_seconds(duration: Column, scale: float = 1.0) -> Column:
    """Width of a bucket: a ninetieth of the pull, 1 to 20 seconds (times ``scale``)."""
    return F.least(F.greatest(duration / 90, F.lit(1.0 * scale)), F.lit(20.0 * scale))


def timeline(events: DataFrame, pulls: DataFrame, scale: float = 1.0) -> DataFrame:
    """Damage and healing of every player in every bucket of its pull, 0 where there is none."""
    width = bucket_seconds(F.col("duration"), scale)
    grid = pulls.select(*PULL, "start_ms", width.alias("width"), (F.floor(F.col("duration") / width) + 1).alias("n"))
    c = F.col
    players = events.where("source_is_player and source is not null").select(*PULL, c("source").alias("name")).unionByName(events.where("target_is_player and target is not null").select(*PULL, c("target").alias("name"))).distinct()
    cells = players.join(grid, PULL).select(*PULL, "name", F.explode(F.sequence(F.lit(0), (c("n") - 1).cast("int"))).alias("bucket"))
    at = F.least(F.floor((c("t_ms") - c("start_ms")) / 1000 / c("width")), c("n") - 1).cast("int")
    acted = events.where("source is not null and amount > 0 and ((is_damage and ability is not null) or is_heal)").join(grid, PULL).groupBy(*PULL, c("source").alias("name"), at.alias("bucket"))
    sums = acted.agg(exact_sum(F.when(c("is_damage"), c("amount"))).alias("damage"), exact_sum(F.when(c("is_heal"), c("amount"))).alias("healing"))
    return cells.join(sums, [*PULL, "name", "bucket"], "left").na.fill(0.0, ["damage", "healing"])


def slice_(rows: DataFrame, low: int, high: int, seconds: float) -> DataFrame:
    """Totals and rates of each player over buckets ``low`` to ``high``, ``seconds`` long together (at least 1)."""
    sums = rows.where(F.col("bucket").between(low, high)).groupBy(*PULL, "name").agg(exact_sum(F.col("damage")).alias("damage"), exact_sum(F.col("healing")).alias("healing"))
    return sums.withColumns({"dps": F.col("damage") / max(seconds, 1.0), "hps": F.col("healing") / max(seconds, 1.0)})


def rotation_segments(events: DataFrame, keyword: str) -> DataFrame:
    """Half-open stretches between distinct times at which ``keyword`` shows: segment, begin_ms, end_ms."""
    hay = F.lower(F.concat_ws(" ", "ability", "effect_name"))
    times = events.where(hay.contains(keyword.lower())).select(*PULL, F.col("t_ms").alias("begin_ms")).distinct()
    w = Window.partitionBy(*PULL).orderBy("begin_ms")
    return times.withColumns({"end_ms": F.lead("begin_ms").over(w), "segment": F.row_number().over(w)}).where("end_ms is not null")


def _in_segment(events: DataFrame, keyword: str) -> DataFrame:
    """Events with the segment they fall in, by the last boundary so far: no range join."""
    hay = F.lower(F.concat_ws(" ", "ability", "effect_name"))
    w = Window.partitionBy(*PULL).orderBy("t_ms").rangeBetween(Window.unboundedPreceding, 0)
    at = F.when(hay.contains(keyword.lower()), F.col("t_ms"))
    rows = events.withColumn("begin_ms", F.max(at).over(w)).where("begin_ms is not null")
    return rows.join(rotation_segments(events, keyword), [*PULL, "begin_ms"])


def rotation(events: DataFrame, keyword: str) -> DataFrame:
    """Each player's damage rate, effective healing rate, crits and casts in order, in each segment."""
    c = F.col
    attack = c("is_damage") & c("ability").isNotNull()
    rows = _in_segment(events, keyword).where("source_is_player and source is not null")
    seconds = (c("end_ms") - c("begin_ms")) / 1000
    sums = rows.groupBy(*PULL, "segment", "begin_ms", "end_ms", c("source").alias("name")).agg(
        exact_sum(F.when(attack, c("amount"))).alias("damage"), exact_sum(F.when(c("is_heal"), F.greatest(c("amount") - c("overheal"), F.lit(0.0)))).alias("healing"),
        F.count(F.when(attack, 1)).alias("attacks"), F.count(F.when(attack & c("is_critical"), 1)).alias("crits"),
        F.transform(F.array_sort(F.collect_list(F.when(c("is_ability_activate"), F.struct("t_ms", "line_number", "ability")))), lambda x: x["ability"]).alias("casts"),
    )
    return sums.withColumns({"dps": c("damage") / seconds, "ehps": c("healing") / seconds, "crit_pct": F.when(c("attacks") > 0, 100 * c("crits") / c("attacks")).otherwise(0.0), "casts": F.array_join("casts", ",")})


def idle_gaps(events: DataFrame, keyword: str, gcd_ms: int = 1500, alacrity_pct: float = 0.0) -> DataFrame:
    """Gaps of at least the (hastened) global cooldown between a player's activations in a segment."""
    least = gcd_ms / (1 + alacrity_pct / 100) if alacrity_pct > 0 else gcd_ms
    rows = _in_segment(events, keyword).where("is_ability_activate and source_is_player")
    w = Window.partitionBy(*PULL, "segment", "source").orderBy("t_ms", "line_number")
    gaps = rows.withColumn("gap_ms", F.col("t_ms") - F.lag("t_ms").over(w)).where(F.col("gap_ms") >= least)
    return gaps.select(*PULL, "segment", F.col("source").alias("name"), (F.col("t_ms") - 1).alias("at_ms"), "gap_ms")
