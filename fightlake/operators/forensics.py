"""Deaths: what happened on the victim before each, what killed, and which cooldowns were free."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import PULL, exact_sum, top

WINDOW_MS = 12_000


def death_windows(events: DataFrame, window_ms: int = WINDOW_MS, players_only: bool = True) -> DataFrame:
    """Events on the victim in the time before each death: death_line, death_ms and the event's columns.

    The join is on pull, victim and time bucket (an event meets deaths of its own bucket and the next), so a pull
    with very many deaths and hits compares neighbours in time only.
    """
    c = F.col
    deaths = events.where(c("is_death") & c("target").isNotNull() & (c("target_is_player") | F.lit(not players_only)))
    deaths = deaths.select(*PULL, "target", c("line_number").alias("death_line"), c("t_ms").alias("death_ms"))
    deaths = deaths.withColumn("bucket", F.explode(F.array(F.floor(c("death_ms") / window_ms), F.floor(c("death_ms") / window_ms) - 1)))
    hits = events.where(c("target").isNotNull() & ~c("is_death")).withColumn("bucket", F.floor(c("t_ms") / window_ms))
    joined = hits.join(deaths, [*PULL, "target", "bucket"])
    return joined.where((c("t_ms") >= c("death_ms") - window_ms) & (c("t_ms") <= c("death_ms")) & (c("line_number") < c("death_line"))).drop("bucket")


def damage_before(windows: DataFrame) -> DataFrame:
    """Damage in the windows, environmental damage included."""
    return windows.where(F.col("is_damage") & (F.col("amount") > 0)).withColumns({"key": F.coalesce("ability", "effect_name", F.lit("Unknown")), "by": F.coalesce("source", F.lit("Environment"))})


_DEATH = [*PULL, "target", "death_line"]


def death_report(windows: DataFrame, by: str = "key", n: int = 12) -> DataFrame:
    """Of each death, the ``n`` abilities (``by`` key) or sources (``by`` by) with the most damage."""
    rows = damage_before(windows).groupBy(*_DEATH, F.col(by).alias("key")).agg(exact_sum(F.col("amount")).alias("total"), F.count("*").alias("hits"), F.max("amount").alias("biggest"), F.countDistinct("source").alias("sources"))
    return top(rows, n, *_DEATH)


def killing_blows(windows: DataFrame) -> DataFrame:
    """The last damage before each death."""
    last = F.max(F.struct("line_number", "key", "by", "amount")).alias("m")
    return damage_before(windows).groupBy(*_DEATH).agg(last, exact_sum(F.col("amount")).alias("total")).select(*_DEATH, F.col("m.key").alias("ability"), F.col("m.by").alias("killer"), F.col("m.amount").alias("amount"), "total")


def last_hits(windows: DataFrame, n: int = 40) -> DataFrame:
    w = Window.partitionBy(*_DEATH).orderBy(F.desc("line_number"))
    return damage_before(windows).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def killing_abilities(blows: DataFrame, n: int = 15) -> DataFrame:
    return blows.groupBy("ability").count().orderBy(F.desc("count"), "ability").limit(n)


def mass_deaths(events: DataFrame, least: int = 5, within_ms: int = 15_000) -> DataFrame:
    """Pulls in which at least ``least`` players died within ``within_ms``."""
    rows = events.where("is_death and target_is_player").groupBy(*PULL).agg(F.count("*").alias("deaths"), (F.max("t_ms") - F.min("t_ms")).alias("span_ms"))
    return rows.withColumn("is_wipe", (F.col("deaths") >= least) & (F.col("span_ms") < within_ms))


def cooldown_uses(events: DataFrame, cooldowns: DataFrame, window_ms: int = WINDOW_MS, whole_pull: bool = False) -> DataFrame:
    """For each player death and cooldown (label, keyword, cooldown_ms): the last use by that player and whether it was free.

    A use is an activation whose name holds the keyword. The last use is that before the death; with ``whole_pull``, the last in the pull
    even after it. Deaths and uses meet in one window by player and cooldown, not by a join of all with all; the cooldowns are a table written by
    hand and are compiled into the projection.
    """
    c = F.col
    table = cooldowns.limit(1001).collect()
    if len(table) > 1000:
        raise ValueError("more than 1000 cooldowns")
    kinds = [F.struct(F.lit(r.label).alias("label"), F.lit(r.cooldown_ms).cast(cooldowns.schema["cooldown_ms"].dataType).alias("cooldown_ms"), F.lower(F.lit(r.keyword)).alias("keyword")) for r in table]
    listed = F.array(*kinds)
    used = F.filter(listed, lambda k: F.lower("ability").contains(k["keyword"]))
    none = F.lit(None).cast("long")
    uses = events.where("is_ability_activate and source is not null and ability is not null").withColumn("k", F.explode(used))
    uses = uses.select(*PULL, c("source").alias("target"), c("k.label").alias("label"), c("k.cooldown_ms").alias("cooldown_ms"), c("t_ms").alias("at_ms"), c("t_ms").alias("used"), none.alias("death_line"))
    deaths = events.where("is_death and target_is_player").withColumn("k", F.explode(listed))
    deaths = deaths.select(*PULL, "target", c("k.label").alias("label"), c("k.cooldown_ms").alias("cooldown_ms"), c("t_ms").alias("at_ms"), none.alias("used"), c("line_number").cast("long").alias("death_line"))
    w = Window.partitionBy(*PULL, "target", "label")
    w = w if whole_pull else w.orderBy("at_ms").rangeBetween(Window.unboundedPreceding, 0)
    last = uses.unionByName(deaths).withColumn("used_ms", F.max("used").over(w)).where("death_line is not null and used_ms is not null")
    since = c("at_ms") - c("used_ms")
    return last.select(*_DEATH, c("at_ms").alias("death_ms"), "label", "cooldown_ms", "used_ms", since.alias("since_ms"), (since >= c("cooldown_ms")).alias("available"), (since <= window_ms).alias("used_in_window"))


def hp_samples(events: DataFrame, n: int = 60, window_ms: int = WINDOW_MS) -> DataFrame:
    """The last ``n`` values of the victim's health before each player death, newest first."""
    rows = death_windows(events, window_ms).where("hp_max > 0")
    w = Window.partitionBy(*_DEATH).orderBy(F.desc("line_number"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(*_DEATH, "line_number", "t_ms", "hp_current", "hp_max", "rank")


def victims(deaths: DataFrame) -> DataFrame:
    """How often each player died, from rows of :func:`deaths_of`."""
    return deaths.groupBy(F.col("target").alias("name")).agg(F.count("*").alias("deaths"))


def deaths_of(events: DataFrame) -> DataFrame:
    """(pull, target, death_line, death_ms) of each player death."""
    return events.where("is_death and target_is_player and target is not null").select(*PULL, "target", F.col("line_number").alias("death_line"), F.col("t_ms").alias("death_ms"))
