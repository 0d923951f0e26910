"""Questions over a whole archive: outcomes, bosses, players and trends."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import once
from . import conditions
from .stats import PULL, exact_sum


def first_match(events: DataFrame, bosses: DataFrame, definitions: list[dict] | None = None) -> DataFrame:
    """The boss of each pull: the definition of its first event that matches by npc id (or, without ids, by name).

    ``bosses``: boss_id, boss_name, def_rank, npc_ids, names. They are a small, curated table; Spark sends
    them whole only below its broadcast limit and joins by hash else. ``definitions`` (see :mod:`conditions`) add their ``encounter_trigger``.
    """
    seen = events.select(*PULL, "line_number", F.explode(F.array(F.struct(F.col("source").alias("name"), F.col("source_npc_id").alias("npc")), F.struct(F.col("target").alias("name"), F.col("target_npc_id").alias("npc")))).alias("side")).select(*PULL, "line_number", "side.name", "side.npc")
    least = seen.groupBy(*PULL, "name", "npc").agg(F.min("line_number").alias("line_number"))
    by_id = bosses.where("size(npc_ids) > 0").select("boss_id", "boss_name", "def_rank", F.explode("npc_ids").alias("npc"))
    by_name = bosses.where("size(npc_ids) = 0").select("boss_id", "boss_name", "def_rank", F.explode("names").alias("name"))
    cols = [*PULL, "line_number", "boss_id", "boss_name", "def_rank"]
    hits = least.join(by_id, "npc").select(*cols).unionByName(least.join(by_name, "name").select(*cols))
    armed = [(i, d) for i, d in enumerate(definitions or []) if d.get("encounter_trigger")]
    if armed:
        marks = [F.when(conditions.holds(d["encounter_trigger"]), F.lit(d["id"])) for _, d in armed]
        fired = events.select(*PULL, "line_number", F.explode(F.array_compact(F.array(*marks))).alias("boss_id"))
        hits = hits.unionByName(fired.join(bosses.select("boss_id", "boss_name", "def_rank"), "boss_id").select(*cols))
    return hits.groupBy(*PULL).agg(F.min(F.struct("line_number", "def_rank", "boss_id", "boss_name")).alias("m")).select(*PULL, "m.boss_id", "m.boss_name", F.col("m.line_number").alias("seen_line"))


def outcomes(pulls: DataFrame, events: DataFrame, matches: DataFrame, kill_names: DataFrame, stats: DataFrame) -> DataFrame:
    """Pulls with boss and outcome: unknown, kill (no name of ``kill_names`` (boss_id, name) is left alive), wipe (half the players died) or reset."""
    deaths = events.where("is_death and target is not null").select(*PULL, F.col("target").alias("name"), "line_number")
    owed = matches.join(kill_names, "boss_id")
    left = owed.join(deaths.groupBy(*PULL, "name").agg(F.max("line_number").alias("died")), [*PULL, "name"], "left").groupBy(*PULL).agg(F.max(F.coalesce(F.col("died") < F.col("seen_line"), F.lit(True))).alias("left"))
    beaten = stats.groupBy(*PULL).agg(F.avg(F.when(F.col("is_player"), (F.col("deaths") > 0).cast("double"))).alias("dead"), F.sum(F.when(F.col("is_player"), F.col("deaths")).otherwise(0)).alias("player_deaths"), F.sum(F.when(~F.col("is_player"), F.col("deaths")).otherwise(0)).alias("npc_deaths"), F.count(F.when(~F.col("is_player"), 1)).alias("npc_count"), exact_sum(F.when(~F.col("is_player"), F.col("damage_done"))).alias("npc_damage"))
    rows = pulls.join(matches, PULL, "left").join(left, PULL, "left").join(beaten, PULL, "left")
    outcome = F.when(F.col("boss_id").isNull(), "unknown").when(~F.col("left"), "kill").when(F.col("dead") >= 0.5, "wipe").otherwise("reset")
    return rows.withColumn("outcome", outcome).drop("left", "dead")


def boss_summary(index: DataFrame) -> DataFrame:
    """Of each boss: counts by outcome, times (the median is the upper one), deaths and kill rate."""
    kill = F.col("outcome") == "kill"
    n = lambda what: F.count(F.when(F.col("outcome") == what, 1))
    return index.where("boss_id is not null").groupBy("boss_id", "boss_name").agg(
        F.count("*").alias("pulls"), n("kill").alias("kills"), n("wipe").alias("wipes"), n("reset").alias("resets"),
        F.sum(F.col("duration").cast("decimal(18,3)")).cast("double").alias("total_seconds"), F.sum("player_deaths").cast("long").alias("deaths"), F.max("duration").alias("longest"),
        F.expr("percentile_disc(0.5) within group (order by -duration)").alias("m"),
        F.min(F.when(kill, F.col("duration"))).alias("fastest_kill"), F.max(F.when(kill, F.col("duration"))).alias("slowest_kill"),
        F.min("log_path").alias("first_seen"), F.max("log_path").alias("last_seen"),
    ).withColumns({"median": -F.col("m"), "kill_pct": 100.0 * F.col("kills") / F.col("pulls")}).drop("m")


def players_seen(stats: DataFrame) -> DataFrame:
    rows = stats.where("is_player").groupBy("name").agg(F.count("*").alias("encounters"), exact_sum(F.col("damage_done")).alias("damage"), exact_sum(F.col("healing_done")).alias("healing"), F.sum("deaths").alias("deaths"))
    return rows.withColumn("role", F.when(F.col("healing") > F.col("damage"), "healer").otherwise("damage"))


def trend(rated: DataFrame, measure: str) -> DataFrame:
    """Of each player: slope and intercept of ``measure`` over its pulls in order, and the change of the fitted line in percent."""
    rows = rated.withColumn("i", (F.row_number().over(Window.partitionBy("name").orderBy(*PULL)) - 1).cast("double"))
    y = F.col(measure)
    fit = rows.groupBy("name").agg(F.count("*").alias("n"), F.regr_slope(y, F.col("i")).alias("slope"), F.regr_intercept(y, F.col("i")).alias("intercept"))
    return fit.withColumn("change_pct", F.when(F.col("intercept") > 0, 100 * F.col("slope") * (F.col("n") - 1) / F.col("intercept")))


def rolling_mean(rows: DataFrame, measure: str, key: str, *order: str) -> DataFrame:
    """Mean of ``measure`` from two rows before to four after, cut off at the ends."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-2, 4)
    return rows.withColumn("rolling", F.avg(measure).over(w))


def compare(stats: DataFrame, a: tuple, b: tuple) -> DataFrame:
    """Rates of each player in pull ``a`` and pull ``b`` (log_path, pull_index); missing is 0."""
    side = lambda p, s: stats.where((F.col("log_path") == p[0]) & (F.col("pull_index") == p[1])).select("name", F.col("dps").alias(f"dps_{s}"), F.col("hps").alias(f"hps_{s}"))
    both = side(a, "a").join(side(b, "b"), "name", "full_outer").na.fill(0.0)
    return both.withColumns({"dps_delta": F.col("dps_b") - F.col("dps_a"), "hps_delta": F.col("hps_b") - F.col("hps_a")})


def overview(index: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: sessions, encounters, those with a boss, bosses, first and last log, and players."""
    players = stats.where("is_player").agg(F.countDistinct("name").alias("player_count"))
    counts = index.agg(
        F.countDistinct("log_path").alias("sessions"), F.count("*").alias("encounters"), F.count("boss_id").alias("boss_encounters"),
        F.countDistinct("boss_id").alias("bosses"), F.min("log_path").alias("first_log"), F.max("log_path").alias("last_log"),
    )
    one = F.lit(1).alias("one")
    return counts.select("*", one).join(players.select("*", one), "one").drop("one")


def local_players(events: DataFrame) -> DataFrame:
    """(log_path, area_line, local_player): who last entered an area, else the first player seen as source or target."""
    c = F.col
    area = F.when(c("is_area_entered") & c("source").isNotNull(), c("line_number"))
    seen = F.when(c("source_is_player"), c("source")).when(c("target_is_player"), c("target"))
    first = F.min_by(seen, F.when(seen.isNotNull(), c("line_number")))
    return events.groupBy("log_path").agg(F.max(F.when(c("is_area_entered"), c("line_number"))).alias("area_line"), F.coalesce(F.max_by("source", area), first).alias("local_player"))


def labelled_boss_damage(damage: DataFrame, history: DataFrame, bosses: DataFrame) -> DataFrame:
    """Of each stored pull (log_path, pull_index, label, duration) and source: damage to the names of the definition that its label names, and its rate.

    ``damage``: pull, name, key (target), total. The label is matched with ``boss_name``; of equal ones the first by ``def_rank`` counts.
    """
    first = bosses.groupBy("boss_name").agg(F.min(F.struct("def_rank", "names")).alias("d")).select(F.col("boss_name").alias("label"), F.explode("d.names").alias("key")).distinct()
    owed = history.join(first, "label").select(*PULL, "label", "duration", "key")
    sums = damage.join(owed, [*PULL, "key"]).groupBy(*PULL, "label", "name", "duration").agg(exact_sum(F.col("total")).alias("boss_damage"))
    return sums.withColumn("boss_dps", F.when(F.col("duration") > 0, F.col("boss_damage") / F.col("duration")).otherwise(0.0)).drop("duration")


def lookup(requests: DataFrame, index: DataFrame) -> DataFrame:
    """Requests (request_id, file, start_line, end_line) with the log that the index (file, log_path) knows by that name, and whether they are refused."""
    rows = requests.join(index.select("file", "log_path").dropDuplicates(["file"]), "file", "left")
    return rows.withColumn("refused", F.col("log_path").isNull() | F.col("start_line").isNull() | F.col("end_line").isNull())


def listed(rows: DataFrame, *order, name: str = "place") -> DataFrame:
    """Rows with their place in an order, for a sorted view.

    Rows are dealt out by ranges of the order and numbered in their own range, and each range begins after the rows of those before it; only a count for
    each range is looked at together. Ties in ``order`` get different places in no certain order.
    """
    number = F.monotonically_increasing_id()  # the range in the upper bits, the row's number in it below
    ranged = once(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", number), "listed")
    sizes = ranged.groupBy(F.shiftright("__at", 33).alias("part")).count().orderBy("part").collect()  # a row for each range
    before = dict(zip((r["part"] for r in sizes), accumulate((r["count"] for r in sizes), initial=0), strict=False))
    starts = rows.sparkSession.createDataFrame([(part, n) for part, n in before.items()], "__part long, __before long")
    placed = ranged.withColumn("__part", F.shiftright("__at", 33)).join(starts, "__part", "left")
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.select(*rows.columns, place.cast("int" if sum(r["count"] for r in sizes) < 1 << 31 else "long").alias(name))
