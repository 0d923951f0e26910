"""Statistics of each pull and entity. Amounts are summed as decimals, so results don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PULL = ["log_path", "pull_index"]


def exact_sum(x: Column) -> Column:
    return F.coalesce(F.sum(x.cast("decimal(18,2)")), F.lit(0)).cast("double")


def _counted(events: DataFrame) -> DataFrame:
    """Rows that may add something, with what they add: not a pull's first exit, and a death adds nothing else."""
    first_exit = F.min(F.when(F.col("is_combat_end"), F.col("line_number"))).over(Window.partitionBy(*PULL))
    return _with_live(events.withColumn("leaves", F.col("is_combat_end") & (F.col("line_number") == first_exit)))


def _with_live(rows: DataFrame) -> DataFrame:
    live = ~F.col("leaves") & ~(F.col("is_death") & F.col("target").isNotNull())
    return rows.withColumns({"live": live, "attack": live & F.col("is_damage") & F.col("ability").isNotNull(), "heals": live & F.col("is_heal")})


#: What is summed for an entity, and what is counted.
FIELDS = ["damage_done", "damage_taken", "damage_absorbed", "healing_done", "healing_overheal", "threat"]
COUNTS = ["damage_attempts", "damage_avoided", "damage_crits", "heal_casts", "heal_crits", "ability_casts", "times_interrupted", "cc_casts", "raid_buff_casts", "deaths"]


def entity_roles() -> Column:
    """What a row of :func:`_counted` adds to its source and to its target: (name, is_player, makes, FIELDS, COUNTS)."""
    if_ = lambda flag, x: F.when(flag, x)
    c = F.col
    none, zero = F.lit(None).cast("double"), F.lit(0)
    one = lambda flag: F.when(flag, 1).otherwise(0)
    fields, counts = FIELDS, COUNTS
    live = c("live")
    avoided = c("attack") & c("avoidance").isNotNull()
    by_source = [if_(c("attack"), c("amount")), none, none, if_(c("heals"), c("amount")), if_(c("heals") & (c("amount") != 0), c("overheal")), if_(live & c("is_threat_modified"), c("threat_delta"))]
    by_source += [one(c("attack")), one(avoided), one(c("attack") & ~avoided & c("is_critical")), one(c("heals")), one(c("heals") & c("is_critical"))]
    by_source += [one(live & c(f"is_{k}")) for k in ("ability_activate", "interrupted", "hard_cc", "raid_buff_cast")] + [zero]
    by_target = [none, if_(c("attack"), c("amount")), if_(c("attack"), c("shield_absorbed")), none, none, none] + [zero] * 9 + [one(~c("leaves") & c("is_death"))]
    names = fields + counts

    def role(name: str, player: str, values: list[Column], makes: Column) -> Column:
        return F.struct(c(name).alias("name"), c(player).alias("is_player"), makes.alias("makes"), *[v.cast("double" if n in fields else "long").alias(n) for n, v in zip(names, values, strict=True)])

    acts = c("attack") | c("heals") | (live & (c("is_threat_modified") | c("is_ability_activate") | c("is_interrupted") | c("is_hard_cc") | c("is_raid_buff_cast")))
    suffers = (c("attack") & ((c("amount") != 0) | (c("shield_absorbed") != 0))) | (c("is_death") & ~c("leaves"))
    return F.array(role("source", "source_is_player", by_source, acts | c("source_is_player")), role("target", "target_is_player", by_target, suffers | c("target_is_player")))


def entity_changes(events: DataFrame) -> DataFrame:
    """(log_path, line_number, name, is_player, FIELDS in hundredths, COUNTS) of each role, as if no row were a pull's first exit; for streams, which learn that by themselves."""
    rows = _with_live(events.withColumn("leaves", F.lit(False))).select("log_path", "line_number", F.explode(entity_roles()).alias("r")).where("r.name is not null and r.makes")
    whole = lambda n: F.coalesce((F.col(f"r.{n}").cast("decimal(18,2)") * 100).cast("long"), F.lit(0)).alias(n)
    return rows.select("log_path", "line_number", "r.name", F.coalesce("r.is_player", F.lit(False)).alias("is_player"), *[whole(n) for n in FIELDS], *[F.coalesce(f"r.{n}", F.lit(0)).alias(n) for n in COUNTS])


def entity_stats(events: DataFrame) -> DataFrame:
    """Totals of each entity in each pull, from its rows as source and as target, in one aggregation."""
    rows = _counted(events).select(*PULL, F.explode(entity_roles()).alias("r")).select(*PULL, "r.*").where("name is not null and makes")
    return rows.groupBy(*PULL, "name").agg(
        F.max("is_player").alias("is_player"), *[exact_sum(F.col(n)).alias(n) for n in FIELDS], *[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in COUNTS]
    )


def with_rates(stats: DataFrame, pulls: DataFrame) -> DataFrame:
    """Rates by the pull's duration and ratios in percent; 0 where the base is empty."""
    s = stats.join(pulls.select(*PULL, "duration"), PULL)
    per = lambda x: F.when(F.col("duration") > 0, x / F.col("duration")).otherwise(0.0)
    pct = lambda a, b: F.when(b > 0, 100 * a / b).otherwise(0.0)
    c = F.col
    return s.withColumns({
        "dps": per(c("damage_done")), "hps": per(c("healing_done")), "ehps": per(F.greatest(c("healing_done") - c("healing_overheal"), F.lit(0.0))), "dtps": per(c("damage_taken")),
        "tps": per(c("threat")), "apm": per(60.0 * c("ability_casts")), "mitigation_pct": pct(c("damage_absorbed"), c("damage_absorbed") + c("damage_taken")),
        "accuracy_pct": pct(c("damage_attempts") - c("damage_avoided"), c("damage_attempts")), "crit_pct": pct(c("damage_crits"), c("damage_attempts") - c("damage_avoided")), "heal_crit_pct": pct(c("heal_crits"), c("heal_casts")),
    })


def breakdown(events: DataFrame, kind: str = "damage", by: str = "ability") -> DataFrame:
    """Amount and hits of each source by ability or target; ``kind`` is damage or healing."""
    rows = _counted(events).where(F.col("attack" if kind == "damage" else "heals") & (F.col("amount") != 0) & F.col("source").isNotNull())
    if by == "ability":
        rows = rows.withColumn("key", F.coalesce("ability", "effect_name", F.lit("Unknown")))
    else:
        rows = rows.where("target is not null").withColumn("key", F.col("target"))
    return rows.groupBy(*PULL, F.col("source").alias("name"), "key").agg(exact_sum(F.col("amount")).alias("total"), F.count("*").alias("hits"))


def cast_breakdown(events: DataFrame) -> DataFrame:
    """How often each source used each ability to take control (kind cc) or to help all (kind raid_buff)."""
    live = _counted(events).where("live and source is not null")
    kinds = F.array_compact(F.array(F.when(F.col("is_hard_cc"), "cc"), F.when(F.col("is_raid_buff_cast"), "raid_buff")))
    rows = live.select(*PULL, F.col("source").alias("name"), F.explode(kinds).alias("kind"), F.coalesce("ability", "effect_name", F.lit("Unknown")).alias("key"))
    return rows.groupBy(*PULL, "name", "kind", "key").agg(F.count("*").alias("n"))


def with_boss_rate(damage: DataFrame, pulls: DataFrame) -> DataFrame:
    """``damage`` of :func:`target_filtered` with its rate over the pull's duration; 0 where that is empty."""
    rows = damage.join(pulls.select(*PULL, "duration"), PULL)
    return rows.withColumn("boss_dps", F.when(F.col("duration") > 0, F.col("boss_damage") / F.col("duration")).otherwise(0.0)).drop("duration")


def shown(pulls: DataFrame, stats: DataFrame) -> DataFrame:
    """Of each log the last pull with damage or healing, null where it has none: what a display stays on between pulls."""
    some = stats.groupBy(*PULL).agg((F.sum(F.col("damage_done") + F.col("healing_done")) > 0).alias("some"))
    rows = pulls.join(some, PULL, "left")
    return rows.groupBy("log_path").agg(F.max_by("pull_index", F.when(F.col("some"), F.col("start_ms"))).alias("pull_index"))


def top(df: DataFrame, n: int, *groups: str, by: str = "total", tie: str = "key") -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(F.desc(by), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def burst(events: DataFrame, kind: str = "damage", seconds: int = 10) -> DataFrame:
    """Best sum over whole seconds at most ``seconds`` apart, divided by ``seconds``."""
    rows = _counted(events).where(F.col("attack" if kind == "damage" else "heals") & (F.col("amount") != 0) & F.col("source").isNotNull())
    by_second = rows.groupBy(*PULL, F.col("source").alias("name"), F.floor(F.col("t_ms") / 1000).alias("second")).agg(F.sum(F.col("amount").cast("decimal(18,2)")).alias("total"))
    w = Window.partitionBy(*PULL, "name").orderBy("second").rangeBetween(-seconds, 0)
    return by_second.withColumn("run", F.sum("total").over(w)).groupBy(*PULL, "name").agg((F.max("run").cast("double") / seconds).alias("burst"))


def players_only(stats: DataFrame) -> DataFrame:
    """Players, or everyone in a pull without any."""
    some = F.max("is_player").over(Window.partitionBy(*PULL))
    return stats.withColumn("some", some).where("is_player or not some").drop("some")


def leaderboard(stats: DataFrame, measure: str) -> DataFrame:
    """Entities with a positive ``measure``, ranked in their pull, and the pull's total."""
    w = Window.partitionBy(*PULL)
    rows = stats.where(F.col(measure) > 0).select(*PULL, "name", F.col(measure).alias("value"))
    return rows.withColumns({"total": F.sum(F.col("value").cast("decimal(28,6)")).over(w).cast("double"), "rank": F.row_number().over(w.orderBy(F.desc("value"), "name"))})


def target_filtered(events: DataFrame, names: DataFrame) -> DataFrame:
    """Damage of each source to the targets of ``names`` (name) only."""
    rows = _counted(events).where("attack and source is not null").join(names.select(F.col("name").alias("target")).distinct(), "target", "left_semi")
    return rows.groupBy(*PULL, F.col("source").alias("name")).agg(exact_sum(F.col("amount")).alias("boss_damage"))
