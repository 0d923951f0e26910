"""Declarative rules as tables: edge triggers, counters, conditions, keyword hits, timers and effects.

Rule tables are curated by hand. Conditions are compiled into one projection over the events, keywords are met by number; there is no join by
comparison. Tables that meet events by name are joined plainly, which Spark broadcasts only below its limit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parse import hp_percent
from ..sources.shared import once
from . import conditions
from .folds import folded, keywords_in
from .stats import PULL


def in_order() -> WindowSpec:
    return Window.partitionBy(*PULL).orderBy("line_number")


def hp_below(events: DataFrame, rules: DataFrame) -> DataFrame:
    """First row of each pull in which a target of a rule (cond_id, name, percent) is at or below its percent."""
    hits = events.where("hp_max > 0").join(rules, F.col("target") == F.col("name")).where(hp_percent(F.col("hp_current"), F.col("hp_max")) <= F.col("percent"))
    return hits.groupBy(*PULL, "cond_id").agg(F.min("line_number").alias("line_number"))


def npc_appears(events: DataFrame) -> DataFrame:
    """First row of each pull that an NPC is source or target of."""
    sides = [events.where(f"{s} is not null and not {s}_is_player").select(*PULL, F.col(s).alias("name"), "line_number") for s in ("source", "target")]
    return sides[0].unionByName(sides[1]).groupBy(*PULL, "name").agg(F.min("line_number").alias("first_line"))


def latest_hp(events: DataFrame, name: str, chooser: str | None = None) -> DataFrame:
    """Percent of ``name`` and the target that it (or ``chooser``) last chose, as of each row, in one pass."""
    hp = F.when((F.col("target") == name) & (F.col("hp_max") > 0), hp_percent(F.col("hp_current"), F.col("hp_max")))
    chosen = F.when(F.col("source") == (chooser or name), F.col("target"))
    return events.withColumns({"boss_hp": F.last(hp, True).over(in_order()), "boss_target": F.last(chosen, True).over(in_order())})


def combat_start_timers(events: DataFrame, matches: DataFrame, timers: DataFrame) -> DataFrame:
    """Timers (boss_id, timer_id, duration_ms) that begin with combat, back-dated to the last entry into combat up to the boss's recognition."""
    seen = matches.select(*PULL, "boss_id", "seen_line")
    entry = events.where("is_combat_start").join(seen, PULL).where("line_number <= seen_line").groupBy(*PULL, "boss_id").agg(F.max_by("t_ms", "line_number").alias("start_ms"))
    return entry.join(timers, "boss_id").select(*PULL, "boss_id", "timer_id", "start_ms", (F.col("start_ms") + F.col("duration_ms")).alias("end_ms"))


def counters(events: DataFrame, up: Column, down: Column, reset: Column, initial: int = 0) -> DataFrame:
    """A counter after each row: +1, -1, or back to ``initial`` (which wins); ``changed`` where it moved."""
    reset = F.coalesce(reset, F.lit(False))
    delta = F.when(reset, 0).otherwise(F.coalesce(up, F.lit(False)).cast("long") - F.coalesce(down, F.lit(False)).cast("long"))
    rows = events.withColumns({"era": F.sum(reset.cast("long")).over(in_order()), "delta": delta})
    rows = rows.withColumn("counter", initial + F.sum("delta").over(Window.partitionBy(*PULL, "era").orderBy("line_number")))
    return rows.withColumn("changed", F.col("counter") != F.coalesce(F.lag("counter").over(in_order()), F.lit(initial))).drop("era", "delta")


def counter_reaches(counted: DataFrame, least: int) -> DataFrame:
    """First row of each pull after which its counter is at ``least`` or over, from the rows of :func:`counters`."""
    return counted.where(F.col("counter") >= least).groupBy(*PULL).agg(F.min("line_number").alias("line_number"))


def in_scope(allowed: Column, value: Column) -> Column:
    """An empty list or an unknown value passes."""
    return (F.size(allowed) <= 0) | value.isNull() | F.array_contains(allowed, value)


def scoped(events: DataFrame, rules: DataFrame, allowed: str, value: str) -> DataFrame:
    """Rows with the columns of each rule whose list ``allowed`` admits the row's ``value``; the rule table is compiled, so there is no join."""
    made = []
    for r in _bounded(rules):
        names = list(r[allowed] or [])
        passes = F.col(value).isNull() | F.col(value).isin(names) if names else F.lit(True)
        made.append(F.when(passes, F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in rules.schema if f.name != allowed])))
    return events.withColumn("__rule", F.explode(F.array_compact(F.array(*made)))).select(*events.columns, "__rule.*")


#: Conditions that one call compiles; they are written by hand, a table over this is not a rule table.
MOST_CONDITIONS = 10_000


def _bounded(table: DataFrame, most: int = MOST_CONDITIONS) -> list:
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return rows


def composed(events: DataFrame, tree: DataFrame) -> DataFrame:
    """(pull, line_number, cond_id) of every condition that holds; ``tree``: cond_id, parent_id, type, keyword[, selector, ability_ids].

    Types are those that look at a row alone (see :mod:`conditions`), any_of, all_of and not. Without a selector, ``entity_death`` takes the
    keyword as the name. The rule table is compiled into one projection: no join, one pass. An any_of, all_of or not without children never holds.
    """
    rows = {r.cond_id: r.asDict() for r in _bounded(tree)}
    below: dict = {}
    for r in rows.values():
        below.setdefault(r["parent_id"], []).append(r["cond_id"])

    def condition(i) -> dict:
        r, parts = rows[i], [condition(k) for k in below.get(i, [])]
        selector = r.get("selector") or ([r["keyword"]] if r["type"] == "entity_death" and r["keyword"] else [])
        return {**r, "selector": selector, "conditions": parts, "condition": parts[0] if parts else None}

    met = F.array_compact(F.array(*[F.when(conditions.holds(condition(i)), F.lit(i)) for i in rows]))
    return events.select(*PULL, "line_number", F.explode(met).alias("cond_id"))


def keyword_hits(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows whose ability and effect hold a rule's keyword, with the rule's columns.

    ``rules``: rule_id, keyword, when_applied (true: neither removals, charges nor activations; false: removals; null: any) and what else the caller
    wants to see. Gates, where the rule table has them: only_source, only_target; only_local_player and only_target_is_local_player (``events`` has
    local_player; an unknown one passes); required_boss (boss_id) and required_phases (phase_id). Keywords are looked for once a text, all at a time; a
    row meets the rules that it holds the keywords of by their numbers, and gates compare its columns with the rule's, so the plan is the same for any number of rules.
    """
    c = F.col
    table = _bounded(rules)
    fields = rules.columns
    numbered = rules.sparkSession.createDataFrame([(i, tuple(r)) for i, r in enumerate(table)], T.StructType([T.StructField("__n", T.IntegerType()), T.StructField("__rule", rules.schema)]))
    rule = lambda name: c(f"__rule.{name}")
    removed = F.coalesce(c("is_effect_removed"), F.lit(False)) if "is_effect_removed" in events.columns else F.coalesce(c("effect_type") == "RemoveEffect", F.lit(False))
    charges = F.coalesce(c("effect_type") == "ModifyCharges", F.lit(False))
    gates = [F.when(rule("when_applied").isNull(), True).when(rule("when_applied"), ~removed & ~charges & ~c("is_ability_activate")).otherwise(removed)] if "when_applied" in fields else []
    for side in ("source", "target"):
        if f"only_{side}" in fields:
            gates.append(F.coalesce(rule(f"only_{side}") == "", F.lit(True)) | c(side).eqNullSafe(rule(f"only_{side}")))
    for name, side in (("only_local_player", "source"), ("only_target_is_local_player", "target")):
        if name in fields and "local_player" in events.columns:
            gates.append(~F.coalesce(rule(name), F.lit(False)) | c("local_player").isNull() | c(side).eqNullSafe(c("local_player")))
    if "required_boss" in fields and any(r.required_boss for r in table):
        free = F.coalesce(rule("required_boss") == "", F.lit(True))
        here = c("boss_id").eqNullSafe(rule("required_boss"))
        if "required_phases" in fields and any(r.required_phases for r in table):
            here &= F.coalesce(F.size(rule("required_phases")) <= 0, F.lit(True)) | F.coalesce(F.array_contains(rule("required_phases"), c("phase_id")), F.lit(False))
        gates.append(free | here)
    rows = events.withColumn("__n", F.explode(keywords_in(F.concat_ws(" ", "ability", "effect_name"), [r["keyword"] or "" for r in table])))
    rows = rows.join(numbered, "__n").where(reduce(lambda a, b: a & b, gates, F.lit(True)))
    return rows.select(*events.columns, "__rule.*")


#: Categories whose countdown on a target starts anew with each hit, and those that end with the target's death.
REFRESHED, MORTAL = ("dot", "hot", "cooldown"), ("dot", "hot")


def timer_intervals(hits: DataFrame, events: DataFrame) -> DataFrame:
    """Countdowns from rule hits: a new hit with the same label, category and target, of whichever rule, or the target's death ends the one before.

    Only those of the categories in ``REFRESHED`` start anew (others stack) and only those of ``MORTAL`` end with a death; without a ``category``, all
    do both. Without a ``label``, each rule is its own. The next death of a target is found by one window over its hits and deaths together, not by a
    join of all with all. A countdown with ``repeat_interval_ms`` and ``repeat_count`` goes on as often. ``ended`` is expired, refreshed or died.
    """
    c = F.col
    has = lambda name, otherwise: c(name) if name in hits.columns else otherwise
    every = has("repeat_interval_ms", F.lit(None)).cast("long")
    rows = hits.select(
        *PULL, "rule_id", has("label", c("rule_id").cast("string")).alias("label"), has("category", F.lit("dot")).alias("category"), "target", "line_number", "t_ms", "duration_ms", "warn_ms",
        F.coalesce(has("announce_on_start", F.lit(True)), F.lit(True)).alias("announce_on_start"), every.alias("repeat_interval_ms"),
        F.when(every.isNotNull(), F.coalesce(has("repeat_count", F.lit(0)), F.lit(0))).otherwise(0).cast("long").alias("repeat_count"), F.lit(None).cast("long").alias("died"),
    )
    deaths = events.where("is_death and target is not null").select(*PULL, "target", "t_ms", c("t_ms").cast("long").alias("died"))
    ahead = Window.partitionBy(*PULL, "target").orderBy("t_ms").rangeBetween(0, Window.unboundedFollowing)
    rows = rows.unionByName(deaths, allowMissingColumns=True).withColumn("died_ms", F.first("died", True).over(ahead)).where("died is null")
    next_ms = F.lead("t_ms").over(Window.partitionBy(*PULL, "label", "category", "target").orderBy("t_ms", "line_number", "rule_id"))
    rows = rows.withColumns({
        "next_ms": F.when(c("category").isin(*REFRESHED), next_ms), "died_ms": F.when(c("category").isin(*MORTAL), c("died_ms")),
        "due_ms": c("t_ms") + c("duration_ms") + F.coalesce(c("repeat_interval_ms") * c("repeat_count"), F.lit(0)),
    }).withColumn("end_ms", F.least("due_ms", "next_ms", "died_ms"))
    warn = c("t_ms") + c("duration_ms") - c("warn_ms")
    ended = F.when(c("died_ms") == c("end_ms"), "died").when((c("next_ms") < c("due_ms")) & (c("next_ms") == c("end_ms")), "refreshed").otherwise("expired")
    return rows.select(
        *PULL, "rule_id", "label", "category", "target", "line_number", c("t_ms").alias("start_ms"), "end_ms", F.when(warn < c("end_ms"), warn).alias("warn_at_ms"), ended.alias("ended"),
        "due_ms", "duration_ms", "warn_ms", "announce_on_start", "repeat_interval_ms", "repeat_count",
    )


def announcements(intervals: DataFrame) -> DataFrame:
    """What is called out for countdowns of :func:`timer_intervals` and when: ``what`` is start, repeat, warning or zero, with its text.

    A countdown that names a thing to come isn't called out at its start (``announce_on_start`` is false) but at zero, if it gets there. Each repeat is
    called out as it begins. A warning comes ``warn_ms`` before the end of each round, at once if the round is shorter, and never after the countdown ended.
    """
    c = F.col
    rounds = intervals.withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), "repeat_count")))
    first = c("round") == 0
    length = F.when(first, c("duration_ms")).otherwise(c("repeat_interval_ms"))
    began = c("start_ms") + F.when(first, 0).otherwise(c("duration_ms") + (c("round") - 1) * c("repeat_interval_ms"))
    rounds = rounds.withColumns({"length": length, "began": began})
    warned = F.greatest(c("began") + c("length") - c("warn_ms"), c("began"))
    reached = (c("began") < c("end_ms")) | ((c("began") == c("end_ms")) & (c("ended") == "expired"))

    def call(when: Column, what: str, at: Column, text: Column) -> Column:
        return F.when(when, F.struct(F.lit(what).alias("what"), at.alias("at_ms"), text.alias("text")))

    calls = F.array(
        call(first & c("announce_on_start"), "start", c("began"), c("label")),
        call(~first & reached, "repeat", c("began"), c("label")),
        call((c("warn_ms") > 0) & (warned < c("end_ms")), "warning", warned, F.concat("label", F.when(c("announce_on_start"), " ending").otherwise(" soon"))),
        call((c("round") == c("repeat_count")) & ~c("announce_on_start") & (c("ended") == "expired"), "zero", c("end_ms"), c("label")),
    )
    return rounds.withColumn("call", F.explode(F.array_compact(calls))).select(*PULL, "rule_id", "category", "target", "line_number", "call.what", "call.at_ms", "call.text")


def repeats(rows: DataFrame, count: str, every_ms: str) -> DataFrame:
    """Rows re-armed ``count`` times ``every_ms`` apart: ``fires_ms`` and ``nth``."""
    return rows.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col(count).cast("long")))).withColumn("fires_ms", F.col("start_ms") + F.col("nth") * F.col(every_ms))


def chained(starts: DataFrame, chains: DataFrame) -> DataFrame:
    """Timers started (pull, timer_id, at_ms) and all that they start in turn; ``chains``: timer_id, next_id, delay_ms.

    Chains may be of any length. They are followed to their ends in the rule table, so the starts are read once and meet it in one join by timer. A
    chain that leads back to itself would never end and raises an error; :func:`conditions.boss_script` runs such chains up to a pull's end.
    """
    after: dict = {}
    for r in _bounded(chains):
        after.setdefault(r.timer_id, []).append((r.next_id, r.delay_ms))
    paths: list[tuple] = []
    level = [(t, n, d) for t, more in after.items() for n, d in more]
    for _ in range(len(after) + 1):
        paths += level
        if len(paths) > MOST_CONDITIONS:
            raise ValueError(f"more than {MOST_CONDITIONS} ways along the chains")
        level = [(t, m, d + e) for t, n, d in level for m, e in after.get(n, ())]
        if not level:
            break
    else:
        raise ValueError("a chain of timers leads back to itself")
    # Written, as a timer that is a constant of the plan would leave a join without a key.
    starts = once(starts.select(*PULL, "timer_id", "at_ms"), "starts")
    table = starts.sparkSession.createDataFrame(paths, "timer_id string, next_id string, delay_ms long")
    return starts.unionByName(starts.join(table, "timer_id").select(*PULL, F.col("next_id").alias("timer_id"), (F.col("at_ms") + F.col("delay_ms")).alias("at_ms")))


def uptime(intervals: DataFrame, pulls: DataFrame) -> DataFrame:
    """Share of each pull that a rule's intervals cover on a target; overlaps count once."""
    key = [*PULL, "rule_id", "target"]
    w = Window.partitionBy(*key).orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("end_ms") - F.greatest("start_ms", F.coalesce("reach", F.col("start_ms"))), F.lit(0))
    rows = intervals.withColumn("reach", reach).groupBy(*key).agg(F.sum(new).alias("covered_ms"))
    return rows.join(pulls.select(*PULL, "duration"), PULL).withColumn("uptime_pct", F.least(100 * F.col("covered_ms") / 1000 / F.col("duration"), F.lit(100.0)))


def taunts(events: DataFrame, player: str | None = None, match_ms: int = 1000, together_ms: int = 250, ability: str = "Taunt") -> DataFrame:
    """Resolved taunts: a cast on oneself meets the first effect within ``match_ms`` (else a miss); other effects close together are one AoE taunt."""
    c = F.col
    mine = events.where(c("source_is_player") & (F.lit(player is None) | (c("source") == (player or ""))))
    key = [*PULL, "source"]
    cast = c("is_ability_activate") & (c("ability") == ability) & (c("target") == c("source"))
    effect = (c("effect_type") == "ApplyEffect") & (c("effect_name") == ability) & c("target").isNotNull()
    rows = mine.where(cast | effect).select(*key, "line_number", "t_ms", "target", cast.alias("is_cast"))
    w = Window.partitionBy(*key).orderBy("line_number")
    rows = rows.withColumns({"n_cast": F.sum(c("is_cast").cast("long")).over(w), "cast_ms": F.last(F.when(c("is_cast"), c("t_ms")), True).over(w)})
    near = ~c("is_cast") & F.coalesce(c("t_ms") - c("cast_ms") <= match_ms, F.lit(False))
    first = F.row_number().over(Window.partitionBy(*key, "n_cast", near).orderBy("line_number")) == 1
    rows = rows.withColumn("hit", near & first)
    hits = rows.where("hit").select(*key, "n_cast", c("t_ms").alias("hit_ms"), c("target").alias("hit_target"))
    single = rows.where("is_cast").select(*key, "n_cast", "t_ms").join(hits, [*key, "n_cast"], "left")
    single = single.select(*key, F.coalesce("hit_ms", "t_ms").alias("at_ms"), F.lit("single").alias("kind"), c("hit_target").isNotNull().alias("hit"), F.coalesce("hit_target", F.lit("")).alias("targets"))
    rest = rows.where("not is_cast and not hit")
    apart = F.coalesce(c("t_ms") - F.lag("t_ms").over(w) >= together_ms, F.lit(True)).cast("long")
    aoe = rest.withColumn("apart", apart).withColumn("group", F.sum("apart").over(w)).groupBy(*key, "group").agg(F.max("t_ms").alias("at_ms"), F.array_join(F.array_sort(F.collect_set("target")), ",").alias("targets"))
    return single.unionByName(aoe.select(*key, "at_ms", F.lit("aoe").alias("kind"), F.lit(True).alias("hit"), "targets"))


_EFFECTS = "log_path string, pull_index long, target string, effect string, start_ms long, end_ms long, refreshes long"


class _Intervals:
    """Intervals of the effects on one target, in the order of its rows."""

    def __init__(self, key: tuple):
        self.on: dict = {}  # of each effect: start, end, refreshes

    def row(self, effect, line_number, t_ms, what, duration_ms) -> list[tuple]:
        out, now = [], self.on.get(effect)
        if now and t_ms >= now[1]:
            out.append((effect, *now))
            now = None
        if what == "apply":
            now = (t_ms, t_ms + duration_ms, 0) if now is None else (now[0], t_ms + duration_ms, now[2] + 1)
        elif what == "tick" and now is None:
            now = (t_ms, t_ms + duration_ms, 0)
        elif what == "end" and now:
            out.append((effect, now[0], t_ms, now[2]))
            now = None
        self.on[effect] = now
        return out

    def end(self) -> list[tuple]:
        return [(effect, *now) for effect, now in self.on.items() if now]


def effect_intervals(rows: DataFrame) -> DataFrame:
    """Intervals of effects from sparse ``rows`` (pull, target, effect, line_number, t_ms, what, duration_ms).

    ``what``: apply (starts or refreshes), tick (starts only what is not on), end (removal or the target's death).
    """
    return folded(rows.select(*PULL, "target", "effect", "line_number", "t_ms", "what", "duration_ms"), [*PULL, "target"], ["line_number"], _EFFECTS, _Intervals)


_PHASES = "log_path string, pull_index long, phase string, line_number long, t_ms long"


class _Phases:
    def __init__(self, key: tuple):
        self.now = None

    def row(self, line_number, ord_, t_ms, phase, after) -> list[tuple]:
        if phase == self.now or (after and after != self.now):
            return []
        self.now = phase
        return [(phase, line_number, t_ms)]

    def end(self) -> list[tuple]:
        return []


def phase_changes(triggers: DataFrame) -> DataFrame:
    """Phases entered, from sparse ``triggers`` (pull, line_number, t_ms, ord, phase, after): ``after`` names the phase that must be on."""
    return folded(triggers.select(*PULL, "line_number", "ord", "t_ms", "phase", "after"), list(PULL), ["line_number", "ord"], _PHASES, _Phases)


def expiring(intervals: DataFrame, at_ms: int, within_ms: int | None = None) -> DataFrame:
    """Effects on at ``at_ms``, soonest end first."""
    rows = intervals.where((F.col("start_ms") <= at_ms) & (F.col("end_ms") > at_ms)).withColumn("left_ms", F.col("end_ms") - at_ms)
    return (rows if within_ms is None else rows.where(F.col("left_ms") <= within_ms)).orderBy("left_ms", "target", "effect")


def charges_left(most: Column, remaining: Column, left_ms: Column, duration_ms: Column) -> Column:
    """Time shown for an effect that loses charges: each lost charge takes its share of the duration."""
    lost = F.greatest(most - F.coalesce(remaining, most), F.lit(0))
    return F.greatest(left_ms - duration_ms / most * lost, F.lit(1.0))
