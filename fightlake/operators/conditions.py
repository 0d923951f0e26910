"""Boss definitions at work: conditions, counters, phases and timers of each recognised pull.

The leaves of all conditions (``ability_cast``, ``hp_below``, ...) are data, not plan: batches of rows meet the leaves of their own pull's boss only
(:class:`LeafMatcher`), and rows without a leaf that holds are dropped. What is left of a pull, a few rows, is replayed in order, pull after pull in one
stream a task, as phases, counters and timers depend on each other.

A definition is a dictionary with ``id``, ``boss_names``, ``phases``, ``counters`` and ``timers``; a condition is a dictionary with
``type``. :func:`definitions_of` reads them from the table of :func:`fightlake.sources.logs.read_definitions`.

The replay's rules: counters move before phases, phases before timers. A phase begins by its own trigger; else the active phase must end
by its end trigger, which ``phase_ended`` then tells of. ``hp_below`` and ``counter_reaches`` count once a pull for each place they are
written at, ``npc_appears`` once a pull for each name, wherever that is seen first, and only when the whole gate they stand in passes. A timer expires at its exact time on the log's
clock, and what it starts in turn begins then; ``cancel_trigger`` ends it early and starts nothing. Timers with the trigger
``combat_start`` begin at the last entry into combat before the boss is recognised. Difficulty and group size are those of the last area
entered before a row, in whichever pull (:func:`fightlake.operators.pulls.with_pulls`); an unknown one passes every scope.

Defined cases: pulls without a boss, and bosses without phases, give nothing; null names and abilities match no selector and the empty
keyword only; an unknown condition never holds, nor does an ``any_of``, ``all_of`` or ``not`` without children; a chain of timers without length that
leads back to itself raises an error.
"""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import folded
from .stats import PULL

#: Definitions that one call compiles; they are written by hand, so a table over this isn't one of definitions.
MOST_DEFINITIONS = 2000
#: Timers that may end in one pull between two of its rows; more are a chain without length.
MOST_EXPIRED = 100_000
LOCAL = "local_player"
#: Types that look at a row alone.
ROW_TYPES = ("combat_start", "combat_end", "hp_below", "ability_cast", "effect_applied", "effect_removed", "npc_appears", "entity_death")
#: Types that count once.
ONCE = ("hp_below", "npc_appears", "counter_reaches")
OPERATORS: dict[str, Callable[[float, float], bool]] = {
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gte": lambda a, b: a >= b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "lt": lambda a, b: a < b,
}


def definitions_of(table: DataFrame) -> list[dict]:
    """The definitions of a rule table; conditions stand there as JSON text."""
    rows = table.limit(MOST_DEFINITIONS + 1).collect()
    if len(rows) > MOST_DEFINITIONS:
        raise ValueError(f"more than {MOST_DEFINITIONS} definitions")
    texts = {"encounter_trigger", "start_trigger", "end_trigger", "trigger", "cancel_trigger", "increment_on", "decrement_on", "reset_on"}

    def plain(value, name: str = ""):
        if isinstance(value, dict):
            return {k: plain(v, k) for k, v in value.items()}
        if isinstance(value, list):
            return [plain(json.loads(v) if name == "conditions" else v) for v in value]
        return json.loads(value) if name in texts and value else value

    return [plain(r.asDict(recursive=True)) for r in rows]


def _in(column: Column, names: list[str]) -> Column:
    return column.isin(names) if names else F.lit(False)


def row_condition(cond: dict, boss_names: list[str] | None = None, local_player: Column | None = None) -> Column:
    """Whether a row meets a condition that looks at a row alone (for ``hp_below`` and ``npc_appears``: is at or below, is seen); never null."""
    c, kind, chosen, key = F.col, cond.get("type"), cond.get("selector") or [], (cond.get("keyword") or "").lower()
    own = chosen or list(boss_names or [])
    has_key = lambda text: F.lower(F.coalesce(c(text), F.lit(""))).contains(key)
    anyone = F.lit(True)
    if kind in ("combat_start", "combat_end"):
        out = c(f"is_{kind}")
    elif kind == "hp_below":
        out = _in(c("target"), own) & (F.try_divide("hp_current", "hp_max") * 100 <= float(cond.get("percent") or 0))
    elif kind == "ability_cast":
        ids = [str(i) for i in cond.get("ability_ids") or []]
        out = c("is_ability_activate") & (_in(c("source"), own) if own else anyone) & (_in(c("ability_id"), ids) if ids else has_key("ability"))
    elif kind in ("effect_applied", "effect_removed"):
        gone = F.coalesce(c("is_effect_removed"), F.lit(False))
        out = (gone if kind == "effect_removed" else ~gone) & (_in(c("source"), chosen) if chosen else anyone) & has_key("effect_name")
    elif kind == "npc_appears":
        out = F.coalesce(_in(c("source"), chosen), F.lit(False)) | F.coalesce(_in(c("target"), chosen), F.lit(False))
    elif kind == "entity_death":
        out = c("is_death") & _in(c("target"), chosen)
    else:
        return F.lit(False)
    if cond.get("target") == LOCAL:
        out = out & ((c("target") == local_player) if local_player is not None else F.lit(False))
    return F.coalesce(out, F.lit(False))


def holds(cond: dict, boss_names: list[str] | None = None, local_player: Column | None = None) -> Column:
    """Whether a row meets a tree of such conditions (``any_of``, ``all_of``, ``not``)."""
    if cond.get("type") in ("any_of", "all_of"):
        parts = [holds(p, boss_names, local_player) for p in cond.get("conditions") or []]
        return reduce(lambda a, b: (a | b) if cond["type"] == "any_of" else (a & b), parts) if parts else F.lit(False)
    if cond.get("type") == "not":
        return ~holds(cond["condition"], boss_names, local_player) if cond.get("condition") else F.lit(False)
    return row_condition(cond, boss_names, local_player)


def _leaves(value) -> list[dict]:
    """All conditions that look at a row alone within a definition, in the order they are written."""
    if isinstance(value, list):
        return [x for v in value for x in _leaves(v)]
    if not isinstance(value, dict):
        return []
    own = [value] if value.get("type") in ROW_TYPES else []
    return own + [x for v in value.values() for x in _leaves(v)]


#: What conditions that look at a row alone look at.
_LOOKED_AT = ["source", "target", "hp_current", "hp_max", "ability", "ability_id", "effect_name", "is_combat_start", "is_combat_end", "is_ability_activate", "is_effect_removed", "is_death", "local_player"]


class LeafMatcher:
    """Which leaves of one definition each row of a batch meets; the same rules as :func:`row_condition`, for many definitions without a plan that grows with them."""

    def __init__(self, definition: dict):
        self.leaves, self.boss_names = _leaves(definition), list(definition.get("boss_names") or [])

    def __call__(self, rows: pd.DataFrame) -> list[list[int]]:
        """The numbers of the leaves that hold, ascending, for each row of ``_LOOKED_AT``."""
        texts = {c: pd.factorize(rows[c].fillna("").astype(str).str.lower()) for c in ("ability", "effect_name")}
        flag = {c: rows[c].eq(True).to_numpy(bool) for c in rows.columns if c.startswith("is_")}
        names = {c: rows[c].to_numpy(object) for c in ("source", "target", "ability_id", "local_player")}
        hp, most = (pd.to_numeric(rows[c]).to_numpy(float, na_value=float("nan")) for c in ("hp_current", "hp_max"))

        def among(column: str, wanted: list) -> np.ndarray:
            wanted = set(wanted)
            return np.fromiter((x in wanted for x in names[column]), bool, len(rows)) if wanted else np.zeros(len(rows), bool)

        def holds_key(column: str, key: str) -> np.ndarray:
            codes, known = texts[column]
            return np.fromiter((key in t for t in known), bool, len(known))[codes] if len(known) else np.zeros(len(rows), bool)

        found: list[list[int]] = [[] for _ in range(len(rows))]
        for i, cond in enumerate(self.leaves):
            kind, chosen, key = cond.get("type"), cond.get("selector") or [], (cond.get("keyword") or "").lower()
            own = chosen or self.boss_names
            if kind in ("combat_start", "combat_end"):
                met = flag[f"is_{kind}"]
            elif kind == "hp_below":
                with np.errstate(divide="ignore", invalid="ignore"):
                    met = among("target", own) & (most != 0) & (hp / most * 100 <= float(cond.get("percent") or 0))
            elif kind == "ability_cast":
                ids = [str(x) for x in cond.get("ability_ids") or []]
                met = flag["is_ability_activate"] & (among("source", own) if own else True) & (among("ability_id", ids) if ids else holds_key("ability", key))
            elif kind in ("effect_applied", "effect_removed"):
                gone = flag["is_effect_removed"]
                met = (gone if kind == "effect_removed" else ~gone) & (among("source", chosen) if chosen else True) & holds_key("effect_name", key)
            elif kind == "npc_appears":
                met = among("source", chosen) | among("target", chosen)
            else:
                met = flag["is_death"] & among("target", chosen)
            if cond.get("target") == LOCAL:
                met = met & np.fromiter((a is not None and a == b for a, b in zip(names["target"], names["local_player"], strict=True)), bool, len(rows))
            for at in np.flatnonzero(met):
                found[at].append(i)
        return found


_CANDIDATES = "log_path string, pull_index long, boss_id string, line_number long, t_ms long, source string, target string, hits array<int>, difficulty string, group_size int"


def candidate_rows(events: DataFrame, matches: DataFrame, definitions: list[dict], local_player: DataFrame | None = None) -> DataFrame:
    """Rows of recognised pulls, from the recognition on, with ``hits``: the numbers of their boss's leaves that hold; others are dropped, but those that enter an area."""
    rows = events.join(matches.select(*PULL, "boss_id", "seen_line"), PULL).where("line_number >= seen_line")
    rows = rows.join(local_player.select("log_path", "local_player"), "log_path", "left") if local_player is not None else rows.withColumn("local_player", F.lit(None).cast("string"))
    missing = {c: F.lit(None).cast("boolean" if c.startswith("is_") else "string") for c in _LOOKED_AT if c not in rows.columns}
    scope = [F.col(f"scope_{n}") if f"scope_{n}" in events.columns else F.lit(None) for n in ("difficulty", "group_size")]
    always = (F.col("line_number") == F.col("seen_line")) | F.coalesce("is_area_entered", F.lit(False))
    kept = rows.withColumns(missing).select(*PULL, "boss_id", "line_number", "t_ms", *_LOOKED_AT, scope[0].cast("string").alias("difficulty"), scope[1].cast("int").alias("group_size"), always.alias("always"))
    by_id = {d["id"]: d for d in definitions}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers: dict[str, LeafMatcher] = {}
        for batch in batches:
            looked = batch.select(_LOOKED_AT).to_pandas()
            hits: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for boss, at in pd.Series(np.arange(batch.num_rows)).groupby(batch.column("boss_id").to_pandas(), sort=False):
                if boss in by_id:
                    if boss not in matchers:
                        matchers[boss] = LeafMatcher(by_id[boss])
                    for i, found in zip(at, matchers[boss](looked.iloc[at.to_numpy()]), strict=True):
                        hits[i] = found
            mask = np.fromiter(map(bool, hits), bool, len(hits)) | batch.column("always").to_numpy(zero_copy_only=False).astype(bool)
            out = batch.select([*PULL, "boss_id", "line_number", "t_ms", "source", "target"]).columns + [pa.array(hits, pa.list_(pa.int32()))] + batch.select(["difficulty", "group_size"]).columns
            yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in _CANDIDATES.split(", ")]).filter(pa.array(mask))

    return kept.mapInArrow(run, _CANDIDATES)


class _Replay:
    """Phases, counters and timers of one pull, row by row."""

    def __init__(self, definition: dict):
        self.d, self.difficulty, self.group_size = definition, None, None
        self.number = {id(leaf): i for i, leaf in enumerate(_leaves(definition))}
        self.start = {c["id"]: c.get("initial_value") or 0 for c in definition.get("counters") or []}
        self.counters = dict(self.start)
        self.timers = definition.get("timers") or []
        self.phases = definition.get("phases") or []
        self.phase: str | None = None
        self.fired: set = set()
        self.active: list[dict] = []
        self.out: list[tuple] = []
        self.fresh: set = set()  # timers that began now, whose followers have yet to be looked at
        self._event(None, None)

    def _event(self, row, t) -> None:
        self.row, self.t = row, t
        self.hits = set() if row is None else set(row.hits)
        self.ended, self.entered, self.changed, self.expired, self.started = set(), set(), set(), set(), set()

    def met(self, cond: dict | None, used: list) -> bool:
        """Whether a condition holds now; what must count once is noted in ``used``."""
        if not cond:
            return False
        kind, parts = cond.get("type"), cond.get("conditions") or []
        if kind == "any_of":
            return any(self.met(c, used) for c in parts)
        if kind == "all_of":
            return bool(parts) and all(self.met(c, used) for c in parts)
        if kind == "not":
            return bool(cond.get("condition")) and not self.met(cond["condition"], [])
        value, now = cond.get("value") or 0, self.counters.get(cond.get("counter_id"), 0)
        if kind in ONCE:
            there = now >= value if kind == "counter_reaches" else self.number[id(cond)] in self.hits
            keys = [("seen", n) for n in (self.row.source, self.row.target) if n in (cond.get("selector") or [])] if kind == "npc_appears" and there else [(id(cond), None)]
            fresh = [k for k in keys if k not in self.fired]
            used += fresh[:1]
            return there and bool(fresh)
        if kind in ROW_TYPES:
            return self.number[id(cond)] in self.hits
        if kind == "counter_compare":
            return cond.get("operator", "eq") in OPERATORS and OPERATORS[cond.get("operator") or "eq"](now, value)
        if kind == "counter_changes":
            return cond.get("counter_id") in self.changed
        if kind == "timer_time_remaining":
            left = [(t["end"] - self.t) / 1000 for t in self.active if t["id"] == cond.get("timer_id")]
            return bool(left) and OPERATORS.get(cond.get("operator") or "gte", lambda a, b: False)(max(left), value)
        seen = {"phase_ended": self.ended, "phase_entered": self.entered, "timer_expires": self.expired, "timer_started": self.started}
        if kind in seen:
            return cond.get("timer_id" if kind.startswith("timer") else "phase_id") in seen[kind]
        if kind == "phase_active":
            return self.phase in (cond.get("phase_ids") or [])
        return kind == "any_phase_change" and bool(self.ended or self.entered)

    def passes(self, trigger: dict | None, others: list[dict] | None) -> bool:
        used: list = []
        if not all(self.met(c, used) for c in [trigger, *(others or [])]):
            return False
        self.fired.update(used)
        return True

    def in_scope(self, thing: dict) -> bool:
        ok = lambda allowed, value: not allowed or value is None or value in allowed
        return ok(thing.get("difficulties"), self.difficulty) and ok(thing.get("group_sizes"), self.group_size)

    def emit(self, what: str, id_: str | None, start: int, end: int | None = None, ended: str | None = None, label: str | None = None, target: str | None = None, value: float | None = None) -> None:
        line = None if self.row is None else self.row.line_number
        self.out.append((what, id_, label, target, line, start, end, ended, value))

    def count(self) -> None:
        for c in self.d.get("counters") or []:
            before = self.counters[c["id"]]
            if self.passes(c.get("reset_on"), None):
                self.counters[c["id"]] = self.start[c["id"]]
            else:
                self.counters[c["id"]] += self.passes(c.get("increment_on"), None)
                self.counters[c["id"]] -= self.passes(c.get("decrement_on"), None)
            if self.counters[c["id"]] != before:
                self.changed.add(c["id"])
                self.emit("counter", c["id"], self.t, value=float(self.counters[c["id"]]))

    def move(self) -> None:
        old = next((p for p in self.phases if p["id"] == self.phase), None)
        for again in (False, True):
            if again:
                if not (old and self.passes(old.get("end_trigger"), None)):
                    return
                self.ended.add(self.phase)
            for p in self.phases:
                if p["id"] != self.phase and p.get("start_trigger") and self.in_scope(p) and self.passes(p["start_trigger"], p.get("conditions")):
                    self.ended.add(self.phase)
                    self.enter(p)
                    return

    def enter(self, phase: dict) -> None:
        self.phase = phase["id"]
        self.entered.add(phase["id"])
        self.emit("phase", phase["id"], self.t, label=phase.get("name"))

    def begin(self, timer: dict, at: int, aims: bool = True) -> None:
        length, every, times = round(1000 * (timer.get("duration_seconds") or 0)), timer.get("repeat_interval_seconds"), timer.get("repeat_count") or 0
        end = at + length + (round(1000 * every) * times if every is not None else 0)
        target = self.row.target if aims and timer.get("announce_target") and self.row is not None else None
        same = next((a for a in self.active if target is not None and a["timer"] is timer and a["target"] == target), None)
        if same:
            self.stop(same, at, "refreshed")
        else:
            self.fresh.add(timer.get("id"))
        self.active.append({"id": timer.get("id"), "timer": timer, "start": at, "end": end, "target": target, "row": self.row})

    def stop(self, run: dict, at: int, how: str) -> None:
        self.active.remove(run)
        row, self.row = self.row, run["row"]
        label = run["timer"].get("label")
        self.emit("timer", run["id"], run["start"], at, how, f"{label}: {run['target']}" if run["target"] else label, run["target"])
        self.row = row

    def time(self) -> None:
        for timer in self.timers:
            if timer.get("id") and timer.get("cancel_trigger") and self.passes(timer["cancel_trigger"], None):
                for run in [a for a in self.active if a["id"] == timer["id"]]:
                    self.stop(run, self.t, "cancelled")
            trigger = timer.get("trigger")
            inside = not timer.get("phases") or self.phase in timer["phases"]
            if trigger and trigger.get("type") != "combat_start" and inside and self.in_scope(timer) and self.passes(trigger, timer.get("conditions")):
                self.begin(timer, self.t)

    def settle(self) -> None:
        self.count()
        self.move()
        self.time()
        self.follow()

    def follow(self) -> None:
        """What timers that began just now start in turn, at the same time."""
        for _ in range(len(self.timers) + 1):
            known, self.fresh = self.fresh - {None}, set()
            if not known:
                return
            self._event(None, self.t)
            self.started = known
            self.move()
            self.time()
        raise ValueError(f"timers of {self.d['id']} start each other without end")

    def expire(self, until: int) -> None:
        """Timers that end by ``until``, in order, with what they start."""
        for _ in range(MOST_EXPIRED):
            due = min((a for a in self.active if a["end"] <= until), key=lambda a: a["end"], default=None)
            if due is None:
                return
            before = due["end"]
            self.stop(due, before, "expired")
            self._event(None, before)
            self.expired = {due["id"]} - {None}
            self.settle()
        raise ValueError(f"timers of {self.d['id']} start each other without end")

    def run(self, rows: list, entered_ms: int | None, end_ms: int) -> list[tuple]:
        for i, row in enumerate(rows):
            self.expire(row.t_ms)
            self.difficulty, self.group_size = row.difficulty, row.group_size
            self._event(row, row.t_ms)
            if i:
                if self.hits:
                    self.settle()
                continue
            self.enter(self.phases[0])
            self.count()
            self.time()
            for timer in self.timers if entered_ms is not None else []:
                inside = not timer.get("phases") or self.phase in timer["phases"]
                if (timer.get("trigger") or {}).get("type") == "combat_start" and inside and self.in_scope(timer) and all(self.met(c, []) for c in timer.get("conditions") or []):
                    self.begin(timer, entered_ms, aims=False)
            self.follow()
        self.expire(end_ms)
        for run in list(self.active):
            self.stop(run, end_ms, "pull ended")
        return self.out


SCRIPT = "log_path string, pull_index long, boss_id string, what string, id string, label string, target string, line_number long, start_ms long, end_ms long, ended string, value double"


def boss_script(events: DataFrame, matches: DataFrame, definitions: list[dict], local_player: DataFrame | None = None) -> DataFrame:
    """What happens in each recognised pull, one row each: ``what`` is phase (entered), counter (changed, to ``value``) or timer (from ``start_ms`` to ``end_ms``).

    ``matches`` is the table of :func:`fightlake.operators.corpus.first_match`. A timer is ``ended`` by: expired, cancelled, refreshed, pull ended.
    ``scope_difficulty`` and ``scope_group_size`` scope phases and timers as of each row, where ``events`` has these columns.
    """
    by_id = {d["id"]: d for d in definitions if d.get("phases")}
    known = matches.where(F.col("boss_id").isin(list(by_id))).select(*PULL, "boss_id", "seen_line")
    entry = F.when(F.col("is_combat_start") & (F.col("line_number") <= F.col("seen_line")), F.col("line_number"))
    frame = events.join(known, PULL).groupBy(*PULL).agg(F.max_by("t_ms", entry).alias("entered_ms"), F.max("t_ms").alias("last_ms"))
    rows = candidate_rows(events, known, list(by_id.values()), local_player).join(frame, PULL)
    fields = ["boss_id", "line_number", "t_ms", "source", "target", "hits", "difficulty", "group_size", "entered_ms", "last_ms"]
    one = namedtuple("one", fields)

    class Played:
        """The few rows of one pull, replayed when all are there."""

        def __init__(self, key: tuple):
            self.rows: list = []

        def row(self, *values) -> list[tuple]:
            self.rows.append(one(*values))
            return []

        def end(self) -> list[tuple]:
            first = self.rows[0]
            found = _Replay(by_id[first.boss_id]).run(self.rows, first.entered_ms, first.last_ms)
            return [(first.boss_id, *x) for x in found]

    return folded(rows.select(*PULL, *fields), PULL, ["line_number"], SCRIPT, Played)


def phase_times(script: DataFrame, pulls: DataFrame) -> DataFrame:
    """Phases of each pull with seconds from its start, and their number in order of first entry."""
    rows = script.where("what = 'phase'").join(pulls.select(*PULL, F.col("start_ms").alias("pull_ms")), PULL)
    first = rows.groupBy(*PULL, "id").agg(F.min(F.struct("start_ms", "line_number")).alias("at"), F.min((F.col("start_ms") - F.col("pull_ms")) / 1000).alias("offset"), F.count("*").alias("entries"))
    listed = first.groupBy(*PULL).agg(F.array_sort(F.collect_list(F.struct("at", "id", "offset", "entries"))).alias("all"))
    out = listed.select(*PULL, F.posexplode("all").alias("nth", "p"))
    return out.select(*PULL, "nth", F.col("p.id").alias("phase"), F.col("p.offset").alias("offset"), F.col("p.entries").alias("entries"))
