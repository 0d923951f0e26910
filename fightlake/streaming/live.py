"""Live versions: a folder of log files as a stream, pulls as they stand and end, and what is counted, on or running in the open pull.

Each of these is one stateful step a log (``transformWithStateInPandas``): it splits the log into pulls itself and keeps what belongs to the open
pull, so the state of a pull is cleared as the next one begins, and a log without rows for ``idle_ms`` is told as ended and forgotten (Spark therefore
goes on with batches without data; a trigger ``availableNow`` would never end). A restart goes on where it stopped. Rows of a log must come in order of its lines from batch to batch; within a batch they may come in any order.

The session's state store must be RocksDB's (:func:`use_state_store`).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators import effects, rules, stats
from ..operators.pulls import Timing, touches
from ..sources.logs import decoded

#: Milliseconds without a row after which a log's open pull is over and its state is dropped.
IDLE = 3_600_000
#: Taunts that are remembered of a player.
RECENT = 6


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_logs(spark: SparkSession, folder: str) -> DataFrame:
    """(log_path, line_number, line) of files as they land; the log's name is the part before the first ``.``."""
    text = spark.readStream.text(folder, wholetext=True)
    lines = text.select(F.regexp_extract("_metadata.file_name", r"^([^.]+)", 1).alias("log_path"), F.posexplode(F.split(decoded(F.col("value").cast("binary")), "\r\n|\n|\r", -1)).alias("n", "line"))
    return lines.where("line <> ''").select("log_path", (F.col("n") + 1).cast("long").alias("line_number"), "line")


_PULL = "pull_index long, start_line long, end_line long, start_ms long, last_ms long, exit_ms long, enter_ms long, n_events long, known long"


class _Pull:
    """The open pull of a log."""

    def __init__(self, index=0, first=None, last=None, begin=None, before=None, left=None, entered=None, n=0, known=0):
        self.index, self.first, self.last, self.begin, self.before, self.left, self.entered, self.n, self.known = index, first, last, begin, before, left, entered, n, known

    def state(self) -> tuple:
        return self.index, self.first, self.last, self.begin, self.before, self.left, self.entered, self.n, self.known

    def ends_before(self, row, timing: Timing) -> bool:
        if not self.known:
            return False
        again = row.is_combat_start and self.entered is not None and row.t_ms - self.entered >= timing.enter
        return bool(again or (row.t_ms - self.left > timing.trailing if self.left is not None else self.before is not None and row.t_ms - self.before > timing.gap))

    def next(self) -> _Pull:
        return _Pull(self.index + 1, before=self.before, entered=self.entered)

    def take(self, row) -> bool:
        """Whether the row is the pull's first exit."""
        line, t = int(row.line_number), int(row.t_ms)
        leaves = bool(row.is_combat_end) and self.left is None
        self.first, self.begin = (line if self.first is None else self.first), (t if self.begin is None else self.begin)
        self.last, self.before, self.n, self.known = line, t, self.n + 1, self.known + int(bool(row.touch))
        self.left = t if leaves else self.left
        self.entered = t if row.is_combat_start else self.entered
        return leaves

    def end_ms(self) -> int:
        return self.before if self.left is None else self.left


class _Live(StatefulProcessor):
    """Splits a log into pulls; subclasses keep what belongs to the open one.

    ``load`` and ``save`` bring their state in and out, ``row`` takes a row of theirs, ``closed`` tells what is over with the pull and empties them, and
    ``standing`` what there is after a batch.
    """

    names: list[str]

    def __init__(self, timing: Timing, idle_ms: int):
        self.timing, self.idle_ms = timing, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("pull", _PULL)

    def load(self) -> None: ...
    def save(self) -> None: ...
    def base(self, row, leaves: bool) -> None: ...

    def row(self, row, pull: _Pull) -> list[tuple]:
        return []

    def closed(self, pull: _Pull) -> list[tuple]:
        return []

    def standing(self, pull: _Pull) -> list[tuple]:
        return []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows)).astype(object)
        given = given.where(given.notna(), None).sort_values(["line_number", "ord"], kind="stable")
        kept = self.held.get() if self.held.exists() else None
        pull = _Pull(*(None if v is None or pd.isna(v) else int(v) for v in kept)) if kept else _Pull()
        self.load()
        out: list[tuple] = []
        for row in given.itertuples(index=False):
            if row.ord:
                out += self.row(row, pull)
                continue
            if pull.ends_before(row, self.timing):
                out += self.closed(pull)
                pull = pull.next()
            self.base(row, pull.take(row))
        out += self.standing(pull)
        self.held.update(pull.state())
        self.save()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self.frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.held.exists():
            return
        pull = _Pull(*(None if v is None or pd.isna(v) else int(v) for v in self.held.get()))
        self.load()
        out = self.closed(pull)
        self.save()
        self.held.clear()
        yield self.frame(key, out)

    def frame(self, key, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *x) for x in out], columns=self.names, dtype=object)

    def close(self) -> None: ...


def _run(events: DataFrame, more: DataFrame | None, processor: _Live, out: str) -> DataFrame:
    """``processor`` over the rows of each log, each followed by those of ``more`` with its line number."""
    base = events.select("log_path", "line_number", F.lit(0).alias("ord"), "t_ms", F.coalesce("is_combat_start", F.lit(False)).alias("is_combat_start"), F.coalesce("is_combat_end", F.lit(False)).alias("is_combat_end"), touches().alias("touch"))
    if more is not None and "ord" not in more.columns:
        more = more.withColumn("ord", F.lit(1))
    rows = base if more is None else base.unionByName(more, allowMissingColumns=True)
    processor.names = [c.split()[0] for c in out.split(", ")]
    return rows.groupBy("log_path").transformWithStateInPandas(processor, out, "Update", "ProcessingTime")


class _Told(_Live):
    def closed(self, pull: _Pull) -> list[tuple]:
        return [(pull.index, pull.first, pull.last, pull.begin, pull.end_ms(), pull.n, True)]

    def standing(self, pull: _Pull) -> list[tuple]:
        return [(*self.closed(pull)[0][:-1], False)]


def live_pulls(events: DataFrame, timing: Timing = Timing(), idle_ms: int = IDLE) -> DataFrame:
    """Pulls of a stream of events (log_path, line_number, t_ms and kinds): closed ones, and the open one as it stands (``closed`` false)."""
    return _run(events, None, _Told(timing, idle_ms), "log_path string, pull_index long, start_line long, end_line long, start_ms long, end_ms long, n_events long, closed boolean")


class _Meter(_Live):
    """Totals of each entity in the open pull: whole hundredths, so that sums are exact."""

    fields = [*stats.FIELDS, *stats.COUNTS]

    def init(self, handle) -> None:
        super().init(handle)
        self.totals = handle.getMapState("totals", "name string", ", ".join(["is_player boolean", *(f"{n} long" for n in self.fields)]))

    def load(self) -> None:
        self.now = {k[0]: list(v) for k, v in self.totals.iterator()}
        self.dirty: set[str] = set()
        self.emptied, self.exit = False, False

    def save(self) -> None:
        if self.emptied:
            self.totals.clear()
        for name in self.now if self.emptied else self.dirty:
            self.totals.updateValue((name,), tuple(self.now[name]))

    def base(self, row, leaves: bool) -> None:
        self.exit = leaves

    def row(self, row, pull: _Pull) -> list[tuple]:
        if self.exit and not row.is_player:  # a first exit adds nothing, but makes players known
            return []
        now = self.now.setdefault(row.name, [False] + [0] * len(self.fields))
        now[0] = bool(now[0] or row.is_player)
        if not self.exit:
            for i, n in enumerate(self.fields, 1):
                now[i] += int(getattr(row, n))
        self.dirty.add(row.name)
        return []

    def _rows(self, pull: _Pull, closed: bool) -> list[tuple]:
        n = len(stats.FIELDS)
        return [(pull.index, name, v[0], *(x / 100 for x in v[1 : n + 1]), *v[n + 1 :], pull.begin, pull.end_ms(), closed) for name, v in sorted(self.now.items())]

    def closed(self, pull: _Pull) -> list[tuple]:
        out = self._rows(pull, True)
        self.now, self.dirty, self.emptied = {}, set(), True
        return out

    def standing(self, pull: _Pull) -> list[tuple]:
        return self._rows(pull, False)


def live_meter(events: DataFrame, timing: Timing = Timing(), idle_ms: int = IDLE) -> DataFrame:
    """Totals of each entity of the open pull after each batch (``closed`` false), as :func:`fightlake.operators.stats.entity_stats` has them; those of a pull that ended are told once more."""
    out = ", ".join(["log_path string", "pull_index long", "name string", "is_player boolean", *(f"{n} double" for n in stats.FIELDS), *(f"{n} long" for n in stats.COUNTS), "start_ms long", "end_ms long", "closed boolean"])
    return _run(events, stats.entity_changes(events), _Meter(timing, idle_ms), out)


class _Effects(_Live):
    """The stretches of effects that are on in the open pull."""

    def init(self, handle) -> None:
        super().init(handle)
        self.kept = handle.getMapState("on", "target string, source string, effect string", "start_ms long, end_ms long, refreshes long, charges_lost long")

    def load(self) -> None:
        self.on: dict[str, effects._Tracked] = {}
        self.before = {tuple(k): list(v) for k, v in self.kept.iterator()}
        for (target, source, effect), v in self.before.items():
            self.on.setdefault(target, effects._Tracked(())).on[source, effect] = [int(x) for x in v]

    def save(self) -> None:
        now = {(target, *k): v for target, tracked in self.on.items() for k, v in tracked.on.items()}
        for k in self.before:
            if k not in now:
                self.kept.removeKey(k)
        for k, v in now.items():
            if self.before.get(k) != v:
                self.kept.updateValue(k, tuple(v))

    def row(self, row, pull: _Pull) -> list[tuple]:
        whole = lambda x: None if x is None else int(x)
        found = self.on.setdefault(row.target, effects._Tracked(())).row(row.source, row.effect, row.line_number, int(row.effect_ms), row.what, whole(row.duration_ms), whole(row.charges), whole(row.max_charges))
        return [(pull.index, row.target, *x, True) for x in found]

    def closed(self, pull: _Pull) -> list[tuple]:
        out = [(pull.index, target, *x, True) for target, tracked in self.on.items() for x in tracked.end()]
        self.on = {}
        return out

    def standing(self, pull: _Pull) -> list[tuple]:
        return [(pull.index, target, *k, v[0], v[1], v[1], v[2], v[3], False) for target, tracked in self.on.items() for k, v in tracked.on.items()]


def live_effects(events: DataFrame, table: DataFrame, alacrity_pct: float = 0.0, timing: Timing = Timing(), idle_ms: int = IDLE) -> DataFrame:
    """Stretches of effects as :func:`fightlake.operators.effects.tracked_effects` tells them, once each is over (``closed``), and after each batch those that are on."""
    moved = effects.effect_rows(events.withColumn("pull_index", F.lit(0).cast("long")), table, alacrity_pct).drop("pull_index").withColumnRenamed("t_ms", "effect_ms")
    return _run(events, moved, _Effects(timing, idle_ms), f"{effects.TRACKED}, closed boolean")


class _Countdowns(_Live):
    """Countdowns that run in the open pull."""

    def init(self, handle) -> None:
        super().init(handle)
        self.kept = handle.getMapState("running", "label string, category string, target string, rule_id int, line_number long", "start_ms long, due_ms long, rule_id int, line_number long")
        self.dead = handle.getMapState("dead", "target string", "t_ms long")

    def load(self) -> None:
        self.before = {tuple(k): tuple(v) for k, v in self.kept.iterator()}
        self.now = dict(self.before)
        self.died = {k[0]: int(v[0]) for k, v in self.dead.iterator()}
        self.died_before = dict(self.died)

    def save(self) -> None:
        for k in self.before.keys() - self.now.keys():
            self.kept.removeKey(k)
        for k, v in self.now.items():
            if self.before.get(k) != v:
                self.kept.updateValue(k, v)
        if self.died != self.died_before:
            self.dead.clear()
            for k, t in self.died.items():
                self.dead.updateValue((k,), (t,))

    def _end(self, key: tuple, pull: _Pull, at: int | None, how: str) -> list[tuple]:
        start, due, rule, line = self.now.pop(key)
        if at is None or at >= due:
            at, how = due, "died" if how == "died" and at == due else "expired"
        return [(pull.index, rule, key[0], key[1], key[2], line, start, at, how, True)]

    def row(self, row, pull: _Pull) -> list[tuple]:
        t, out = int(row.hit_ms), []
        for key in [k for k, v in self.now.items() if v[1] <= t and not (row.what == "death" and v[1] == t and k[2] == row.target)]:
            out += self._end(key, pull, None, "expired")
        if row.what == "death":
            for key in [k for k in self.now if k[2] == row.target and k[1] in rules.MORTAL]:
                out += self._end(key, pull, t, "died")
            self.died[row.target] = t
            return out
        fresh = row.category in rules.REFRESHED
        key = (row.label, row.category, row.target, 0 if fresh else int(row.rule_id), 0 if fresh else int(row.line_number))
        if key in self.now:
            out += self._end(key, pull, t, "refreshed")
        self.now[key] = (t, t + int(row.duration_ms), int(row.rule_id), int(row.line_number))
        if row.category in rules.MORTAL and self.died.get(row.target) == t:
            out += self._end(key, pull, t, "died")
        return out

    def closed(self, pull: _Pull) -> list[tuple]:
        out = [x for k in list(self.now) for x in self._end(k, pull, None, "expired")]
        self.died = {}
        return out

    def standing(self, pull: _Pull) -> list[tuple]:
        out = [x for k in [k for k, v in self.now.items() if pull.before is not None and v[1] < pull.before] for x in self._end(k, pull, None, "expired")]
        return out + [(pull.index, v[2], *k[:3], v[3], v[0], v[1], "running", False) for k, v in self.now.items()]


def live_countdowns(events: DataFrame, table: DataFrame, timing: Timing = Timing(), idle_ms: int = IDLE) -> DataFrame:
    """Countdowns of keyword rules as :func:`fightlake.operators.rules.timer_intervals` tells them, once each is over (``closed``), and after each batch those that run.

    A pull's countdowns end with it, at their own times.
    """
    hits = rules.keyword_hits(events, table)
    label = F.col("label") if "label" in table.columns else F.col("rule_id").cast("string")
    category = F.col("category") if "category" in table.columns else F.lit("dot")
    told = hits.select("log_path", "line_number", F.lit(2).alias("ord"), F.col("t_ms").alias("hit_ms"), F.lit("hit").alias("what"), "rule_id", label.alias("label"), category.alias("category"), "target", "duration_ms")
    deaths = events.where("is_death and target is not null").select("log_path", "line_number", F.lit(1).alias("ord"), F.col("t_ms").alias("hit_ms"), F.lit("death").alias("what"), "target")
    out = "log_path string, pull_index long, rule_id int, label string, category string, target string, line_number long, start_ms long, end_ms long, ended string, closed boolean"
    return _run(events, told.unionByName(deaths, allowMissingColumns=True), _Countdowns(timing, idle_ms), out)


class _Taunts(_Live):
    """Taunts that aren't resolved yet, of each player, and the last ones that are; these outlive the pull."""

    def __init__(self, timing: Timing, idle_ms: int, match_ms: int, together_ms: int):
        super().__init__(timing, idle_ms)
        self.match_ms, self.together_ms = match_ms, together_ms

    def init(self, handle) -> None:
        super().init(handle)
        self.kept = handle.getMapState("waiting", "source string", "pending long, last long, targets string, recent string")

    def load(self) -> None:
        self.now = {k[0]: [None if pd.isna(v[0]) else int(v[0]), None if pd.isna(v[1]) else int(v[1]), v[2] or "", json.loads(v[3])] for k, v in self.kept.iterator()}
        self.dirty: set[str] = set()
        self.forget = False

    def save(self) -> None:
        if self.forget:
            self.kept.clear()
            return
        for source in self.dirty:
            pending, last, targets, recent = self.now[source]
            self.kept.updateValue((source,), (pending, last, targets, json.dumps(recent)))

    def _tell(self, source: str, pull: _Pull, at: int, kind: str, hit: bool, targets: str) -> tuple:
        recent = self.now[source][3]
        recent.append([at, kind, hit, targets])
        del recent[:-RECENT]
        return pull.index, source, at, kind, hit, targets, json.dumps(recent)

    def row(self, row, pull: _Pull) -> list[tuple]:
        source, t, out = row.source, int(row.taunt_ms), []
        now = self.now.setdefault(source, [None, None, "", []])
        self.dirty.add(source)
        if row.is_cast:
            if now[0] is not None:
                out.append(self._tell(source, pull, now[0], "single", False, ""))
            now[0] = t
        elif now[0] is not None and t - now[0] <= self.match_ms:
            out.append(self._tell(source, pull, t, "single", True, row.target))
            now[0] = None
        else:
            if now[0] is not None:
                out.append(self._tell(source, pull, now[0], "single", False, ""))
                now[0] = None
            if now[1] is not None and t - now[1] >= self.together_ms:
                out.append(self._tell(source, pull, now[1], "aoe", True, now[2]))
                now[2] = ""
            now[1], now[2] = t, ",".join(sorted({*filter(None, now[2].split(",")), row.target}))
        return out

    def closed(self, pull: _Pull) -> list[tuple]:
        out = []
        for source, now in self.now.items():
            if now[0] is not None:
                out.append(self._tell(source, pull, now[0], "single", False, ""))
            if now[1] is not None:
                out.append(self._tell(source, pull, now[1], "aoe", True, now[2]))
            if now[0] is not None or now[1] is not None:
                now[:3] = [None, None, ""]
                self.dirty.add(source)
        return out

    def standing(self, pull: _Pull) -> list[tuple]:
        out = []
        for source, now in self.now.items():
            if now[0] is not None and pull.before - now[0] > self.match_ms:  # a later row is too late for it
                out.append(self._tell(source, pull, now[0], "single", False, ""))
                now[0] = None
                self.dirty.add(source)
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        self.forget = True
        self.save()


def live_taunts(events: DataFrame, match_ms: int = 1000, together_ms: int = 250, ability: str = "Taunt", timing: Timing = Timing(), idle_ms: int = IDLE) -> DataFrame:
    """Taunts as they are resolved, as :func:`fightlake.operators.rules.taunts` tells them, with the player's last ``RECENT`` as JSON.

    A cast is told as its effect lands, or as a miss once a later row of the log is too late; effects without a cast once the next one is apart, or the pull ends.
    """
    c = F.col
    cast = c("is_ability_activate") & (c("ability") == ability) & (c("target") == c("source"))
    effect = (c("effect_type") == "ApplyEffect") & (c("effect_name") == ability) & c("target").isNotNull()
    rows = events.where(c("source_is_player") & (cast | effect)).select("log_path", "line_number", "source", "target", c("t_ms").alias("taunt_ms"), cast.alias("is_cast"))
    out = "log_path string, pull_index long, source string, at_ms long, kind string, hit boolean, targets string, recent string"
    return _run(events, rows, _Taunts(timing, idle_ms, match_ms, together_ms), out)


def live_clock(events: DataFrame, idle_ms: int = IDLE) -> DataFrame:
    """(log_path, line_number, at_ms) as :func:`fightlake.operators.clock.with_capped_clock` gives it, from a stream with t_ms and wall_ms."""
    out = "log_path string, line_number long, at_ms long"

    def fold(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(batches)).sort_values("line_number", kind="stable")
        lead = (rows["wall_ms"] - rows["t_ms"]).cummin()
        lead = lead.clip(upper=held.get[0]) if held.exists else lead
        held.update((int(lead.iloc[-1]),))
        held.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"log_path": key[0], "line_number": rows["line_number"], "at_ms": rows["t_ms"] + lead})

    rows = events.select("log_path", "line_number", "t_ms", "wall_ms")
    return rows.groupBy("log_path").applyInPandasWithState(fold, out, "lead long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def live_sessions(events: DataFrame, key: str, time: str, gap_ms: int, late: str, *what: Column) -> DataFrame:
    """Sessions of ``key`` with over ``gap_ms`` without a row between them, told once they can't grow any more: (key, start, end, n, what).

    ``time`` is a timestamp, as :func:`fightlake.operators.clock.with_event_time` makes it. Rows may come ``late`` and out of order; what is later than
    that behind the latest row isn't counted. As :func:`fightlake.operators.pulls.gap_sessions` splits them.
    """
    window = F.session_window(time, f"{1000 * gap_ms + 500} microseconds")
    found = events.withWatermark(time, late).groupBy(key, window.alias("w")).agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"), *what)
    return found.drop("w")


def live_shown(pulls: DataFrame, totals: DataFrame) -> DataFrame:
    """The pull that a display stays on, from what :func:`live_pulls` and :func:`live_meter` (pull, damage_done, healing_done) have given so far (batches, as in ``foreachBatch``)."""
    some = totals.where("damage_done > 0 or healing_done > 0").select("log_path", "pull_index").distinct().withColumn("some", F.lit(True))
    rows = pulls.join(some, ["log_path", "pull_index"], "left")
    return rows.groupBy("log_path").agg(F.coalesce(F.max_by("pull_index", F.when(F.col("some"), F.col("start_ms"))), F.max_by("pull_index", "start_ms")).alias("pull_index"))
