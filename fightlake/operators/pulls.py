"""Splitting a log into pulls, block by block of its lines.

A row begins a new pull if the current one has entities and (a) it enters combat and the entry before is at least
``enter`` ago, or (b) the pull has been left and that is over ``trailing`` ago, or (c) it has not been left and the last row is
over ``gap`` ago. The row belongs to the new pull, which has then not been left. ``t_ms`` must not fall within a log, as
:func:`fightlake.operators.clock.with_clock` sees to. Rows without a log or a line number are in pull 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Timing:
    """Milliseconds."""

    gap: int = 8000
    trailing: int = 4000
    enter: int = 30000
    sliver: int = 5000


def touches() -> Column:
    """Whether a row makes an entity known."""
    acts = F.col("source").isNotNull() & (F.col("is_heal") | F.col("is_threat_modified") | F.col("is_ability_activate") | F.col("is_interrupted") | F.col("is_hard_cc"))
    attack = F.col("is_damage") & F.col("ability").isNotNull() & (F.col("source").isNotNull() | (F.col("target").isNotNull() & ((F.col("amount") > 0) | (F.col("shield_absorbed") > 0))))
    seen = (F.col("source").isNotNull() & F.col("source_is_player")) | (F.col("target").isNotNull() & F.col("target_is_player"))
    death = F.col("is_death") & F.col("target").isNotNull()
    return F.coalesce(seen | death | (~F.col("is_combat_end") & (acts | attack)), F.lit(False))


#: Line numbers of a log that are worked on together.
BLOCK = 1 << 15

_CUTS = "log_path string, block long, pull_index long, starts array<long>, areas array<struct<line: long, difficulty: string, group_size: int>>, area_line long, difficulty string, group_size int"
_ENDS = "known: boolean, left_ms: long, kept: boolean, start: int"
_BLOCKS = _CUTS.replace("pull_index long, starts array<long>", f"entries array<struct<known_before: boolean, until_ms: long, {_ENDS}>>, lines array<long>, following array<int>")
#: Blocks whose pulls are put together before they are handed on.
HANDED = 64


class _Block:
    """The rows of one block of a log, and the pulls that begin in it for any state that the log may be in before it.

    After a row that begins a pull, all is known but for what comes later: the pull has entities from the first row on that touches one, and is
    left at its first exit. So the next such row is a minimum of three places, each found by a binary search.
    """

    def __init__(self, lines: np.ndarray, t: np.ndarray, enters: np.ndarray, ends: np.ndarray, touch: np.ndarray, last_ms: int | None, enter_ms: int | None, timing: Timing):
        self.lines, self.t, self.n, self.trailing = lines, t, len(t), timing.trailing
        at = np.where(enters, np.arange(self.n), -1)
        before = np.maximum.accumulate(np.concatenate([[-1], at[:-1]])) if self.n else at
        entry = np.where(before >= 0, t[before] if self.n else t, t[0] + 1 if enter_ms is None and self.n else enter_ms or 0)
        known_entry = (before >= 0) | (enter_ms is not None)
        last = np.concatenate([[t[0] if last_ms is None else last_ms], t[:-1]]) if self.n else t
        self.touches, self.exits = np.flatnonzero(touch), np.flatnonzero(ends)
        self.enters, self.gaps = np.flatnonzero(enters & known_entry & (t - entry >= timing.enter)), np.flatnonzero(t - last > timing.gap)
        self.memory: dict[int, tuple[int, bool, int | None]] = {}

    def _first(self, places: np.ndarray, least: int) -> int:
        i = int(np.searchsorted(places, least))
        return int(places[i]) if i < len(places) else self.n

    def _overdue(self, left: int) -> int:
        return int(np.searchsorted(self.t, left + self.trailing, "right"))

    def after(self, start: int) -> tuple[bool, int | None]:
        """What follows if a pull begins at row ``start``: whether the block's last pull has entities, and when it was left.

        ``memory`` keeps each row that begins a pull once, with the row that begins the next one, as ways that meet go on together.
        """
        ends, chain = (False, None), []
        while start < self.n and start not in self.memory:
            known, left = self._first(self.touches, start), self._first(self.exits, start)
            ends = known < self.n, int(self.t[left]) if left < self.n else None
            chain.append((start, min(self._next(known, left, None), self.n)))
            start = chain[-1][1]
        if start < self.n:
            ends = self.memory[start][1:]
        self.memory.update((at, (following, *ends)) for at, following in chain)
        return ends

    def _next(self, known: int, exit_: int, left: int | None) -> int:
        """The row that begins the next pull, where rows after ``known`` can and the pull is left at row ``exit_``, or was at ``left``."""
        row = self._first(self.enters, known + 1)
        if left is not None:
            return min(row, max(self._overdue(left), known + 1))
        gap = self._first(self.gaps, known + 1)
        if gap <= exit_:
            row = min(row, gap)
        if exit_ < self.n:
            row = min(row, max(self._overdue(int(self.t[exit_])), exit_ + 1, known + 1))
        return row

    def entries(self) -> list[dict]:
        """What this block does for each state before it: whether the pull has entities; and if it was left so long ago that ``left + trailing`` is
        before ``until_ms`` but not before that of the entry above (null: whenever), or, in the first entry, if it wasn't left (-1). ``start`` is the place
        of the first pull's row in :meth:`chains`, or -1."""
        out = []
        for known_before in (False, True):
            known = -1 if known_before else self._first(self.touches, 0)
            exit_ = self._first(self.exits, 0)
            steps = [(-1, self._next(known, exit_, None))]
            until = self._overdue(int(self.t[0])) if self.n else 0
            rises = [0, *(np.flatnonzero(np.diff(self.t[: until + 1]) > 0) + 1).tolist()]
            soonest = self._first(self.enters, known + 1)
            steps += [(int(self.t[r]), min(soonest, max(r, known + 1))) for r in rises if r < self.n]
            steps.append((None, min(soonest, self.n)))
            for until_ms, start in steps:
                has, left = self.after(start)
                if start >= self.n:
                    has, left = known < self.n, int(self.t[exit_]) if until_ms == -1 and exit_ < self.n else None
                out.append({"known_before": known_before, "until_ms": until_ms, "known": bool(has), "left_ms": left, "kept": start >= self.n and until_ms != -1, "start": start})
        places = {at: i for i, at in enumerate(sorted(self.memory))}
        return [e | {"start": places.get(e["start"], -1)} for e in out]

    def chains(self) -> tuple[np.ndarray, np.ndarray]:
        """After :meth:`entries`: the lines that begin a pull for any of these, ascending, and for each the place of the next one's, or -1."""
        rows = np.array(sorted(self.memory), np.int64)
        following = np.array([self.memory[r][0] for r in rows.tolist()], np.int64)
        return self.lines[rows], np.where(following < self.n, np.searchsorted(rows, following), -1).astype(np.int32)


def _split_at_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Stretches of a sorted stream that begin with a row without a line number."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        at = 0
        for mark in np.flatnonzero(batch.column("line_number").is_null().to_numpy(zero_copy_only=False)):
            if mark > at:
                held.append(batch.slice(at, mark - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], int(mark)
        if at < batch.num_rows:
            held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _block_entries(timing: Timing, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("known_before", pa.bool_()), ("until_ms", pa.int64()), ("known", pa.bool_()), ("left_ms", pa.int64()), ("kept", pa.bool_()), ("start", pa.int32())]))
    for table in _split_at_marks(batches):
        head, rows = table.slice(0, 1).combine_chunks().to_batches()[0], table.slice(1)
        lines, t, enters, ends, touch = (rows.column(c).to_numpy() for c in ("line_number", "t_ms", "is_combat_start", "is_combat_end", "touch"))
        block = _Block(lines, t, enters.astype(bool), ends.astype(bool), touch.astype(bool), head.column("t_ms")[0].as_py(), head.column("enter_ms")[0].as_py(), timing)
        carried = [head.column(c) for c in ("areas", "area_line", "difficulty", "group_size")]
        entries = pa.array([block.entries()], kind)
        begins, following = block.chains()
        chains = [pa.array([begins], pa.list_(pa.int64())), pa.array([following], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([head.column("log_path"), head.column("block"), entries, *chains, *carried], names=["log_path", "block", "entries", "lines", "following", "areas", "area_line", "difficulty", "group_size"])


def _begun(start: int, lines: pa.Scalar, following: pa.Scalar) -> np.ndarray:
    """The lines that begin pulls from the place ``start`` on."""
    out, lines, following = [], lines.as_py(), following.as_py()
    while start >= 0:
        out.append(lines[start])
        start = following[start]
    return np.array(out, np.int64)


def _composed(timing: Timing, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order of their logs, each taken as the state before it says; only that state is held, and one block's entries at a time."""
    log, known, left, index, new = None, False, None, 0, True
    for batch in (b.slice(at, HANDED) for b in batches for at in range(0, b.num_rows, HANDED)):
        first, starts = [], []
        for path, *chains, entries in zip(batch.column("log_path").to_pylist(), *(batch.column(c) for c in ("lines", "following", "entries")), strict=True):
            if new or path != log:
                log, known, left, index, new = path, False, None, 0, False
            own = [e for e in entries.as_py() if e["known_before"] == known and (e["until_ms"] == -1) == (left is None)]
            entry = own[0] if left is None else next(e for e in own if e["until_ms"] is None or left + timing.trailing < e["until_ms"])
            first.append(index)
            starts.append(_begun(entry["start"], *chains))
            known, left, index = entry["known"], left if entry["kept"] else entry["left_ms"], index + len(starts[-1])
        more = [batch.column(c) for c in ("areas", "area_line", "difficulty", "group_size")]
        yield pa.RecordBatch.from_arrays([batch.column("log_path"), batch.column("block"), pa.array(first, pa.int64()), pa.array(starts, pa.list_(pa.int64())), *more], names=["log_path", "block", "pull_index", "starts", "areas", "area_line", "difficulty", "group_size"])


def with_pulls(events: DataFrame, timing: Timing = Timing(), block: int = BLOCK) -> DataFrame:
    """``events`` with ``pull_index`` (0, 1, ... in each log) and ``area_line``, the last AreaEntered line so far.

    Where ``events`` has ``difficulty`` and ``group_size``, ``scope_difficulty`` and ``scope_group_size`` are those of the last AreaEntered line so far
    that names a difficulty; they hold on into later pulls.

    A log is cut into blocks of line numbers. What a block does depends on what was before it only by whether the pull had entities and when it was
    left, so each block is worked out for all such states by itself, blocks are then put together in order (a row each), and each row finds its
    pull among the few that begin in its block. No task holds more than one block of a log.
    """
    c, keys = F.col, ["log_path", "block"]
    number = F.floor(c("line_number") / block).alias("block")
    scoped = {"difficulty", "group_size"} <= set(events.columns)
    difficulty, group_size = (F.nullif("difficulty", F.lit("")), c("group_size").cast("int")) if scoped else (F.lit(None).cast("string"), F.lit(None).cast("int"))
    rows = events.select("log_path", number, "line_number", "t_ms", F.coalesce("is_combat_start", F.lit(False)).alias("is_combat_start"), F.coalesce("is_combat_end", F.lit(False)).alias("is_combat_end"), touches().alias("touch"))
    area = F.when(c("is_area_entered"), F.struct(c("line_number").alias("line"), difficulty.alias("difficulty"), group_size.alias("group_size")))
    frames = events.select("log_path", number, "line_number", "t_ms", c("is_combat_start"), area.alias("area")).groupBy(*keys).agg(
        F.max_by("t_ms", "line_number").alias("t_ms"), F.max_by("t_ms", F.when(c("is_combat_start"), c("line_number"))).alias("enter_ms"), F.array_sort(F.collect_list("area")).alias("areas")
    )
    past = Window.partitionBy("log_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scopes = F.filter("areas", lambda x: x["difficulty"].isNotNull())
    before = lambda column: F.last(column, True).over(past)
    frames = frames.select(
        *keys, F.lit(None).cast("long").alias("line_number"), before(c("t_ms")).alias("t_ms"), before(c("enter_ms")).alias("enter_ms"), "areas",
        before(F.try_element_at("areas", F.lit(-1))["line"]).alias("area_line"), before(F.try_element_at(scopes, F.lit(-1))).alias("scope"),
    ).select("*", c("scope.difficulty").alias("difficulty"), c("scope.group_size").alias("group_size")).drop("scope")
    stream = rows.unionByName(frames, allowMissingColumns=True).repartition(*keys).sortWithinPartitions(*keys, "line_number")
    blocks = stream.mapInArrow(partial(_block_entries, timing), _BLOCKS)
    cuts = blocks.repartition("log_path").sortWithinPartitions(*keys).mapInArrow(partial(_composed, timing), _CUTS).select(F.struct("*").alias("__block"))
    here = (c("log_path") == c("__block.log_path")) & (F.floor(c("line_number") / block) == c("__block.block"))
    found = events.join(cuts, here, "left")
    so_far = F.filter("__block.areas", lambda x: x["line"] <= c("line_number"))
    scope = F.try_element_at(F.filter(so_far, lambda x: x["difficulty"].isNotNull()), F.lit(-1))
    whole = [F.coalesce(c("__block.pull_index") + F.size(F.filter("__block.starts", lambda x: x <= c("line_number"))), F.lit(0)).cast("long").alias("pull_index"), F.coalesce(F.try_element_at(so_far, F.lit(-1))["line"], "__block.area_line").alias("area_line")]
    if scoped:
        known = scope.isNotNull()
        whole += [F.when(known, scope["difficulty"]).otherwise(c("__block.difficulty")).alias("scope_difficulty"), F.when(known, scope["group_size"]).otherwise(c("__block.group_size")).alias("scope_group_size")]
    return found.select(*events.columns, *whole)


def pulls_of(events: DataFrame) -> DataFrame:
    """One row a pull of ``events`` with ``pull_index``: line range, clock range and duration, ended by the first exit."""
    ends = F.coalesce(F.min(F.when(F.col("is_combat_end"), F.col("t_ms"))), F.max("t_ms"))
    return events.groupBy("log_path", "pull_index").agg(
        F.min("line_number").alias("start_line"), F.max("line_number").alias("end_line"), F.max("area_line").alias("area_line"),
        F.min("t_ms").alias("start_ms"), ends.alias("end_ms"), F.count("*").alias("n_events"),
        F.greatest((ends - F.min("t_ms")) / 1000, F.lit(0.001)).alias("duration"),
        F.max(F.col("is_damage") & F.col("ability").isNotNull() & (F.col("amount") > 0)).alias("is_fight"),
    )


def fights(pulls: DataFrame, timing: Timing = Timing()) -> DataFrame:
    """Pulls with damage that are no slivers."""
    return pulls.where(F.col("is_fight") & (F.col("duration") >= timing.sliver / 1000))


def gap_sessions(events: DataFrame, key: str, time: str, gap: int) -> DataFrame:
    """``events`` with ``session_index``: a new session of ``key`` after over ``gap`` without one."""
    w = Window.partitionBy(key).orderBy(time)
    late = F.coalesce(F.col(time) - F.lag(time).over(w) > gap, F.lit(False)).cast("long")
    return events.withColumn("late", late).withColumn("session_index", F.sum("late").over(w)).drop("late")
