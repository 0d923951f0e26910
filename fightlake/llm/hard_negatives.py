"""Hard-negative mining by angular triangle filtering.

Components become integers, floor(256 * x), and a score is an integer inner product; higher scores come first, ties by smaller id. For each
anchor its first rows of the same label are its positives; for each of these, the first rows of another label whose score is at least
``FLOOR`` and at most 100 percent of the positive's are its hard negatives.

* Each row is stored with its norm and its angles to a few reference directions (:func:`references`; only the pruning depends on them).
  By the triangle inequality for angles, what an anchor and a row have as angles to a reference bounds the angle between the two from both
  sides, so each reference gives an interval of cosines; norms make of it an interval of scores, widened by more than the rounding.
* Rows are ordered by label, nearest reference and angle to it, and cut into windows. A window keeps the least and greatest angle to each
  reference and norm, and is scored, in integers, only against anchors for which its interval of scores overlaps what is still open:
  above the k-th best found so far and within the bounds asked for.
* Anchors come in blocks of at most ``BLOCK`` vectors, one at a time in the driver and sent to the tasks; each block is one pass over the
  rows for positives and one for negatives. A task gives at most k rows for each anchor (or positive); these are merged by a ranking.

A block starts with bounds from its own anchors, which are rows too, so windows are dropped from the beginning on.

Defined cases: rows with a null label, a null vector or any null or non-finite component take no part, nor do those with a null id; a vector that
is shorter counts as filled up with zeros, an empty one scores zero with all; ids that repeat are rows of their own, but none of them counts
as another row to an anchor of that id, and each is an anchor of its own; a score beyond a long is the nearest long; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, written
from .decontam import _Shared

SCALE, FLOOR, EACH = 256, 80, 5
#: Anchors in a block, rows in a window, reference directions, and rows that these are taken from.
BLOCK, WINDOW, REFERENCES, SAMPLE = 4096, 64, 16, 4096
_LONG = np.iinfo(np.int64)
#: Components up to this size, in up to 2**16 of them, can't overflow a long when they are multiplied and summed.
_SAFE = 1 << 23

ROWS = "id long, label long, ints binary, norm double, angles binary, cell int, angle double"
_ARROW = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("ints", pa.binary()), ("norm", pa.float64()), ("angles", pa.binary()), ("cell", pa.int32()), ("angle", pa.float64())])


def participants(embeddings: DataFrame, label: Column) -> DataFrame:
    """(id, label, vector) of the rows that take part."""
    kept = embeddings.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return kept.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)


def as_ints(vector: list[float]) -> np.ndarray:
    """floor(256 * x) of each component, as doubles that are whole numbers."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * np.array(vector, float)), -1e300, 1e300)


def references(rows: DataFrame, n: int = REFERENCES, sample: int = SAMPLE) -> np.ndarray:
    """Unit vectors: rows far from each other, taken one after the other out of at most ``sample`` rows (those with the least hash of their id).

    Any directions give right results; these only decide how many windows can be dropped.
    """
    some = [as_ints(r.vector) for r in rows.where("size(vector) > 0").orderBy(F.xxhash64("id"), "id", F.xxhash64("vector")).limit(sample).collect()]
    dim = max(map(len, some), default=1)
    vectors = np.array([np.pad(v, (0, dim - len(v))) for v in some]).reshape(-1, dim)
    peaks = np.abs(vectors).max(1, initial=0)
    vectors = vectors[peaks > 0] / peaks[peaks > 0, None]
    vectors = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    chosen: list[np.ndarray] = []
    nearest = np.full(len(vectors), -np.inf)
    for _ in range(min(n, len(vectors))):
        pick = int(nearest.argmin()) if chosen else 0
        if chosen and nearest[pick] > 1 - 1e-9:
            break
        chosen.append(vectors[pick])
        nearest = np.maximum(nearest, vectors @ vectors[pick])
    return np.array(chosen).reshape(-1, dim) if chosen else np.eye(1, dim)


def _angles(ints: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to each reference (0 for a zero vector, whose scores are zero at any angle)."""
    dim = max(ints.shape[1], refs.shape[1])
    x, r = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in (ints.astype(float), refs))
    norms = np.sqrt(np.einsum("ij,ij->i", x, x)) if np.abs(x).max(initial=0) < 1e140 else np.array([np.linalg.norm(v / 1e160) * 1e160 for v in x])
    return norms, np.arccos(np.clip((x / np.where(norms > 0, norms, 1)[:, None]) @ r.T, -1, 1)) * (norms > 0)[:, None]


def _matrix(lists: list) -> np.ndarray:
    """Rows of integers, short ones filled up with zeros; Python's integers where longs could overflow."""
    dim = max(map(len, lists), default=0)
    out = np.zeros((len(lists), dim))
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    if np.abs(out).max(initial=0) <= _SAFE and dim <= 1 << 16:
        return out.astype(np.int64)
    return np.array([[int(x) for x in row] for row in out], object).reshape(out.shape)


def stored(rows: DataFrame, refs: np.ndarray) -> DataFrame:
    """ROWS of participants, ordered by label, nearest reference and angle, as a table in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ints = [as_ints(v) for v in part.column(2).to_pylist()]
                dim = max(map(len, ints))
                norms, angles = _angles(np.array([np.pad(v, (0, dim - len(v))) for v in ints]), refs)
                cell = angles.argmin(1)
                columns = [part.column(0), part.column(1), [v.astype("<f8").tobytes() for v in ints], norms, [a.astype("<f8").tobytes() for a in angles], cell.astype(np.int32), angles[np.arange(len(cell)), cell]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    found = rows.select("id", "label", "vector").mapInArrow(run, ROWS)
    found, _ = written(found, "angles")
    order = ["label", "cell", "angle", "id"]
    return written(found.repartitionByRange(*order).sortWithinPartitions(*order), "windows")[0]


class Vectors:
    """Some rows with their integers, norms and angles."""

    def __init__(self, ids, labels, ints, norms, angles):
        self.ids, self.labels, self.norms = np.array(ids, np.int64), np.array(labels, np.int64), np.array(norms, float)
        self.ints, self.angles = _matrix([np.frombuffer(v, "<f8") for v in ints]), np.array([np.frombuffer(a, "<f8") for a in angles])

    @classmethod
    def of(cls, rows) -> Vectors:
        return cls(*([r[c] for r in rows] for c in ("id", "label", "ints", "norm", "angles")))

    def scores(self, others: np.ndarray) -> np.ndarray:
        """Of these rows (down) with ``others`` (across)."""
        dim = min(self.ints.shape[1], others.shape[1])
        a, b = self.ints[:, :dim], others[:, :dim]
        if a.dtype == b.dtype == np.int64:
            if dim * (_peak(a) * _peak(b)) < 1 << 53:  # such sums of whole numbers are exact in doubles
                return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
            return a @ b.T
        exact = a.astype(object) @ b.T.astype(object) if dim else np.zeros((len(a), len(b)), object)
        return np.clip(exact, int(_LONG.min), int(_LONG.max)).astype(np.int64)


def _peak(x: np.ndarray) -> int:
    return int(np.abs(x).max(initial=0))


def score_bounds(norm: np.ndarray, angle: np.ndarray, norms: tuple[float, float], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) score that each anchor (norm, angles) can have with any row of a window.

    The rows' norms lie within ``norms`` and their angles to the references within ``low`` and ``high``. Both bounds are a little wide, so that
    no rounding can make them wrong.
    """
    slack = 1e-7
    least = np.maximum(np.maximum(angle - high, low - angle).max(1) - slack, 0)
    most = np.minimum(np.minimum(angle + high, 2 * np.pi - angle - low).min(1) + slack, np.pi)
    top, bottom = np.cos(least), np.cos(most)
    with np.errstate(over="ignore", invalid="ignore"):
        greatest = norm * np.where(top > 0, norms[1], norms[0]) * top
        smallest = norm * np.where(bottom > 0, norms[0], norms[1]) * bottom
        wide = 1 + 1e-9 * norm * norms[1]
        return np.nan_to_num(smallest - wide, nan=-np.inf, neginf=-np.inf), np.nan_to_num(greatest + wide, nan=np.inf, posinf=np.inf)


class Search:
    """The first ``k`` rows for each of many slots: an anchor, whether of its label or of another, and the least and greatest score."""

    def __init__(self, anchors: Vectors, owner: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.anchors, self.owner, self.same, self.low, self.high, self.k = anchors, owner, same, low, high, k
        self.floor = low.copy() if floor is None else np.maximum(low, floor)  # nothing below it can be among the first k
        self.found: list[tuple[np.ndarray, ...]] = []
        self.held = self.windows = self.scored = 0

    def add(self, rows: Vectors) -> None:
        """Look at one window of rows."""
        a = self.anchors
        least, greatest = score_bounds(a.norms, a.angles, (rows.norms.min(), rows.norms.max()), rows.angles.min(0), rows.angles.max(0))
        first, last = rows.labels.min(), rows.labels.max()
        may = (a.labels >= first) & (a.labels <= last) if self.same else (a.labels != first) | (first != last)
        self.windows += len(may)
        slots = np.flatnonzero(may[self.owner] & (greatest[self.owner] >= self.floor) & (least[self.owner] <= self.high))
        if not len(slots):
            return
        wanted, column = np.unique(self.owner[slots], return_inverse=True)
        self.scored += len(wanted)
        score = rows.scores(a.ints[wanted])
        ok = rows.labels[:, None] == a.labels[wanted] if self.same else rows.labels[:, None] != a.labels[wanted]
        if self.same:
            ok &= rows.ids[:, None] != a.ids[wanted]
        score, ok = score[:, column], ok[:, column]
        row, slot = np.nonzero(ok & (score >= self.floor[slots]) & (score <= self.high[slots]))
        if len(row):
            self.found.append((slots[slot], score[row, slot], rows.ids[row], rows.labels[row]))
            self.held += len(row)
            if self.held > max(1 << 16, 2 * self.k * len(self.owner)):
                self.settle()

    def settle(self) -> None:
        """Keep the first k of each slot, and raise its floor to the last of these."""
        if not self.found:
            return
        slot, score, ids, labels = (np.concatenate(c) for c in zip(*self.found, strict=True))
        order = np.lexsort((ids, ~score, slot))
        slot, score, ids, labels = (c[order] for c in (slot, score, ids, labels))
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        last = place == self.k - 1
        self.floor[slot[last]] = np.maximum(self.floor[slot[last]], score[last])
        keep = place < self.k
        self.found = [(slot[keep], score[keep], ids[keep], labels[keep])]
        self.held = int(keep.sum())

    def result(self) -> tuple[np.ndarray, ...]:
        """(slot, score, id, label)."""
        self.settle()
        return self.found[0] if self.found else tuple(np.empty(0, np.int64) for _ in range(4))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[Vectors]:
    for batch in batches:
        for at in range(0, batch.num_rows, WINDOW):
            yield Vectors(*(c.to_pylist() for c in batch.slice(at, WINDOW).columns[:5]))


def _own_floor(anchors: Vectors, owner: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Floors from the anchors themselves, which are rows too."""
    search = Search(anchors, owner, same, low, high, k)
    for at in range(0, len(anchors.ids), WINDOW):
        part = slice(at, at + WINDOW)
        rows = object.__new__(Vectors)
        rows.ids, rows.labels, rows.norms, rows.ints, rows.angles = (x[part] for x in (anchors.ids, anchors.labels, anchors.norms, anchors.ints, anchors.angles))
        search.add(rows)
    search.settle()
    return search.floor


def _pass(rows: DataFrame, anchors: Vectors, owner: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> DataFrame:
    """(slot, score, id) of the first ``k`` rows of each slot in each task: these contain the first k of all."""
    shared = _Shared(rows.sparkSession, (anchors, owner, low, high, _own_floor(anchors, owner, same, low, high, k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, owner, low, high, floor = shared.value
        search = Search(anchors, owner, same, low, high, k, floor)
        for window in _windows(batches):
            search.add(window)
        slot, score, ids, _ = search.result()
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(score), pa.array(ids)], names=["slot", "score", "id"])

    return rows.mapInArrow(run, "slot long, score long, id long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each slot, with their rank; a task sends no more than k of a slot on."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(anchors: DataFrame, block: int) -> Iterator[Vectors]:
    """Anchors in blocks; one at a time is in the driver."""
    held = []
    for row in anchors.toLocalIterator():
        held.append(row)
        if len(held) == block:
            yield Vectors.of(held)
            held = []
    if held:
        yield Vectors.of(held)


def mine(embeddings: DataFrame, anchors: Column, label: Column | None = None, each: int = EACH, floor: int = FLOOR, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``embeddings`` that ``anchors`` holds for."""
    spark = embeddings.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = participants(embeddings, F.col("label") if label is None else label)
    rows, _ = written(rows, "participants")
    table = stored(rows, references(rows))
    path = shared_dir(spark, "hard-negatives")
    spark.createDataFrame([], schema).write.parquet(path)
    for part in _blocks(table.where(anchors), block):
        n = len(part.ids)
        every = np.arange(n)
        positives = _ranked(_pass(table, part, every, True, np.full(n, _LONG.min), np.full(n, _LONG.max), each), each).collect()  # ``each`` rows for each anchor of a block at most
        if not positives:
            continue
        pairs = np.unique(np.array([(r.slot, r.score) for r in positives], np.int64), axis=0)
        owner, high = pairs[:, 0], pairs[:, 1]
        low = high - (high // 100 * (100 - floor) + high % 100 * (100 - floor) // 100)  # the least whole number of at least ``floor`` percent
        negatives = _ranked(_pass(table, part, owner, False, low, high, each), each)
        place = {(int(a), int(s)): i for i, (a, s) in enumerate(pairs.tolist())}
        named = spark.createDataFrame(
            pa.table({
                "slot": pa.array([place[r.slot, r.score] for r in positives], pa.int64()),
                "anchor_id": pa.array([int(part.ids[r.slot]) for r in positives], pa.int64()),
                "positive_id": pa.array([r.id for r in positives], pa.int64()),
                "positive_score": pa.array([r.score for r in positives], pa.int64()),
            })
        )
        found = named.join(negatives.toDF("slot", "negative_score", "negative_id", "rank"), "slot")
        found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
