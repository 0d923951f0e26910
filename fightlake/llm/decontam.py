"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared as words: maximal runs of letters, digits and underscores in lower case. An item
of w words may be hit with up to floor(w * budget) word edits (insert, drop, replace), against any run of words of a
document. It is split into error-budget-plus-one pieces of about the same number of words; by the pigeonhole
principle one of them stands unedited in every hit. So all pieces are looked for at once with an Aho-Corasick
automaton over the whole text, and only around a piece that is found the distance is computed, by Myers'
bit-parallel algorithm over words (ends in the text are free).

Items come in blocks whose size in characters is bounded, each block one pass over the documents with its
automaton sent to the tasks; documents are never shuffled.

Defined cases: null and empty texts and items without words match nothing; items that repeat give a hit each;
a document that holds an item more than once gives one hit, the closest (the first of equals); rows that repeat a doc_id
each give their hits; a null doc_id or item_id stays null in hits, and :func:`drop_contaminated` judges each row by its
own text; empty tables give no hits; other columns are ignored by :func:`hits` and kept by :func:`drop_contaminated`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batched, rows_of, written

#: Edits for each word of an item (a similarity of 0.8).
BUDGET = 0.2
#: Characters of items that one pass takes.
BLOCK_CHARS = 8 << 20
_WORD = re.compile(r"\w+")

HITS = "doc_id long, item_id long, distance int, n_words int, first_word int, last_word int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("n_words", pa.int32()), ("first_word", pa.int32()), ("last_word", pa.int32())])


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def myers(item: list[str], words: list[str]) -> tuple[int, int]:
    """(least distance, words up to the end of the first such match) of ``item`` against any run of ``words``."""
    m = len(item)
    where: dict[str, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    ones, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = ones, 0, m
    best, end = m, 0
    for at, w in enumerate(words, 1):
        eq = where.get(w, 0)
        cross = eq | minus
        diag = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (ones & ~(diag | plus))
        down = plus & diag
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & ones, (down << 1) & ones
        plus, minus = down | (ones & ~(cross | up)), up & cross
        if score < best:
            best, end = score, at
    return best, end


class Matcher:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[int | None, str]], budget: float = BUDGET):
        import ahocorasick

        self.items = [(i, w, int(len(w) * budget)) for i, w in ((i, words_of(t)) for i, t in items) if w]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, words, k) in enumerate(self.items):
            for p in range(k + 1):
                low, high = len(words) * p // (k + 1), len(words) * (p + 1) // (k + 1)
                pieces.setdefault(f" {' '.join(words[low:high])} ", []).append((n, low))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> Iterator[tuple]:
        """(item_id, distance, words of the item, first and last word of the match) of each item that ``text`` holds."""
        if not text or not self.items:
            return
        joined = f" {' '.join(_WORD.findall(text.lower()))} "
        around: dict[int, list[tuple[int, int]]] = {}
        for end, (size, places) in self.automaton.iter(joined):
            for n, low in places:
                around.setdefault(n, []).append((end - size + 1, low))
        if not around:
            return
        words = joined.split()
        starts: dict[int, int] = {}
        at = 0
        for i, w in enumerate(words):  # character place of the space before each word
            starts[at] = i
            at += len(w) + 1
        for n in sorted(around):
            item_id, item, k = self.items[n]
            best: tuple | None = None
            begins = sorted({starts[char] - low for char, low in around[n]})  # a piece that repeats in the item isn't found in the order of these
            reach = -1
            for begin in begins:
                first, last = max(0, begin - k), min(len(words), begin + len(item) + k)
                if last <= reach:
                    continue  # within the stretch that was looked at last, as that began no later
                reach = last
                distance, end = myers(item, words[first:last])
                if distance <= k and (best is None or distance < best[0]):
                    back = myers(item[::-1], words[first : first + end][::-1])[1] if end else 0
                    best = (distance, len(item), first + end - back, first + end - 1)
            if best:
                yield item_id, *best


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int | None, str]]]:
    """Items in blocks of at most ``block_chars`` characters (or of one item); one block at a time is in the driver."""
    held: list[tuple[int | None, str]] = []
    size = 0
    for item_id, text in benchmark.where("text is not null").select("item_id", "text").toLocalIterator():
        if held and size + len(text) > block_chars:
            yield held
            held, size = [], 0
        held.append((item_id, text))
        size += len(text)
    if held:
        yield held


def _matcher(shared, budget: float) -> Matcher:
    """One automaton a worker and block."""
    key = (shared.id, budget)
    if _KNOWN.get("key") != key:
        _KNOWN.update(key=key, matcher=Matcher(shared.value, budget))
    return _KNOWN["matcher"]


_KNOWN: dict = {}


class _Shared:
    """A broadcast with an id that workers can tell blocks apart by."""

    def __init__(self, spark, value):
        self.broadcast = spark.sparkContext.broadcast(value)
        self.id = self.broadcast._jbroadcast.id() if self.broadcast._jbroadcast else id(self)

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def hits(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document and item it holds within the budget."""
    spark = docs.sparkSession
    out = None
    for block in item_blocks(benchmark, block_chars):
        shared = _Shared(spark, block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared, budget)
            return batched(((d, *hit) for d, t in rows_of(batches, "doc_id", "text") for hit in matcher.find(t)), _ARROW)

        part = docs.select("doc_id", "text").mapInArrow(run, HITS)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], HITS) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows whose text holds an item; all columns stay, nothing is shuffled.

    What a block leaves is written before the next one, so that a task holds the automaton of one block only.
    """
    for i, block in enumerate(item_blocks(benchmark, block_chars)):
        if i:
            docs, _ = written(docs, "clean-so-far")
        shared = _Shared(docs.sparkSession, block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared, budget)
            for batch in batches:
                yield batch.filter(pa.array([next(matcher.find(t), None) is None for (t,) in rows_of(iter([batch]), "text")], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
