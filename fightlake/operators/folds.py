"""Folds over rows in order, and texts met by many keywords, both without a plan or a group that grows with rules or keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that are sent on at once.
SENT = 4096


def folded(rows: DataFrame, key: list[str], order: list[str], out: str, fold: Callable) -> DataFrame:
    """What ``fold(key)`` gives for each key's rows in ``order``.

    ``fold`` makes an object with ``row(*values)``, given the columns that aren't of the key, and ``end()``; both return tuples of what follows the key in
    ``out``. Rows are streamed in sorted order, so a task holds one fold's state and never a group, and very many small keys cost no call each.
    """
    names = [c for c in rows.columns if c not in key]
    schema = to_arrow_schema(T.StructType.fromDDL(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now, state = None, None

        def sent() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held.clear()
            return batch

        for batch in batches:
            columns = {c: batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names)}
            for k, values in zip(zip(*(columns[c] for c in key), strict=True), zip(*(columns[c] for c in names), strict=True), strict=True):
                if state is None or k != now:
                    if state is not None:
                        held += [(*now, *x) for x in state.end()]
                    now, state = k, fold(k)
                held += [(*k, *x) for x in state.row(*values)]
                if len(held) >= SENT:
                    yield sent()
        if state is not None:
            held += [(*now, *x) for x in state.end()]
        if held:
            yield sent()

    return rows.select(*key, *names).repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, out)


class Keywords:
    """Which of many keywords a text holds: each place of the text is looked up by its next three letters."""

    def __init__(self, keywords: list[str]):
        self.short = [(i, k) for i, k in enumerate(keywords) if len(k) < 3]
        self.long: dict[str, list[tuple[int, str]]] = {}
        for i, k in enumerate(keywords):
            if len(k) >= 3:
                self.long.setdefault(k[:3], []).append((i, k))

    def __call__(self, text: str) -> list[int]:
        found = {i for i, k in self.short if k in text}
        for at in range(len(text) - 2):
            for i, k in self.long.get(text[at : at + 3], ()):
                if text.startswith(k, at):
                    found.add(i)
        return sorted(found)


#: Texts whose keywords a task remembers; logs have few different ones.
REMEMBERED = 1 << 16


def keywords_in(text: Column, keywords: list[str]) -> Column:
    """The numbers, ascending, of the keywords that a text holds in any case; none for a null. The plan has one node, however many keywords there are."""
    keywords = [k.lower() for k in keywords]

    def run(texts: pd.Series) -> pd.Series:
        match, memory = Keywords(keywords), {}
        out = []
        for t in texts:
            if t not in memory:
                if len(memory) >= REMEMBERED:
                    memory.clear()
                memory[t] = match(t) if t is not None else []
            out.append(memory[t])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<int>")(F.lower(text))
