"""Best-fit packing of documents into sequences, with bounds that certify how good each partition is.

A document is its ids with the end id. Only one longer than ``capacity`` is cut, into pieces of
``capacity``; its first piece may be shorter. Pieces of full length are sequences by themselves. The rest
are dealt to partitions; each packs its pieces best-fit decreasing. Dual-feasible functions over
the partition's length counts give a lower bound of its sequences. Where the bound is met the partition is
certified and done. Partitions with a gap give up the documents of their emptiest sequences; these are
exchanged between such partitions (dealt anew into fewer ones) and best-fit decreasing runs again, for
``rounds`` rounds. No round adds a sequence: a new packing is taken only if it needs fewer.

Defined cases: null or empty text is one piece of the end id alone; rows that repeat a doc_id, or have
none, are packed each by itself; ties in length go by doc_id, piece and checksum; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, drop_dir, rows_of, written
from .tokens import default_path, text_encoder

CAPACITY = 2048
#: Pieces that one partition packs, and rounds of exchange.
PIECES, ROUNDS = 50_000, 3

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece of ``docs`` (doc_id, text)."""
    path = path or default_path()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encoder = text_encoder(path)
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            ids = encoder.document(text)
            start = 0
            end = len(ids) % capacity or capacity
            piece = 0
            while start < len(ids):
                yield doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())
                start, end, piece = end, end + capacity, piece + 1
        encoder.rest()

    return docs.select("doc_id", "text").mapInArrow(lambda batches: batched(rows(batches), _PIECE_ARROW, 8192), PIECE)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Fewest sequences that any packing needs, by dual-feasible functions over the counts of lengths."""
    counts = np.bincount(lengths, minlength=capacity + 1).astype(object)
    size = np.arange(capacity + 1)
    best = -(-int((counts * size).sum()) // capacity)
    for low in range(0, capacity // 2 + 1, max(1, capacity // 256)):  # long pieces count whole, those below low not at all
        image = np.where(size > capacity - low, capacity, np.where(size < low, 0, size))
        best = max(best, -(-int((counts * image).sum()) // capacity))
    for k in range(1, 21):  # sizes rounded down to k-ths; exact (k + 1)-ths stay
        part, rest = np.divmod((k + 1) * size, capacity)
        scaled = np.where(rest == 0, k * size, part * capacity)  # in units of k * capacity
        best = max(best, -(-int((counts * scaled).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For lengths in descending order: each one's bin and offset, and the number of bins."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    n = 0
    for i, length in enumerate(lengths.tolist()):
        fit = rooms >> length
        if fit:
            room = length + (fit & -fit).bit_length() - 1
            held = by_room[room]
            b = held.pop()
            if not held:
                rooms ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - room
        by_room[room - length].append(b)
        rooms |= 1 << (room - length)
    return bins, offsets, n


def _pack(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """One partition packed; ``loose`` marks what it gives up: the emptiest sequences, if its bound isn't met."""
    pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
    lengths = pdf["length"].to_numpy(np.int64)
    bins, offsets, n = best_fit_decreasing(lengths, capacity)
    room = capacity - np.bincount(bins, lengths, minlength=n).astype(np.int64)
    loose = np.zeros(n, bool)
    gap = n - lower_bound(lengths, capacity)
    if gap > 0 or room.max() > capacity // 2:  # a half empty sequence may be shared with another partition
        loose = room >= max(1, min(capacity // 50, int(np.sort(room)[-min(n, 8 * (gap + 1))])))
    return pdf.assign(bin=bins, offset=offsets, loose=loose[bins])


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = PIECES, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` with sequence_id and offset; see the module's text."""
    spark = pieces.sparkSession
    pieces, _ = written(pieces, "pieces")
    full = pieces.where(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo = pieces.where(F.col("length") < capacity).withColumn("old", F.lit(None).cast("long")).withColumn("old_offset", F.lit(None).cast("long"))
    schema = f"{PIECE}, old long, old_offset long, part int, bin long, offset long, loose boolean"
    done = [full]
    before = None
    for r in range(rounds + 1):
        n = todo.count()
        if not n:
            break
        parts = -(-n // per_partition)
        dealt = todo.withColumn("part", F.pmod(F.xxhash64(F.lit(r), "doc_id", "piece", "ids_crc32", "length"), F.lit(parts)).cast("int"))
        packed, _ = written(dealt.groupBy("part").applyInPandas(lambda pdf: _pack(pdf, capacity), schema), "packed")
        sizes = packed.agg(F.countDistinct("part", "bin"), F.countDistinct("old")).first()
        if before is not None and sizes[0] >= sizes[1]:  # no better than before the exchange
            done.append(todo.select(*_names(), F.col("old").alias("sequence_id"), F.col("old_offset").alias("offset")))
            break
        named = packed.withColumn("sequence_id", (F.lit(r).cast("long") * (1 << 58)) + F.col("part").cast("long") * (1 << 32) + F.col("bin"))
        last = r == rounds
        done.append((named if last else named.where("not loose")).select(*_names(), "sequence_id", "offset"))
        todo = named.where("loose").select(*_names(), F.col("sequence_id").alias("old"), F.col("offset").alias("old_offset"))
        before = sizes[0]
        if last:
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _names() -> list[str]:
    return [c.split()[0] for c in PIECE.split(", ")]


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece of ``docs``."""
    return pack(pieces_of(docs, capacity, path), capacity)
