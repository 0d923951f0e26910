"""Token-id files with a static range asymmetric numeral system (rANS).

Documents are dealt out by ranges of doc_id and sorted, so the files, in order, hold the ids of all documents in
ascending doc_id order. A file is a row of segments. A segment counts its ids once and has one frequency table
that all its blocks share. A block holds whole documents (the last one may make it long), is encoded by itself in
``LANES`` interleaved streams, and carries its documents' ids and lengths and a CRC-32 of its token ids. The index,
a Parquet table, has a checkpoint for each block: file, byte offsets of table and block, and how many ids precede
it in the file; any block can be decoded alone, in any order, by any task.

Layout (little-endian). Segment: ``FLR1``, u32 length of the packed table, table (zlib of one u32 frequency for each
id up to the largest; the frequencies sum to 2**BITS), blocks. Block: u32 ids, u32 documents, u32 bytes of packed
document table, u32 words, u32 CRC-32 of the ids, document table (zlib of i64 doc_ids, u32 lengths, u8 null marks),
u64 states of the lanes, u32 words. Id i of a block is step i // LANES of lane i % LANES.

A file is written under a name with its task attempt, and only the index names files, so what a lost or
repeated attempt leaves behind is never read.

Defined cases: null or empty text gives the end id alone; a null doc_id comes first; rows that repeat a doc_id each
are a document, in order of text; an empty table gives no file and no row; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batched, rows_of
from .tokens import default_path, text_encoder

LANES = 4096
#: Bits of the frequencies' sum, ids of a block and of a segment (at least, as documents stay whole).
BITS, BLOCK, SEGMENT = 18, 1 << 19, 1 << 22
#: Files whose ids are summed in one task.
GROUP = 1024
#: Pieces that an encoder remembers in each of two generations, about 150 bytes each; a task has no other large table.
PIECES = 1 << 19
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_BITS = np.uint64(BITS)
_MASK = np.uint64((1 << BITS) - 1)

INDEX = "file_no long, path string, table_at long, table_bytes long, block_at long, block_bytes long, n_ids long, n_docs long, ids_before long"
_INDEX_ARROW = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in INDEX.split(", ")])


def quantised(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**BITS, at least 1 where an id occurs."""
    total = 1 << BITS
    if np.count_nonzero(counts) > total:
        raise ValueError(f"more than {total} different ids")
    freq = np.where(counts > 0, np.maximum(1, counts * total // counts.sum()), 0).astype(np.int64)
    over = int(freq.sum()) - total
    if over < 0:
        freq[np.argmax(freq)] -= over
    while over > 0:
        order = np.argsort(-freq, kind="stable")[: max(1, min(over, np.count_nonzero(freq > 1)))]
        cut = np.minimum(freq[order] - 1, -(-over // len(order)))
        spare = int(cut.sum()) - over
        if spare > 0:
            cut -= np.clip(spare - np.concatenate([[0], np.cumsum(cut[:-1])]), 0, cut)
        freq[order] -= cut
        over = int(freq.sum()) - total
    return freq


class Table:
    """A frequency table, ready to encode and decode with."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.low = (np.cumsum(freq) - freq).astype(np.uint64)
        self.limit = self.freq << np.uint64(63 - BITS)  # a state at or over this gives a word away first
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.rows = np.stack([self.freq, self.limit, self.low], axis=1)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states, words) of one block."""
        state = np.full(LANES, _LOW, np.uint64)
        words: list[np.ndarray] = []
        for step in range(-(-len(ids) // LANES) - 1, -1, -1):
            part = ids[step * LANES : (step + 1) * LANES]
            x = state[: len(part)]
            f, limit, low = self.rows[part].T
            full = np.flatnonzero(x >= limit)
            if len(full):
                words.append((x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
                x[full] >>= _WORD
            q = x // f
            x += q * ((np.uint64(1) << _BITS) - f) + low  # (q << BITS) + x % f + low
        return state, np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)

    def decode(self, n: int, state: np.ndarray, words: np.ndarray) -> np.ndarray:
        ids = np.empty(n, np.uint32)
        state, words, at = state.copy(), words.astype(np.uint64), 0
        for i in range(0, n, LANES):
            x = state[: min(LANES, n - i)]
            slot = x & _MASK
            got = self.symbol[slot]
            ids[i : i + len(x)] = got
            f, _, low = self.rows[got].T
            x = f * (x >> _BITS) + slot - low
            thin = np.flatnonzero(x < _LOW)
            if len(thin):
                x[thin] = (x[thin] << _WORD) | words[at : at + len(thin)]
                at += len(thin)
            state[: len(x)] = x
        if at != len(words) or (state != _LOW).any():
            raise ValueError("the block is damaged: states or words left over")
        return ids

    def packed(self) -> bytes:
        return zlib.compress(self.freq.astype("<u4").tobytes(), 6)

    @classmethod
    def unpacked(cls, data: bytes) -> Table:
        return cls(np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64))


def packed_block(table: Table, docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    ids = np.concatenate([x for _, x in docs])
    names = zlib.compress(
        np.array([d or 0 for d, _ in docs], "<i8").tobytes() + np.array([len(x) for _, x in docs], "<u4").tobytes() + np.array([d is None for d, _ in docs], np.uint8).tobytes(), 6
    )
    state, words = table.encode(ids)
    head = struct.pack("<5I", len(ids), len(docs), len(names), len(words), zlib.crc32(ids.astype("<u4").tobytes()))
    return head + names + state.astype("<u8").tobytes() + words.astype("<u4").tobytes()


def unpacked_block(table: Table, data: bytes) -> list[tuple[int | None, np.ndarray]]:
    n, docs, size, n_words, crc = struct.unpack_from("<5I", data)
    at = 20 + size
    names = zlib.decompress(data[20:at])
    doc_ids, lengths, null = np.frombuffer(names, "<i8", docs), np.frombuffer(names, "<u4", docs, 8 * docs), np.frombuffer(names, np.uint8, docs, 12 * docs)
    ids = table.decode(n, np.frombuffer(data, "<u8", LANES, at).astype(np.uint64), np.frombuffer(data, "<u4", n_words, at + 8 * LANES))
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("the block is damaged: wrong checksum")
    ends = np.cumsum(lengths.astype(np.int64))
    return [(None if z else int(d), ids[e - k : e]) for d, k, e, z in zip(doc_ids, lengths.astype(np.int64), ends, null, strict=True)]


class Writer:
    """Writes segments to an open stream and tells the checkpoint of each block."""

    def __init__(self, out, block: int = BLOCK):
        self.out, self.block, self.at, self.ids = out, block, 0, 0

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data)

    def segment(self, docs: list[tuple[int | None, np.ndarray]]) -> Iterator[tuple]:
        """(table_at, table_bytes, block_at, block_bytes, n_ids, n_docs, ids_before) of each block."""
        counts = np.bincount(np.concatenate([x for _, x in docs]))
        table = Table(quantised(counts))
        packed = table.packed()
        table_at = self._put(b"FLR1" + struct.pack("<I", len(packed))) + 8
        self._put(packed)
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0
        for i, doc in enumerate(docs):
            held.append(doc)
            size += len(doc[1])
            if size >= self.block or i == len(docs) - 1:
                data = packed_block(table, held)
                yield table_at, len(packed), self._put(data), len(data), size, len(held), self.ids
                self.ids += size
                held, size = [], 0


def write_ids(docs: DataFrame, folder: str, path: str | None = None, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files under ``folder`` (a URI that all executors share); the index as a table."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        encoder = text_encoder(path, PIECES)
        context = TaskContext.get()
        name = f"{folder}/ids-{context.partitionId():06d}-{context.taskAttemptId()}.rans"

        def rows() -> Iterator[tuple]:
            out = writer = None
            held: list[tuple[int | None, np.ndarray]] = []
            size = 0
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                if out is None:
                    store, at = fs.FileSystem.from_uri(name)
                    store.create_dir(at.rpartition("/")[0])
                    out = store.open_output_stream(at)
                    writer = Writer(out, block)
                held.append((doc_id, encoder.document(text)))
                size += len(held[-1][1])
                if size >= segment:
                    yield from ((context.partitionId(), name, *x) for x in writer.segment(held))
                    held, size = [], 0
            if held:
                yield from ((context.partitionId(), name, *x) for x in writer.segment(held))
            if out is not None:
                out.close()

        yield from batched(rows(), _INDEX_ARROW)

    # A beginning of the text keeps the order of texts and lets rows that repeat a doc_id part.
    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    index = f"{folder}/index"
    dealt.mapInArrow(run, INDEX).write.parquet(index)
    return docs.sparkSession.read.schema(INDEX).parquet(index)


def _with_base(index: DataFrame) -> DataFrame:
    """``index`` with ``base``, the number of ids in all files before, by running sums within groups of ``GROUP`` files and over these."""
    group = F.floor(F.col("file_no") / GROUP)
    files = index.groupBy("file_no").agg(F.sum("n_ids").alias("n")).withColumn("g", group)
    inside = files.withColumn("inside", F.sum("n").over(Window.partitionBy("g").orderBy("file_no")) - F.col("n"))
    # One row for each GROUP files, so the one task that sums these gets few.
    groups = files.groupBy("g").agg(F.sum("n").alias("m")).withColumn("outside", F.sum("m").over(Window.orderBy("g")) - F.col("m"))
    bases = inside.join(groups.hint("merge"), "g").select("file_no", (F.col("inside") + F.col("outside")).alias("base"))
    return index.join(bases.hint("merge"), "file_no")


def read_ids(index: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids: binary of u32]) decoded from the files that ``index`` names."""
    placed = _with_base(index.select("file_no", "path", "table_at", "table_bytes", "block_at", "block_bytes", "n_ids", "ids_before"))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        from pyarrow import fs

        known: tuple = (None, None)
        for base, name, table_at, table_bytes, block_at, block_bytes, before in rows_of(batches, "base", "path", "table_at", "table_bytes", "block_at", "block_bytes", "ids_before"):
            store, at = fs.FileSystem.from_uri(name)
            with store.open_input_file(at) as f:
                if known[0] != (name, table_at):
                    known = ((name, table_at), Table.unpacked(f.read_at(table_bytes, table_at)))
                data = f.read_at(block_bytes, block_at)
            start = base + before
            for doc_id, ids in unpacked_block(known[1], data):
                raw = ids.astype("<u4").tobytes()
                yield (doc_id, start, len(ids), zlib.crc32(raw), *[raw] * with_ids)
                start += len(ids)

    schema = pa.schema(fields)
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    # As many partitions as files: by size alone, adaptive execution would put this small table into one task.
    files = index.select("path").distinct().count()
    spread = placed.repartition(max(1, files), "path", "table_at").sortWithinPartitions("path", "table_at", "block_at")
    return spread.mapInArrow(lambda batches: batched(rows(batches), schema, 8192), ddl)
