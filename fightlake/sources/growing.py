"""A folder of logs that are still written to, as a stream of their whole lines with true line numbers.

Spark's own file source reads a file once; this one remembers how many bytes and lines of each file have been read, so a file may grow, new files join,
and a line has the number that it has in the finished file, also after a restart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes that are looked at together.
CHUNK = 1 << 20
#: Bytes of a file that one task reads, if lines are shorter.
PIECE = 32 << 20
LINES = "log_path string, line_number long, line string"
_ARROW = pa.schema([("log_path", pa.string()), ("line_number", pa.int64()), ("line", pa.string())])
_LINE_END = re.compile("\r\n|\n|\r")


@dataclass
class Piece(InputPartition):
    name: str
    start: int
    end: int
    lines: int  # before it


class LineCounter:
    """Counts line ends (\\r\\n, \\n, \\r) of bytes that come in chunks."""

    def __init__(self, lines: int = 0):
        self.lines, self._cr = lines, False

    def add(self, chunk: bytes) -> None:
        self.lines += chunk.count(b"\n") + chunk.count(b"\r") - chunk.count(b"\r\n") - (self._cr and chunk.startswith(b"\n"))
        self._cr = chunk.endswith(b"\r")


class Folder:
    """Files of one folder in any store that pyarrow opens."""

    def __init__(self, path: str):
        self.files, self.base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))

    def sizes(self) -> dict[str, int]:
        found = self.files.get_file_info(fs.FileSelector(self.base))
        return {f.base_name: f.size for f in sorted(found, key=lambda f: f.base_name) if f.is_file and f.base_name.endswith(".txt")}

    def chunks(self, name: str, start: int, end: int) -> Iterator[bytes]:
        with self.files.open_input_file(f"{self.base}/{name}") as f:
            while start < end:
                f.seek(start)
                data = f.read(min(CHUNK, end - start))
                if not data:
                    return
                yield data
                start += len(data)

    def whole(self, name: str, start: int, end: int) -> int:
        """The place after the last \\n between ``start`` and ``end``, or ``start``; what follows isn't a whole line yet."""
        with self.files.open_input_file(f"{self.base}/{name}") as f:
            while end > start:
                low = max(start, end - CHUNK)
                f.seek(low)
                found = f.read(end - low).rfind(b"\n")
                if found >= 0:
                    return low + found + 1
                end = low
        return start

    def next_end(self, name: str, start: int, end: int) -> int | None:
        """The place after the first \\n from ``start`` on."""
        for chunk in self.chunks(name, start, end):
            found = chunk.find(b"\n")
            if found >= 0:
                return start + found + 1
            start += len(chunk)
        return None


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = Folder(options["path"])
        self.most = int(options.get("maxbytespertrigger") or options.get("maxBytesPerTrigger") or 0)
        self.known: dict[str, list[int]] = {}  # bytes and lines of each file as last told
        self.begun = False

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """(bytes, lines) of each file that are whole lines; names and sizes of one folder of logs, and counts of new bytes, no line of them.

        With ``maxBytesPerTrigger``, a step takes about so many bytes of all files together. Spark doesn't say where the stream stands when a query starts
        anew, so the first step after that takes what has been written meanwhile, and counts each file from its beginning.
        """
        left = self.most if self.most and self.begun else None
        out: dict[str, list[int]] = {}
        for name, size in self.folder.sizes().items():
            at, lines = self.known.get(name, [0, 0])
            if size < at:  # shorter than it was: another file of that name
                at, lines = 0, 0
            end = self.folder.whole(name, at, size if left is None else min(size, at + max(left, 0)))
            if end == at and left is not None and left > 0 and at + left < size:  # a line longer than what is left
                end = self.folder.next_end(name, at + left, size) or at
            counter = LineCounter(lines)
            for chunk in self.folder.chunks(name, at, end):
                counter.add(chunk)
            out[name] = [end, counter.lines]
            left = None if left is None else left - (end - at)
        self.known, self.begun = out, True
        return out

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        """What each file has more, in pieces of whole lines; a file that became shorter is read anew."""
        self.known, self.begun = {**{k: list(v) for k, v in end.items()}}, True
        pieces = []
        for name, (stop, _) in sorted(end.items()):
            at, lines = start.get(name, [0, 0])
            if at > stop:
                at, lines = 0, 0
            while at < stop:
                cut = min(stop, at + PIECE)
                cut = stop if cut == stop else self.folder.whole(name, at, cut)
                if cut == at:  # one line longer than a piece
                    cut = self.folder.next_end(name, at, stop)
                pieces.append(Piece(name, at, cut, lines))
                if cut < stop:
                    counter = LineCounter(lines)
                    for chunk in self.folder.chunks(name, at, cut):
                        counter.add(chunk)
                    lines = counter.lines
                at = cut
        return pieces

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        log, number, rest = piece.name.removesuffix(".txt"), piece.lines, b""
        for chunk in self.folder.chunks(piece.name, piece.start, piece.end):
            data = rest + chunk
            cut = data.rfind(b"\n") + 1
            data, rest = data[:cut], data[cut:]
            lines = _LINE_END.split(data.decode("cp1252", "replace"))[:-1]
            kept = [(number + i, x) for i, x in enumerate(lines, 1) if x]
            number += len(lines)
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([log] * len(kept)), pa.array([i for i, _ in kept], pa.int64()), pa.array([x for _, x in kept])], schema=_ARROW)

    def commit(self, end: dict) -> None:
        pass


class GrowingLogs(DataSource):
    """``spark.readStream.format("growing_logs").load(folder)``, after ``spark.dataSource.register(GrowingLogs)``.

    (log_path, line_number, line): lines are numbered from 1 as in the finished file, empty ones count but are left out; a line counts once its end is written.
    The folder must be one that driver and executors see, in a store that pyarrow opens. Lines are Windows-1252. Option ``maxBytesPerTrigger``.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(self.options)
