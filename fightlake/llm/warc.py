"""WARC archives: writing pages, normalising whole-file gzip to one member a record with an offset index, reading back.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the largest page_id is a response and the
others are revisits that name it. :func:`write_archives` writes each partition as one gzip stream, as some crawlers do.
:func:`normalise` inflates such a file once as a stream (several members are read too), writes every record as its own
member and, beside the archive, a sidecar ``.idx`` with a line for each record: offset, length, type, record id. The same lines
come back as a table, with which :func:`read_records` opens any record by itself.

Which pages are revisits is decided over (page_id, digest, size) alone: equal payloads are counted with map-side
combining, and the join by digest, which a payload of very many pages makes uneven, has no html in it.
No whole archive is held in memory: files are read in chunks, and a record is recompressed as it comes.

Defined cases: null html is an empty payload; a null url is empty; a null page_id is a response that nothing refers to, unless a page with
an id has the same payload, then a revisit of it; rows that repeat the largest page_id of a group are all responses; ties need no choice,
as revisits name a page_id; an empty table gives no file and no record; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, rows_of, written

MIN_REVISIT = 1000
#: Bytes read, and inflated, at a time: what is held is copied for each record, so it is kept small.
CHUNK = 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIELD = re.compile(rb"(?im)^([\w-]+):[ \t]*(.*?)\r?$")

INDEX = "path string, at long, size long, kind string, record_id string"
_INDEX_ARROW = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in INDEX.split(", ")])
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
_RECORDS_ARROW = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in RECORDS.split(", ")])


def later_pages(keys: DataFrame) -> DataFrame:
    """(page_id, digest, best) of the ``keys`` (page_id, digest; each once) whose digest a page of larger number has."""
    best = keys.groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1 and best is not null").select("digest", "best")
    # Written, so that on either side only a sort stands between exchange and join: then a digest that very many pages have is split at run time.
    best, _ = written(best, "responses")
    return keys.join(best.hint("merge"), "digest").where("page_id is null or page_id < best")


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, html, refers_to) with the response's page_id where the page is a revisit."""
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("digest"))
    keys = pages.where(F.octet_length("html") >= min_bytes).select("page_id", "digest").distinct()
    later = later_pages(keys)
    revisits, _ = written(later.select(F.col("page_id").alias("of"), F.col("digest").alias("its_digest"), F.col("best").alias("refers_to")), "revisits")
    match = F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("its_digest"))
    return pages.join(revisits.hint("merge"), match, "left").select("page_id", "url", "html", "refers_to")


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    tail = (urn or ":none>")[:-1].rpartition(":")[2]
    return None if tail == "none" else int(tail)


def record(page_id: int | None, url: str | None, html: str, refers_to: int | None) -> bytes:
    payload = html.encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    safe = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Target-URI: {safe}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    return {k.decode().lower(): v.decode() for k, v in _FIELD.findall(head)}


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Each partition of ``pages`` (page_id, url, html, refers_to) as one gzip stream; the paths as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        context = TaskContext.get()
        name = f"{folder}/pages-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        out = None
        for row in rows_of(batches, "page_id", "url", "html", "refers_to"):
            if out is None:
                store, at = fs.FileSystem.from_uri(name)
                store.create_dir(at.rpartition("/")[0])
                out, gzip = store.open_output_stream(at, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
            out.write(gzip.compress(record(*row)))
        if out is not None:
            out.write(gzip.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["path"])

    return written(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string"), "archives")[0]


def inflated(read) -> Iterator[bytes]:
    """The content of a gzip file in chunks; ``read(n)`` gives the next bytes."""
    inflate, begun = zlib.decompressobj(31), False
    while data := read(CHUNK):
        while data:
            if not begun and not (data := data.lstrip(b"\0")):  # padding between members
                break
            begun = True
            yield inflate.decompress(data, CHUNK)
            if inflate.eof:
                data, inflate, begun = inflate.unused_data, zlib.decompressobj(31), False
            else:
                data = inflate.unconsumed_tail
    while begun and not inflate.eof and (more := inflate.decompress(b"", CHUNK)):
        yield more
    if begun and not inflate.eof:
        raise ValueError("the gzip stream ends early")


def records(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, Iterator[bytes]]]:
    """(head, pieces of the whole record) of each record; the pieces must be used up before the next."""
    held = b""

    def more() -> bool:
        nonlocal held
        chunk = next(chunks, None)
        held += chunk or b""
        return chunk is not None

    while True:
        held = held.lstrip(b"\r\n")
        while not held:  # reads on only when nothing is held, so that no more than a chunk and a record's head ever is
            if not more():
                return
            held = held.lstrip(b"\r\n")
        seen = 0
        while (end := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(held) - 3)
            if not more():
                raise ValueError("a record's head ends early")
        head = held[: end + 4]
        if not head.startswith(b"WARC/") or "content-length" not in (found := fields(head)):
            raise ValueError("not a WARC record")

        def pieces(left: int) -> Iterator[bytes]:
            nonlocal held
            while left:
                if not held and not more():
                    raise ValueError("a record's content ends early")
                part, held = held[:left], held[left:]
                left -= len(part)
                yield part

        rest = pieces(len(head) + int(found["content-length"]))
        yield head, rest
        for _ in rest:
            pass


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Archives (path) rewritten under ``folder`` with one member a record; the offset index as a table."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        from pyarrow import fs

        for (source,) in rows_of(batches, "path"):
            store, at = fs.FileSystem.from_uri(source)
            name = f"{folder}/{source.rpartition('/')[2].removesuffix('.warc.gz')}-{TaskContext.get().taskAttemptId()}.warc.gz"
            target, to = fs.FileSystem.from_uri(name)
            target.create_dir(to.rpartition("/")[0])
            place = 0
            with store.open_input_stream(at, compression=None) as f, target.open_output_stream(to, compression=None) as out, target.open_output_stream(f"{to}.idx") as side:
                for head, pieces in records(inflated(f.read)):
                    gzip, size = zlib.compressobj(6, zlib.DEFLATED, 31), 0
                    for piece in pieces:
                        size += out.write(gzip.compress(piece))
                    size += out.write(gzip.compress(b"\r\n\r\n") + gzip.flush())
                    found = fields(head)
                    row = (name, place, size, found.get("warc-type"), found.get("warc-record-id"))
                    side.write(f"{place} {size} {row[3]} {row[4]}\n".encode())
                    place += size
                    yield row

    # A task a file: by size alone, adaptive execution would put the few short rows into one task.
    spread = archives.select("path").repartition(max(1, archives.count()), "path")
    return written(spread.mapInArrow(lambda batches: batched(rows(batches), _INDEX_ARROW, 8192), INDEX), "warc-index")[0]


def read_records(index: DataFrame, with_html: bool = True) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest[, html]) of the records that ``index`` names."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        from pyarrow import fs

        path, f = None, None
        for name, at, size in rows_of(batches, "path", "at", "size"):
            if name != path:
                if f:
                    f.close()
                store, where = fs.FileSystem.from_uri(name)
                path, f = name, store.open_input_file(where)
            data = zlib.decompress(f.read_at(size, at), 31)
            head, _, rest = data.partition(b"\r\n\r\n")
            found = fields(head)
            http, _, payload = rest[: int(found["content-length"])].partition(b"\r\n\r\n")
            n = int(fields(http)["content-length"])
            digest = base64.b32decode(found["warc-payload-digest"].removeprefix("sha1:")).hex()
            revisit = found["warc-type"] == "revisit"
            if not revisit and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
                raise ValueError(f"damaged record {found['warc-record-id']} in {name}")
            row = (_page(found["warc-record-id"]), found["warc-target-uri"], found["warc-type"], _page(found.get("warc-refers-to")), n, digest)
            yield (*row, None if revisit else payload.decode()) if with_html else row
        if f:
            f.close()

    schema, ddl = (_RECORDS_ARROW.append(pa.field("html", pa.string())), f"{RECORDS}, html string") if with_html else (_RECORDS_ARROW, RECORDS)
    files = index.select("path").distinct().count()
    ordered = index.select("path", "at", "size").repartition(max(1, files), "path").sortWithinPartitions("path", "at")
    return ordered.mapInArrow(lambda batches: batched(rows(batches), schema, 2048), ddl)
