import gzip
import hashlib
import random
from pathlib import Path
from urllib.parse import urlparse

import pytest

from fightlake.llm import warc as W
from fightlake.llm.common import shared_dir


def pages(spark):
    rng = random.Random(1)
    long = "".join(rng.choices("abcé<>\r\n", k=1500))
    rows = [(i, f"http://x/{i}", rng.choice([long, long + "x", "short", "", f"{i}" * 900]), "a", 1) for i in range(80)]
    rows += [(500, None, None, "a", 1), (501, "http://x/\r\nWARC/1.1", "WARC/1.1\r\n\r\n\r\n", "b", 2), (None, "u", long, "c", 3), (None, "u", "alone", "c", 3), (79, "again", long, "d", 4), (79, "again", long, "d", 4), (502, "big", "<p>" * 900000, "e", 5)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, path string, at long")


def test_round_trip_and_revisits(spark):
    rows, frame = pages(spark)
    best = {}
    for page_id, _, html, *_ in rows:
        if page_id is not None:
            best[html or ""] = max(best.get(html or "", page_id), page_id)
    want = []
    for page_id, url, html, *_ in rows:
        data = (html or "").encode()
        revisit = len(data) >= 1000 and html in best and (page_id is None or page_id < best[html])
        want.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", best[html] if revisit else None, None if revisit else html or ""))
    archives = W.write_archives(W.with_revisits(frame), shared_dir(spark, "warc"))
    index = W.normalise(archives, shared_dir(spark, "members"))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.html) for r in W.read_records(index).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    for r in index.collect():  # each record is a member by itself, and the sidecar says where
        data = Path(urlparse(r.path).path).read_bytes()[r["at"] : r["at"] + r.size]
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: " + r.kind.encode())
        assert f"{r['at']} {r.size} {r.kind} {r.record_id}" in Path(urlparse(r.path).path + ".idx").read_text().splitlines()
    assert W.read_records(W.normalise(W.write_archives(W.with_revisits(frame.limit(0)), shared_dir(spark, "warc")), shared_dir(spark, "m"))).count() == 0


def test_streams_of_any_chunking_members_and_damage():
    whole = b"".join(W.record(i, "u", "text\r\n\r\nWARC/1.1 " * i, None) for i in range(30))
    members = gzip.compress(whole[:700]) + gzip.compress(whole[700:]) + b"\0" * 9
    for data in (gzip.compress(whole), members):
        for step in (1, 7, 1000, 10**6):
            at = 0

            def read(_):
                nonlocal at
                at += step
                return data[at - step : at]

            assert b"".join(W.inflated(read)) == whole
    for size in (1, 3, 64, 10**6):
        chunks = iter([whole[i : i + size] for i in range(0, len(whole), size)])
        got = [b"".join(p) for _, p in W.records(chunks)]
        assert len(got) == 30 and b"".join(g + b"\r\n\r\n" for g in got) == whole
    with pytest.raises(ValueError):
        it = iter([gzip.compress(whole)[:-20], b""])
        list(W.inflated(lambda _: next(it)))
    with pytest.raises(ValueError):
        list(W.records(iter([whole[:-200]])))


def test_a_digest_of_very_many_pages_is_split_at_run_time(spark):
    from pyspark.sql import functions as F

    from fightlake.llm.warc import later_pages

    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        keys = spark.range(0, 40_000, 1, 8).select(F.col("id").alias("page_id"), F.when(F.col("id") % 10 < 8, F.sha1(F.lit("hot"))).otherwise(F.sha1(F.floor(F.col("id") / 10).cast("string"))).alias("digest")).distinct()
        later = later_pages(keys)
        assert len(later.collect()) == 31_999 + 4_000
        assert "skew=true" in later._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
