import math
import random

import numpy as np
import pytest

from fightlake.llm import hard_negatives as H
from fightlake.llm.queries import op12_hard_negatives
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, label int, score string"
LONGS = -(1 << 63), (1 << 63) - 1


def plain(rows, anchor, label, each=5, floor=80):
    kept = []
    for i, v, lab, *_ in rows:
        lab = None if i is None else label(i, lab)
        if i is None or lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, lab, [int(max(-1e300, min(1e300, math.floor(256 * x)))) if abs(x) < 1e300 else int(math.copysign(1e300, x)) for x in v]))
    out = []
    for i, lab, v in kept:
        if not anchor(i):
            continue
        scored = [(max(LONGS[0], min(LONGS[1], sum(x * y for x, y in zip(v, w, strict=False)))), j, k) for j, k, w in kept if j != i]
        scored.sort(key=lambda r: (-r[0], r[1]))
        for ps, pid, _ in [r for r in scored if r[2] == lab][:each]:
            ns = [r for r in scored if r[2] != lab and floor * ps <= 100 * r[0] <= 100 * ps][:each]
            out += [(i, pid, rank, nid, ps, s) for rank, (s, nid, _) in enumerate(ns, 1)]
    return sorted(out)


def clustered(rng, n, dim=12, labels=4, spread=0.25):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(centres)], rng.randrange(labels), "x") for i in range(n)]


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("block", [4096, 7])
def test_against_brute_force(spark, block):
    rng = random.Random(block)
    rows = clustered(rng, 700)
    rows += [(10_000 + i, rows[5][1], i % 3, "copies") for i in range(150)]  # a large group of ties
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows, lambda i: i % 23 == 0, lambda i, lab: lab)
    assert len(want) > 300
    assert got(H.mine(df, F.col("id") % 23 == 0, block=block)) == want


def test_query_with_moved_labels_and_rows_that_take_no_part(spark, tmp_path):
    rng = random.Random(2)
    rows = clustered(rng, 400, labels=10)
    rows += [(700, None, 1, ""), (800, [1.0] * 12, None, ""), (900, [1.0, None] * 6, 1, ""), (1000, [float("nan")] * 12, 1, ""), (1001, [float("inf")] * 12, 1, ""), (None, [1.0] * 12, 1, "")]
    rows += [(1100, [], 3, ""), (1101, [0.5], 3, ""), (1102, [0.0] * 12, 5, ""), (1200, [-1.0] * 12, 2, "")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = plain(rows, lambda i: i % 100 == 0, lambda i, lab: None if lab is None else (lab + 1) % 10 if i % 7 == 0 else lab)
    assert want and got(op12_hard_negatives(spark, str(tmp_path))) == want
    empty = spark.createDataFrame([], SCHEMA)
    assert H.mine(empty, F.col("id") % 100 == 0).count() == 0


def test_very_large_components_are_scored_exactly(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([1e300, -1e17, 3e7, 1e-3, 5e5, -2.0, 0.0]) * rng.random() for _ in range(4)], i % 2, "") for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(H.mine(df, F.col("id") % 10 == 0)) == plain(rows, lambda i: i % 10 == 0, lambda i, lab: lab)


def test_bounds_hold_and_windows_are_dropped():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16))
    where = np.sort(rng.integers(0, 8, 4096))
    ints = np.floor(256 * (centres[where] + 0.05 * rng.normal(size=(4096, 16))) * rng.uniform(0.5, 2, (4096, 1)))
    refs = centres / np.linalg.norm(centres, axis=1)[:, None]
    norms, angles = H._angles(ints, refs)
    rows = H.Vectors(np.arange(4096), where % 3, [v.tobytes() for v in ints], norms, [a.tobytes() for a in angles])
    some = np.arange(0, 4096, 97)
    anchors = H.Vectors(some, where[some] % 3, [ints[i].tobytes() for i in some], norms[some], [angles[i].tobytes() for i in some])
    exact = rows.scores(anchors.ints)
    search = H.Search(anchors, np.arange(len(some)), True, np.full(len(some), H._LONG.min), np.full(len(some), H._LONG.max), 5, H._own_floor(anchors, np.arange(len(some)), True, np.full(len(some), H._LONG.min), np.full(len(some), H._LONG.max), 5))
    for at in range(0, 4096, H.WINDOW):
        part = slice(at, at + H.WINDOW)
        low, high = H.score_bounds(anchors.norms, anchors.angles, (norms[part].min(), norms[part].max()), angles[part].min(0), angles[part].max(0))
        assert (low <= exact[part].min(0)).all() and (exact[part].max(0) <= high).all()
        search.add(H.Vectors(rows.ids[part], rows.labels[part], [v.tobytes() for v in ints[part]], norms[part], [a.tobytes() for a in angles[part]]))
    assert search.scored < 0.4 * search.windows  # most windows aren't scored
