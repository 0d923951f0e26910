"""Connected components by contracting blocks of links and alternating large-star and small-star steps.

A block of at most ``BLOCK`` links is contracted in one task: its links become stars around the least node of each of the block's own
components, so there are never more links than nodes and long chains shrink at once. What one block can't see is joined by star steps: a
join and a map-side combined minimum over the current links, so no component is ever gathered in one task. If there is one block
only, its stars are the result. Each round is a written table in the shared folder. A node of very many links is split at run time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_dir, written

#: Links that one task contracts.
BLOCK = 1 << 20


def roots_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, root of each: the least node of its component) of some links."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        a, b = root[x], root[y]
        open_ = a != b
        if not open_.any():
            return nodes, nodes[root]
        x, y, low = x[open_], y[open_], np.minimum(a[open_], b[open_])
        np.minimum.at(root, a[open_], low)
        np.minimum.at(root, b[open_], low)
        while (root[root] != root).any():
            root = root[root]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        nodes, root = roots_of(*(np.concatenate(c) for c in zip(*held, strict=True)))
        apart = nodes != root
        yield pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(root[apart])], names=["u", "v"])


def connected_components(links: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b: long) but the roots; a root is the least node of its component.

    Nulls and loops link nothing; repeated links count once; without links the result is empty.
    """
    spark = links.sparkSession
    edges, path = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        blocks = max(1, -(-edges.count() // block))
        stars, star_path = written(edges.repartition(blocks).mapInArrow(_contract, "u long, v long"), "links")
        drop_dir(spark, path)
        edges, path = stars, star_path
        if blocks == 1:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are written, so that on either side only a sort stands between exchange and join: then a node of very many links is split at run time.
        least, least_path = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, large_path = written(large, "large-stars")
        least, small_path = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, new_path = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        drop_dir(spark, path, least_path, large_path, small_path)
        edges, path = after, new_path
        if state == before or state[0] == 0:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
