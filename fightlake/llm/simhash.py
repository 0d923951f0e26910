"""SimHash near-dedup with a Gray-order hierarchical index.

A fingerprint has a bit set where over half of a text's shingle hashes (repeats included) have it.
Two fingerprints link at ``radius`` or fewer differing bits. The join is whole:

* The 64 bits are cut into ``radius + free`` blocks. Two linked fingerprints agree on at least
  ``free`` of them, so each choice of ``free`` blocks is one table: there the chosen blocks come first
  and the permuted fingerprint is replaced by its Gray rank. Rows with the same leading blocks are
  contiguous in Gray order and form a shard; shards are dealt out by Spark.
* In a shard, sorted by Gray rank, runs of neighbours form nodes, runs of nodes form upper nodes. A node
  holds the bits that all below it share (mask and pattern). The join walks down from the pair (root, root);
  a pair of nodes whose shared bits already differ in more than ``radius`` places is dropped with all
  that is below, and so is one whose members are in one component already.
* A shard returns a spanning forest of its links, never all pairs. Equal fingerprints are one node from
  the start, so exact copies cost nothing.

Components come from :mod:`components`.

Defined cases: null text is the empty text; texts without words have fingerprint zero and link like
any other; fewer words than a shingle are one shingle; a null doc_id takes part but never names a
component that has another; rows that repeat a doc_id each give a row; an empty table gives none; other
columns are ignored by :func:`near_duplicates` and kept by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, drop_dir, rows_of, written
from .components import connected_components

SEED = 42
#: Children of a node, and node pairs looked at in one step.
FAN, STEP = 8, 1 << 19
#: Independent fingerprints of a text where a similarity is asked for, and the bits in which all of them together may differ (at
#: a similarity of 0.8 the number of these is binomial, 38.8 of 256 in the mean, and 0.99 of it is below this).
PRINTS, TOGETHER = 4, 52
#: Rows of shards that are worked on together.
ROWS = 1 << 17
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
_SIGN = np.uint64(1 << 63)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each ``size``-word shingle, in order, of the text with A-Z in lower case."""
    words = (text or "").encode().lower().split()  # for bytes: exactly A-Z, and space and \\x09-\\x0d
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that over half of the shingle hashes have."""
    if not len(hashes):
        return 0
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(((d, _signed(fingerprint(shingle_hashes(t, size)))) for d, t in rows_of(batches, "doc_id", "text")), schema, 8192)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def block_tables(radius: int, free: int) -> list[tuple[list[tuple[int, int]], int]]:
    """For each choice of ``free`` blocks: the (low bit, width) of all blocks, chosen ones first, and the chosen bits' number."""
    n = radius + free
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [(edges[i], edges[i + 1] - edges[i]) for i in range(n)]
    return [([blocks[i] for i in c] + [b for i, b in enumerate(blocks) if i not in c], sum(blocks[i][1] for i in c)) for c in combinations(range(n), free)]


def _permute(x: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    out, at = np.zeros_like(x), 64
    for low, width in order:
        at -= width
        out |= ((x >> np.uint64(low)) & np.uint64((1 << width) - 1)) << np.uint64(at)
    return out


def _unpermute(x: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    out, at = np.zeros_like(x), 64
    for low, width in order:
        at -= width
        out |= ((x >> np.uint64(at)) & np.uint64((1 << width) - 1)) << np.uint64(low)
    return out


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def gray_code(rank: np.ndarray) -> np.ndarray:
    return rank ^ (rank >> np.uint64(1))


def _deal(radius: int, free: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = block_tables(radius, free)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            fp = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for t, (order, width) in enumerate(tables):
                rank = gray_rank(_permute(fp, order))
                shard = (rank >> np.uint64(64 - width)).astype(np.int64) | (t << 40)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array((rank ^ _SIGN).view(np.int64))], names=["shard", "place"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Whole shards, many at a time, from rows sorted by (shard, place, ...); shards of one row are left out."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def cut(last: bool) -> Iterator[tuple[np.ndarray, ...]]:
        nonlocal held, size
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        end = len(cols[0]) if last else int(np.searchsorted(cols[0], cols[0][-1]))
        held, size = ([] if last else [tuple(c[end:] for c in cols)]), len(cols[0]) - end
        cols = [c[:end] for c in cols]
        same = cols[0][1:] == cols[0][:-1]
        many = np.zeros(end, bool)
        many[1:] |= same
        many[:-1] |= same
        if many.any():
            yield tuple(c[many] for c in cols)

    limit = ROWS
    for batch in batches:
        held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
        size += batch.num_rows
        if size >= limit:
            yield from cut(False)
            limit = max(ROWS, 2 * size)
    if size:
        yield from cut(True)


def _forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of links, earlier ones preferred, that join components; ``label`` (least member) is brought up to date."""
    chosen = []
    keep = np.arange(len(a))
    while True:
        la, lb = label[a[keep]], label[b[keep]]
        open_ = la != lb
        keep, la, lb = keep[open_], la[open_], lb[open_]
        if not len(keep):
            return np.concatenate(chosen) if chosen else keep
        best = np.full(len(label), len(a))
        np.minimum.at(best, la, keep)
        np.minimum.at(best, lb, keep)
        pick = np.unique(best[best < len(a)])
        chosen.append(pick)
        x, y = label[a[pick]], label[b[pick]]
        root = np.arange(len(label))
        while True:
            low = np.minimum(root[x], root[y])
            if (root[x] == low).all() and (root[y] == low).all():
                break
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            np.minimum.at(root, root[x], low)
            np.minimum.at(root, root[y], low)
            root = root[root]
        while (root[root] != root).any():
            root = root[root]
        label[:] = root[label]


def shard_links(
    shard: np.ndarray, code: np.ndarray, radius: int, label: np.ndarray | None = None, banned: np.ndarray | None = None, name: np.ndarray | None = None, forests: int = 1, accept: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spanning forest (a, b, distance; a and b are row numbers) of the links inside shards of two rows or more; closer links first.

    ``label`` has the least row of the component that each row is in already, ``banned`` the links that are left out
    (ascending, the lesser row times the number of rows plus the greater), ``name`` what equally close links are ordered by.
    ``forests`` over 1 adds links that more forests of the rest would have, as far as these are at hand. ``accept`` tells of pairs of rows which may be links.
    """
    n = len(code)
    name = code if name is None else name
    joined = label is not None
    levels = [(np.arange(n + 1), code, code)]  # bounds among the nodes below, AND, OR
    roots = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
    rows = [np.arange(n + 1)]  # bounds among the rows
    while (np.diff(roots) > 1).any():
        width = np.diff(roots)
        groups = -(-width // FAN)
        start = np.repeat(roots[:-1], groups) + FAN * (np.arange(groups.sum()) - np.repeat(np.cumsum(groups) - groups, groups))
        _, low, high = levels[-1]
        levels.append((np.append(start, roots[-1]), np.bitwise_and.reduceat(low, start), np.bitwise_or.reduceat(high, start)))
        rows.append(rows[-1][levels[-1][0]])
        roots = np.concatenate([[0], np.cumsum(groups)])
    masks = [~(low ^ high) for _, low, high in levels]
    leaves, ends = levels[1][0][:-1], levels[1][0][1:]
    member = np.minimum(leaves[:, None] + np.arange(FAN), ends[:, None] - 1)  # short leaves repeat their last row
    codes = code[member]
    label = label.copy() if joined else np.arange(n)
    spans: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    holds = 0

    def join_held() -> None:
        nonlocal holds
        a, b, d = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((np.maximum(name[a], name[b]), np.minimum(name[a], name[b]), d))
        a, b, d = a[order], b[order], d[order]
        before = label.copy() if forests > 1 else label
        pick = _forest(label, a, b)
        out.append((a[pick], b[pick], d[pick]))
        for _ in range(forests - 1):
            a, b, d = (np.delete(c, pick) for c in (a, b, d))
            if not len(a):
                break
            pick = _forest(before.copy(), a, b)
            out.append((a[pick], b[pick], d[pick]))
        held.clear()
        spans.clear()
        holds = 0

    def children(level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        below = levels[level][0]
        na, nb = below[a + 1] - below[a], below[b + 1] - below[b]
        count = na * nb
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        nb = np.repeat(nb, count)
        a, b = np.repeat(below[a], count) + k // nb, np.repeat(below[b], count) + k % nb
        return a[a <= b], b[a <= b]

    stack = [(len(levels) - 1, np.arange(len(roots) - 1), np.arange(len(roots) - 1))]
    while stack:
        level, a, b = stack.pop()
        if len(a) > STEP // FAN**2:
            parts = np.arange(STEP // FAN**2, len(a), STEP // FAN**2)
            stack += [(level, x, y) for x, y in zip(np.split(a, parts), np.split(b, parts), strict=True)][::-1]
            continue
        if out or joined:  # pairs of nodes whose members are in one component by now
            if level not in spans:
                spans[level] = np.minimum.reduceat(label, rows[level][:-1]), np.maximum.reduceat(label, rows[level][:-1])
            first, last = spans[level]
            todo = ~((first[a] == last[a]) & (first[b] == last[b]) & (first[a] == first[b]))
            a, b = a[todo], b[todo]
        if not len(a):
            continue
        if level > 1:
            a, b = children(level, a, b)
            _, low, _ = levels[level - 1]
            ok = np.bitwise_count((low[a] ^ low[b]) & masks[level - 1][a] & masks[level - 1][b]) <= radius
            stack.append((level - 1, a[ok], b[ok]))
            continue
        differ = np.bitwise_count(codes[a][:, :, None] ^ codes[b][:, None, :])
        pair, i, j = np.nonzero(differ <= radius)
        d, a, b, i, j = differ[pair, i, j], a[pair], b[pair], i, j
        x, y = leaves[a] + i, leaves[b] + j
        ok = (x < ends[a]) & (y < ends[b]) & (x < y)
        x, y, d = x[ok], y[ok], d[ok]
        ok = label[x] != label[y]
        if banned is not None and len(banned):
            key = x * n + y
            ok &= banned[np.minimum(np.searchsorted(banned, key), len(banned) - 1)] != key
        if accept:
            ok[ok] = accept(x[ok], y[ok])
        held.append((x[ok], y[ok], d[ok]))
        holds += int(ok.sum())
        if holds > STEP:
            join_held()
    if holds:
        join_held()
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _join(radius: int, free: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = block_tables(radius, free)
    for shard, place in _shards(batches):
        code = gray_code(place.view(np.uint64) ^ _SIGN)
        a, b, _ = shard_links(shard, code, radius)
        which = shard[a] >> 40
        for t in np.unique(which):
            at = which == t
            x, y = (_unpermute(code[c[at]], tables[t][0]).view(np.int64) for c in (a, b))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


def best_free(n: int, radius: int) -> int:
    """How many blocks a table's key should have for ``n`` fingerprints; any number finds all links."""
    rows, pair = 3.0, 0.015  # microseconds to deal out and sort a row, and to compare a pair
    cost = {f: comb(radius + f, f) * (rows + pair * n / 2 ** (64 * f / (radius + f)) / 2) for f in range(2, 6)}
    return min(cost, key=cost.get)


def hamming_links(fps: DataFrame, radius: int, free: int) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of ``fps`` (fp) that connect all within ``radius`` bits of each other."""
    dealt = fps.select("fp").mapInArrow(partial(_deal, radius, free), "shard long, place long")
    sorted_ = dealt.repartition("shard").sortWithinPartitions("shard", "place")
    return sorted_.mapInArrow(partial(_join, radius, free), "a long, b long").distinct()


def _similar(floor: float):
    """A pandas UDF: whether two sets of hashes have at least that Jaccard similarity."""

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both >= floor * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    return F.pandas_udf(run, "boolean")


def _described(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, th, fp, digest, f0, f1, ...): the text's hash, the fingerprint, a digest of the set of shingles and the set's ``PRINTS`` fingerprints."""
    names = ["doc_id", "th", "fp", "digest", *(f"f{s}" for s in range(PRINTS))]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = ((d, th, h, np.unique(h)) for d, th, h in ((d, th, shingle_hashes(t, size)) for d, th, t in rows_of(batches, "doc_id", "th", "text")))
        rows = ((d, th, _signed(fingerprint(h)), _digest(u), *(_signed(fingerprint(_mixed(u, s))) for s in range(PRINTS))) for d, th, h, u in hashed)
        return batched(rows, schema, 8192)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _digest(unique: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(unique.tobytes(), SEED))


def _mixed(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Hashes as of another seed (SplitMix64's last steps); seed 0 leaves them."""
    if not seed:
        return hashes
    x = hashes + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables_of(fp: pa.Array, radius: int, free: int, first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(shard, rank) of fingerprints in each table; tables are numbered from ``first``."""
    x = fp.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    for t, (order, width) in enumerate(block_tables(radius, free), first):
        rank = gray_rank(_permute(x, order))
        yield (rank >> np.uint64(64 - width)).astype(np.int64) | (t << 40), (rank ^ _SIGN).view(np.int64)


OFFERS = "shard long, place long, node long, label long"
ENDS = [f"f{s}{e}" for e in "ab" for s in range(PRINTS)]
#: What the ends of an offer are judged by beforehand: prints, and how many shingles there are, and are in another text too.
FACTS = [*(f"f{s}" for s in range(PRINTS)), "size", "shared"]


def _deal_points(radius: int, free: int, prints: list[int], whole: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """OFFERS of (node, label, f0, f1, ...) in the tables of ``prints``, where labels aren't negative; with FACTS if ``whole``."""
    count = comb(radius + free, free)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            node, label, *facts = batch.slice(at, 4096).columns
            for s in prints:
                for shard, place in _tables_of(facts[s], radius, free, s * count):
                    yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(place), node, label, *(facts if whole else [])], names=["shard", "place", "node", "label", *(FACTS if whole else [])])


def _deal_banned(radius: int, free: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """OFFERS of links (a, b, ENDS) for the one shard in which :func:`_acceptance` looks at them: label is -1 - b, and the FACTS stay empty."""
    count = comb(radius + free, free)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            a, b, *fps = batch.slice(at, 4096).columns
            a, other = a.to_numpy(), -1 - b.to_numpy()
            ends = [f.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for f in fps]
            todo = np.ones(len(a), bool)
            for s, (x, y) in enumerate(zip(fps[:PRINTS], fps[PRINTS:], strict=True)):
                here = todo & (np.bitwise_count(ends[s] ^ ends[PRINTS + s]) <= radius)
                todo &= ~here
                for (shard, place), (shard_b, _) in zip(_tables_of(x, radius, free, s * count), _tables_of(y, radius, free, s * count), strict=True):
                    at_ = here & (shard == shard_b)
                    here &= ~at_
                    if at_.any():
                        none = [pa.array(np.zeros(int(at_.sum()), np.int64))] * len(FACTS)
                        yield pa.RecordBatch.from_arrays([*(pa.array(c[at_]) for c in (shard, place, a, other)), *none], names=["shard", "place", "node", "label", *FACTS])


def may_be_similar(size_a, shared_a, size_b, shared_b, floor: float, least=np.minimum):
    """Whether sets of those sizes, of which so many elements are in another set at all, can have a Jaccard similarity of ``floor``.

    No more than the lesser number of shared elements can be in both, so what this refuses isn't similar.
    """
    most = least(shared_a, shared_b)
    return most >= floor * (size_a + size_b - most)


def _acceptance(radius: int, free: int, table: np.ndarray, prints: list[np.ndarray], size: np.ndarray, shared: np.ndarray, similarity: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether pairs of rows agree in all ``prints`` together, have shingles enough that others have too, and this ``table`` is the first that holds
    them: so each pair is looked at in one table only."""
    n, combos = radius + free, list(combinations(range(radius + free), free))
    edges = [64 * i // n for i in range(n + 1)]
    masks = [np.uint64(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i]) for i in range(n)]
    # The first table of a pair has the lowest blocks that agree, so no other block below its last one may.
    earlier = np.array([[i < c[-1] and i not in c for i in range(n)] for c in combos])

    def accept(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        apart = [f[x] ^ f[y] for f in prints]
        bits = [np.bitwise_count(d).astype(np.int64) for d in apart]
        ok = (sum(bits) <= TOGETHER) & may_be_similar(size[x], shared[x], size[y], shared[y], similarity)
        s, t = np.divmod(table[x], len(combos))
        for i, (d, b) in enumerate(zip(apart, bits, strict=True)):
            ok &= (s <= i) | (b > radius)  # an earlier print doesn't hold the pair
            here = s == i
            for k, mask in enumerate(masks):
                ok &= ~(here & earlier[t, k] & ((d & mask) == 0))
        return ok

    return accept


def _offer(radius: int, free: int, forests: int, similarity: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b: nodes) that connect what isn't banned and has different labels, in each shard of OFFERS.

    Where OFFERS come with FACTS, the links come with the labels (ra, rb) and prints of both ends, and :func:`_acceptance` holds.
    """
    for shard, place, node, label, *facts in _shards(batches):
        point = label >= 0
        links = ~point
        _, part = np.unique(shard, return_inverse=True)
        banned = None
        if links.any():
            _, number = np.unique(np.concatenate([node[point], node[links], -1 - label[links]]), return_inverse=True)
            p, m = int(point.sum()), int(links.sum())
            key = part[point] * len(number) + number[:p]
            order = np.argsort(key, kind="stable")
            ends = []
            known = np.ones(m, bool)
            for n in (number[p : p + m], number[p + m :]):
                want = part[links] * len(number) + n
                at = np.minimum(np.searchsorted(key[order], want), p - 1)
                known &= key[order][at] == want
                ends.append(order[at])
            x, y = (e[known] for e in ends)
            banned = np.unique(np.minimum(x, y) * p + np.maximum(x, y))
            shard, place, node, label, part, *facts = (c[point] for c in (shard, place, node, label, part, *facts))
        if not len(shard):
            continue
        _, group = np.unique(label, return_inverse=True)
        _, least, back = np.unique(part * len(group) + group, return_index=True, return_inverse=True)
        accept = _acceptance(radius, free, shard >> 40, [f.view(np.uint64) for f in facts[:PRINTS]], *facts[PRINTS:], similarity) if facts else None
        a, b, _ = shard_links(shard, gray_code(place.view(np.uint64) ^ _SIGN), radius, least[back], banned, node, forests, accept)
        a, b = np.where(node[a] <= node[b], a, b), np.where(node[a] <= node[b], b, a)
        names, columns = ["a", "b"], [node[a], node[b]]
        if facts:
            names, columns = [*names, "ra", "rb", *ENDS], [*columns, label[a], label[b], *(f[e] for e in (a, b) for f in facts[:PRINTS])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _offered(points: DataFrame, banned: DataFrame | None, prints: list[int], radius: int, free: int, forests: int = 1, similarity: float = 0.0) -> DataFrame:
    """Links (a, b) between ``points`` (node, label, f...) that connect all labels within ``radius`` bits in one of ``prints``.

    With ``banned`` (a, b, ENDS), without these, and as :func:`_offer` gives them where FACTS are at hand.
    """
    whole = banned is not None
    facts = FACTS if whole else FACTS[:PRINTS]
    schema = OFFERS + "".join(f", {c} long" for c in facts) * whole
    rows = points.select("node", "label", *facts).mapInArrow(partial(_deal_points, radius, free, prints, whole), schema)
    if whole:
        rows = rows.unionByName(banned.select("a", "b", *ENDS).mapInArrow(partial(_deal_banned, radius, free), schema))
    out = ", ".join(f"{c} long" for c in (["a", "b", "ra", "rb", *ENDS] if whole else ["a", "b"]))
    found = rows.repartition("shard").sortWithinPartitions("shard", "place", "node").mapInArrow(partial(_offer, radius, free, forests, similarity), out)
    return found.dropDuplicates(["a", "b"])


def _shingle_sets(nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of ``nodes`` (node, rep, rep_th): from the row of that doc_id and text's hash, or of that hash without a doc_id."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(((n, np.unique(shingle_hashes(t, size)).tobytes()) for n, t in rows_of(batches, "node", "text")), schema)

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    ends = nodes.select("node", F.col("rep").alias("doc_id"), F.col("rep_th").alias("th"))
    named = texts.join(ends, ["doc_id", "th"]).select("node", "text")
    nameless = texts.where("doc_id is null").dropDuplicates(["th"]).join(ends.where("doc_id is null").drop("doc_id"), "th").select("node", "text")
    return named.unionByName(nameless).mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def _with_shared(points: DataFrame, sets: DataFrame) -> DataFrame:
    """``points`` with ``size``, the number of their shingles, and ``shared``, of those that another of ``sets`` (node, shingles) has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, shingles in rows_of(iter([batch]), "node", "shingles"):
                each = np.frombuffer(shingles, np.int64)
                for at in range(0, len(each), 1 << 16):
                    part = each[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), node)), pa.array(part)], names=["node", "shingle"])

    holders = sets.mapInArrow(run, "node long, shingle long").groupBy("shingle").agg(F.count("*").alias("holders"), F.min("node").alias("node"))
    alone = holders.where("holders = 1").groupBy("node").agg(F.count("*").alias("alone"))
    sizes = sets.select("node", (F.length("shingles") / 8).cast("long").alias("size"))
    facts = sizes.join(alone, "node", "left").select("node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("shared"))
    return points.join(facts, "node")


def _renamed(pairs: DataFrame, root: DataFrame) -> DataFrame:
    """Pairs of labels (ra, rb) with the roots that these have got, each pair of different ones once."""
    for e in ("ra", "rb"):
        pairs = pairs.join(root.toDF(e, "root"), e, "left").withColumn(e, F.coalesce("root", e)).drop("root")
    return pairs.where("ra <> rb").distinct()


def _verified_classes(nodes: DataFrame, docs: DataFrame, size: int, radius: int, similarity: float) -> DataFrame:
    """(node, label) of each of ``nodes`` (node, rep, rep_th, f...) that links to another; label is the component.

    Each link counts only if its shingle sets have that similarity, so what a shard offers depends on what was found similar:
    links between components of verified links are offered until none is left that wasn't refused. A pair is never offered if too few
    shingles of one end are in any other text (:func:`may_be_similar`): in a dense group of texts that are alike, but not similar, it is
    their own shingles that keep them apart, so nearly all pairs that would be refused aren't offered at all.
    """
    free = best_free(nodes.count(), radius)
    waiting, labelled = None, nodes.withColumn("label", F.col("node"))
    for s in range(PRINTS):  # one after the other, as each has all the tables; what earlier prints have joined needs no further links
        found, _ = written(_offered(labelled, None, [s], radius, free), "candidates")
        waiting = found if waiting is None else waiting.unionByName(found)
        if s + 1 < PRINTS:
            joined = connected_components(waiting).toDF("node", "root")
            labelled, _ = written(nodes.join(joined, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root"), "joined")
    waiting = waiting.distinct()
    ends = waiting.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ends, _ = written(nodes.join(ends, "node"), "ends")
    sets, _ = written(_shingle_sets(ends, docs, size), "shingle-sets")
    # What has too many shingles of its own is similar to none.
    points, _ = written(_with_shared(ends, sets).where(F.col("shared") >= similarity * F.col("size")), "points")
    labels = points.select("node", F.col("node").alias("label"))
    facts = [points.select(F.col("node").alias(e), *(F.col(c).alias(f"{c}{e}") for c in FACTS)) for e in "ab"]
    together = sum(F.bit_count(F.col(f"f{s}a").bitwiseXOR(F.col(f"f{s}b"))) for s in range(PRINTS))
    may = may_be_similar(F.col("sizea"), F.col("shareda"), F.col("sizeb"), F.col("sharedb"), similarity, F.least)
    offers = waiting.join(facts[0], "a").join(facts[1], "b").where((together <= TOGETHER) & may).withColumns({"ra": F.col("a"), "rb": F.col("b")})
    refused, forests = None, 1
    while True:
        pairs = offers.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        judged, _ = written(pairs.select("a", "b", "ra", "rb", *ENDS, _similar(similarity)("x", "y").alias("similar")), "judged")
        root = connected_components(judged.where("similar").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        labels, _ = written(labels.join(root.toDF("label", "root"), "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        bad = judged.where("not similar")
        refused = bad if refused is None else refused.unionByName(bad)
        if forests == 1:  # these were a forest of all links, of which some weren't looked at: what such a link held together is looked at anew
            of = [labels.toDF(e, f"r{e}") for e in "ab"]
            apart = waiting.join(of[0], "a", "left").join(of[1], "b", "left").where("ra is null or rb is null or ra <> rb")
        else:
            apart = _renamed(bad.select("ra", "rb").distinct(), root)
        apart = apart.select(F.explode(F.array("ra", "rb")).alias("label")).where("label is not null").distinct()
        open_, _ = written(apart, "open")
        if open_.isEmpty():
            return labels
        forests *= 16
        again, _ = written(points.join(labels, "node").join(open_, "label", "left_semi"), "again")
        offers, _ = written(_offered(again, refused, list(range(PRINTS)), radius, free, forests, similarity), "offers")


def near_duplicates(docs: DataFrame, size: int = 4, radius: int = 4, similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of each row; component_id is the smallest doc_id reachable over links.

    With ``similarity``, texts link by that Jaccard similarity of their shingle sets instead; looked at are pairs of which
    one of ``PRINTS`` independent fingerprints is within ``radius`` bits and all of them together within ``TOGETHER``.
    """
    if similarity:
        return _similar_texts(docs, size, radius, similarity).drop("th")
    prints, _ = written(fingerprints(docs, size), "fingerprints")
    reps = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    links = hamming_links(reps, radius, best_free(reps.count(), radius))
    roots = connected_components(links)
    group = reps.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    group, path = written(group, "groups")
    named = group.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes, _ = written(group.join(named.hint("merge"), "root").select("fp", "component_id"), "classes")
    drop_dir(docs.sparkSession, path)
    return prints.join(classes.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def _similar_texts(docs: DataFrame, size: int, radius: int, similarity: float) -> DataFrame:
    prints, _ = written(_described(docs, size), "fingerprints")
    reps = prints.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.coalesce(F.min_by("th", "doc_id"), F.min("th")).alias("rep_th"), *(F.min(f"f{s}").alias(f"f{s}") for s in range(PRINTS)))
    nodes, _ = written(reps.withColumn("node", F.monotonically_increasing_id()), "nodes")
    labels = _verified_classes(nodes, docs, size, radius, similarity)
    group = nodes.join(labels.hint("merge"), "node", "left").select("digest", "rep", F.coalesce("label", "node").alias("label"))
    group, path = written(group, "groups")
    named = group.groupBy("label").agg(F.min("rep").alias("component_id"))
    classes, _ = written(group.join(named.hint("merge"), "label").select("digest", "component_id"), "classes")
    drop_dir(docs.sparkSession, path)
    return prints.join(classes.hint("merge"), "digest").select("doc_id", "th", "fp", "component_id")


def keep_one(docs: DataFrame, size: int = 5, radius: int = 10, similarity: float = 0.8) -> DataFrame:
    """``docs`` without those that are near-duplicates of a smaller doc_id; all columns stay.

    A row without a doc_id stays. Rows that repeat a doc_id are judged each by its own text; those of the doc_id that stays stay together.
    """
    found = _similar_texts(docs, size, radius, similarity)
    gone, _ = written(found.where("doc_id <> component_id").select("doc_id", "th").distinct(), "gone")
    # As a struct, the input's columns can't clash with those added here.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("th"))
    return rows.join(gone.hint("merge"), ["doc_id", "th"], "left_anti").select("row.*")
