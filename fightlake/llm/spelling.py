"""Spelling variant grouping with Bloom-guided neighbourhoods.

Words are maximal runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z in lower case; those of ``MIN_CHARS`` or more code points that occur
``MIN_COUNT`` times or more in all documents are the vocabulary. Two words are near if one inserted, deleted or replaced code point makes one
of the other. A word's form is its near word of largest count, if that is ``FACTOR`` times its own or more.

* Words are counted in tasks first, documents at a time, and then by a map-side combined sum.
* For each word length there is a blocked Bloom filter (a word's bits lie in one block of 64), built by Spark: an OR of the words' masks by
  block. A filter of more than ``SHARD_BYTES`` is cut into shards by hash. Shards are sent to the tasks in rounds of at most ``ROUND_BYTES``
  each, which is all that is ever in the driver or broadcast.
* Every task makes the edits of its words as hashes only: a word's hash is a sum over its letters by place, so that of each word with a letter
  left out or replaced follows from partial sums, for all words of a length at once. Letters inserted are the other side of letters left out, and
  a letter is replaced by greater ones only, so each pair is looked for once. Edits that a filter has become strings.
* Only these shuffle, to an exact join with the vocabulary, which takes away what the filters had by chance (under one in a hundred probes).
* Roots follow forms to the last by doubling steps; counts rise fivefold with each step, so there are no circles and few rounds.

Defined cases: a null or empty text has no words; a null doc_id takes part, with no letter left out; rows that repeat a doc_id each count;
ties between near words go to the smaller in code-point order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, written
from .decontam import _Shared

MIN_CHARS, MIN_COUNT, FACTOR = 6, 5, 5
#: A run that this number divides the hash of loses a code point.
LOSES = 199
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: All letters that words can have after A-Z are in lower case.
LETTERS = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)], np.uint8)
#: Distinct words that a task holds before it sends counts on.
HELD = 1 << 17
#: Bits for each word, bits set for each, bytes of a shard and of the shards of a round, and edits that are hashed at once.
BITS, SET, SHARD_BYTES, ROUND_BYTES, EDITS = 20, 5, 4 << 20, 16 << 20, 1 << 20

_ONE = np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well spread bits of sums (a finaliser of shifts and multiplications)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_LETTER = _mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _powers(length: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[_ONE], np.full(length, _BASE)]), dtype=np.uint64)


def letters_of(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of their code points, all of which are below 256."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def word_hashes(letters: np.ndarray) -> np.ndarray:
    return (_LETTER[letters] * _powers(letters.shape[1])[:-1]).sum(1, dtype=np.uint64)


def lower(text: str) -> str:
    """Only A-Z become lower case."""
    return text.encode().lower().decode()


def altered(doc_id: int | None, run: str) -> str:
    """A lower-cased run, without one code point if its hash with the document says so."""
    if doc_id is None:
        return run
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    return run if h % LOSES else run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(word, n) of all words, however often they occur."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=schema)
            held.clear()
            return batch

        for doc_id, text in rows_of(batches, "doc_id", "text"):
            for found, n in Counter(_RUN.findall(lower(text or ""))).items():
                if len(found) >= min_chars:
                    word = altered(doc_id, found)
                    if len(word) >= min_chars:
                        held[word] += n
            if len(held) >= HELD:
                yield sent()
        if held:
            yield sent()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Filters:
    """Where the words of each length are in blocked Bloom filters: shards by hash, blocks of 64 bits, and bits."""

    def __init__(self, counts: dict[int, int], shard_bytes: int = SHARD_BYTES):
        self.first: dict[int, int] = {}  # a length's first shard
        self.parts: dict[int, int] = {}
        self.blocks: dict[int, int] = {}  # in each shard of a length
        at = 0
        for length, n in sorted(counts.items()):
            self.first[length], self.parts[length] = at, -(-n * BITS // (8 * shard_bytes)) or 1
            self.blocks[length] = -(-n * BITS // (64 * self.parts[length])) or 1
            at += self.parts[length]
        self.shards = [(length, p) for length in sorted(counts) for p in range(self.parts[length])]

    def places(self, length: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shard, block, mask) of words of a length."""
        h = _mixed(hashes)
        shard = self.first[length] + (h % np.uint64(self.parts[length])).astype(np.int64)
        h = _mixed(h + _BASE)
        block = ((h >> np.uint64(32)) * np.uint64(self.blocks[length]) >> np.uint64(32)).astype(np.int64)
        mask = np.zeros_like(h)
        h = _mixed(h + _BASE)
        for k in range(SET):
            mask |= _ONE << ((h >> np.uint64(6 * k)) & np.uint64(63))
        return shard, block, mask

    def rounds(self, round_bytes: int = ROUND_BYTES) -> Iterator[list[int]]:
        """Shards that are sent together."""
        held, size = [], 0
        for s, (length, _) in enumerate(self.shards):
            if held and size + 8 * self.blocks[length] > round_bytes:
                yield held
                held, size = [], 0
            held.append(s)
            size += 8 * self.blocks[length]
        if held:
            yield held


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str]]]:
    for batch in batches:
        groups: dict[int, list[str]] = {}
        for (word,) in rows_of(iter([batch]), "word"):
            groups.setdefault(len(word), []).append(word)
        yield from groups.items()


def filter_blocks(words: DataFrame, filters: Filters) -> DataFrame:
    """(shard, block, mask) of the filters' blocks that have any bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for length, group in _by_length(batches):
            shard, block, mask = filters.places(length, word_hashes(letters_of(group)))
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(block), pa.array(mask.view(np.int64))], names=["shard", "block", "mask"])

    return words.select("word").mapInArrow(run, "shard long, block long, mask long").groupBy("shard", "block").agg(F.bit_or("mask").alias("mask"))


def edits(letters: np.ndarray) -> Iterator[tuple[int, np.ndarray | None, np.ndarray, np.ndarray]]:
    """(place, new letters or None if it is left out, rows of the words, hashes of these words as edited), each edited word once.

    Of equal letters side by side, only the first is left out; letters are replaced by greater ones.
    """
    m, length = letters.shape
    power = _powers(length)
    terms = _LETTER[letters] * power[:-1]
    before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
    whole = terms.sum(1, dtype=np.uint64)
    moved = np.zeros((m, length), np.uint64)
    moved[:, 1:] = _LETTER[letters[:, 1:]] * power[: length - 1]
    after = moved.sum(1, dtype=np.uint64)[:, None] - np.cumsum(moved, axis=1, dtype=np.uint64)
    rows = np.arange(m)
    for i in range(length):
        some = rows if i == 0 else rows[letters[:, i] != letters[:, i - 1]]
        if length > 1 and len(some):
            yield i, None, some, (before[:, i] + after[:, i])[some]
        some, c = np.nonzero(letters[:, i, None] < LETTERS)
        if len(some):
            yield i, LETTERS[c], some, (whole - terms[:, i])[some] + _LETTER[LETTERS[c]] * power[i : i + 1]


def _probe(words: DataFrame, filters: Filters, blocks: DataFrame, shards: list[int]) -> DataFrame:
    """(word, edit): edits that one of ``shards`` has."""
    spark = words.sparkSession
    wanted = sorted({filters.shards[s][0] for s in shards})
    found = blocks.where(F.col("shard").between(shards[0], shards[-1])).toArrow()  # of at most ROUND_BYTES of masks
    start = np.cumsum([0, *(filters.blocks[filters.shards[s][0]] for s in shards)])
    masks = np.zeros(int(start[-1]), np.uint64)
    shard, block, mask = (found.column(c).to_numpy() for c in ("shard", "block", "mask"))
    masks[start[shard - shards[0]] + block] = mask.view(np.uint64)
    shared = _Shared(spark, masks)
    schema = pa.schema([("word", pa.string()), ("edit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = shared.value

        def known(length: int, hashes: np.ndarray) -> np.ndarray:
            shard, block, mask = filters.places(length, hashes)
            ok = (shard >= shards[0]) & (shard <= shards[-1])
            at = np.where(ok, start[np.where(ok, shard - shards[0], 0)] + block, 0)
            return ok & (masks[at] & mask == mask)

        for length, group in _by_length(batches):
            step = max(1, EDITS // (length + len(LETTERS)))
            for low in range(0, len(group), step):
                part = group[low : low + step]
                out: tuple[list[str], list[str]] = [], []
                for i, new, rows, hashes in edits(letters_of(part)):
                    size = length - (new is None)
                    if size in wanted:
                        for k in np.flatnonzero(known(size, hashes)):
                            word = part[rows[k]]
                            out[0].append(word)
                            out[1].append(word[:i] + ("" if new is None else chr(new[k])) + word[i + 1 :])
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], schema=schema)

    lengths = F.length("word")
    return words.where(lengths.isin(wanted) | (lengths - 1).isin(wanted)).select("word").mapInArrow(run, "word string, edit string")


def near_pairs(vocabulary: DataFrame, shard_bytes: int = SHARD_BYTES, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(word, near, near_n) for each two near words of ``vocabulary`` (word, n; each word once), both ways."""
    spark = vocabulary.sparkSession
    counts = {r["length"]: r["count"] for r in vocabulary.groupBy(F.length("word").alias("length")).count().collect()}  # a row a length
    if not counts:
        return spark.createDataFrame([], "word string, near string, near_n long")
    filters = Filters(counts, shard_bytes)
    # Dealt out anew, as the words of one task make very many edits.
    tasks = max(2 * spark.sparkContext.defaultParallelism, sum(counts.values()) // 20_000)
    dealt, _ = written(vocabulary.repartition(tasks, "word"), "vocabulary-dealt")
    blocks, _ = written(filter_blocks(dealt, filters), "bloom-blocks")
    edits_, positives = None, []
    for shards in filters.rounds(round_bytes):
        found, _ = written(_probe(dealt, filters, blocks, shards), "positives")
        positives.append(found)
    for found in positives:
        edits_ = found if edits_ is None else edits_.unionByName(found)
    pairs = edits_.join(vocabulary.toDF("edit", "edit_n"), "edit").join(vocabulary.toDF("word", "n"), "word")
    pairs, _ = written(pairs.select("word", "n", "edit", "edit_n"), "near-pairs")
    return pairs.select("word", F.col("edit").alias("near"), F.col("edit_n").alias("near_n")).unionByName(pairs.select(F.col("edit").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form) followed to the last, twice as far in each round."""
    links, _ = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = links.toDF("root", "next")
        stepped, _ = written(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        if stepped.where("moved").isEmpty():
            return links
        links = stepped.drop("moved")


def group_variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of the vocabulary."""
    vocabulary, _ = written(word_counts(docs, min_chars).where(F.col("n") >= min_count), "vocabulary")
    near = near_pairs(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    has_form = -F.col("best.less") >= factor * F.col("n")
    judged = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has_form, F.col("best.near")).alias("form"), F.when(has_form, -F.col("best.less")).alias("form_n")
    )
    judged, _ = written(judged, "judged-words")
    roots = roots_of(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
