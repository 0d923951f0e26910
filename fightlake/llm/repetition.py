"""Quality rules by repetition coverage: characters inside duplicated n-grams and lines.

Words are maximal runs of anything but space and U+0009..U+000D. Each word gets a number within its
text; rolling hashes over those numbers find windows that occur again, and equal hashes are held
against the numbers themselves, so a hash collision cannot change a result. A window's later
occurrences count, not its first; overlapping windows count each character once.

Defined cases: a null or empty text has no words (all measures 0, base_failed true, kept false);
texts with fewer words than a window have no such window; repeated rows give repeated results; extra
columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batched, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
#: Percent of a text's word characters that duplicated n-grams of n words may hold.
NGRAM_PERCENT = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Fixed value: percent of line characters that may lie in lines equal to an earlier one.
LINE_CHARS_PERCENT = 20
#: Fewest words; window and percent of the base rule.
MIN_WORDS, BASE_WINDOW, BASE_PERCENT = 20, 8, 30

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_chars long, "
    "dup_line_chars long, dup5_chars long, dup6_chars long, dup7_chars long, dup8_chars long, dup9_chars long, dup10_chars long, "
    "base_failed boolean, kept boolean"
)
_ARROW = pa.schema([(c.split()[0], pa.bool_() if c.endswith("boolean") else pa.int64()) for c in SCHEMA.split(", ")])


def _windows(codes: np.ndarray, n: int, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts in ``at`` (ascending) whose n-word window occurs twice or more in it: all, and all but the first of each."""
    h = hashes[at]
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return at[:0], at[:0]
    left, right = at[order[:-1][same]], at[order[1:][same]]
    span = np.arange(n)
    if not (codes[left[:, None] + span] == codes[right[:, None] + span]).all():
        _, inverse, counts = np.unique(codes[at[:, None] + span], axis=0, return_inverse=True, return_counts=True)
        inverse = inverse.ravel()
        first = np.zeros(len(at), bool)
        first[np.unique(inverse, return_index=True)[1]] = True
        many = counts[inverse] > 1
        return at[many], at[many & ~first]
    later = np.zeros(len(at), bool)
    later[order[1:][same]] = True
    many = later.copy()
    many[order[:-1][same]] = True
    return at[many], at[later]


def _covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    edge = np.zeros(words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None, ngrams: tuple[int, ...] = tuple(NGRAM_PERCENT)) -> dict[str, int]:
    """The counts of one text. ``ngrams`` is ascending; the base rule's window must be in it."""
    text = text or ""
    words = WORD.findall(text)
    n_words = len(words)
    out = {"n_words": n_words, "word_chars": sum(map(len, words)), "n_symbols": sum(map(text.count, SYMBOLS)), "n_repeat_words": 0}
    seen: set[str] = set()
    dup_lines = line_chars = dup_chars = 0
    for line in text.split("\n"):
        if WORD.search(line):
            line_chars += len(line)
            if line in seen:
                dup_lines += 1
                dup_chars += len(line)
            seen.add(line)
    out |= {"line_chars": line_chars, "n_dup_lines": dup_lines, "dup_line_chars": dup_chars}
    out |= {f"dup{n}_chars": 0 for n in ngrams}
    number: dict[str, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n_words)
    if len(number) == n_words:
        return out
    sizes = np.fromiter(map(len, words), np.int64, n_words)
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * _FACTOR
    mixed ^= mixed >> np.uint64(29)
    hashes, at = mixed, np.arange(n_words)
    for n in range(2, max(ngrams) + 1):
        if n > n_words:
            break
        hashes = hashes[:-1] * _ODD + mixed[n - 1 :]  # the window's hash from that of one word less
        if n not in ngrams:
            continue
        # A window that recurs has a shorter one at its start that recurs, so only those are looked at.
        many, later = _windows(codes, n, hashes, at[at <= n_words - n])
        if n == BASE_WINDOW:
            out["n_repeat_words"] = int(_covered(many, n, n_words).sum())
        out[f"dup{n}_chars"] = int(sizes[_covered(later, n, n_words)].sum())
        at = many
        if not len(at):
            break
    return out


def verdict(m: dict[str, int]) -> tuple[bool, bool]:
    """(base_failed, kept)."""
    base = m["n_words"] < MIN_WORDS or 100 * m["n_repeat_words"] > BASE_PERCENT * m["n_words"]
    bad = 100 * m["dup_line_chars"] > LINE_CHARS_PERCENT * m["line_chars"] or any(100 * m[f"dup{n}_chars"] > p * m["word_chars"] for n, p in NGRAM_PERCENT.items())
    return base, not base and not bad


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            m = measure(text)
            yield (doc_id, *(m[f] for f in _ARROW.names[1:-2]), *verdict(m))

    return batched(rows(), _ARROW, 8192)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Measures and verdict for each row of ``docs`` (doc_id, text); no shuffle."""
    return docs.select("doc_id", "text").mapInArrow(_map, SCHEMA)


def _filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [verdict(measure(t))[1] for (t,) in rows_of(iter([batch]), "text")]
        yield batch.filter(pa.array(keep, pa.bool_()))


def keep_good(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose text the rules keep."""
    return docs.mapInArrow(_filter, docs.schema)
