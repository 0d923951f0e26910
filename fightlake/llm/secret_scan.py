"""Secret scans: fixed shapes, and a guess-cost dynamic programme over values in credential contexts.

Shapes (all code-point spans, leftmost and non-overlapping within a kind, too short matches dropped): ``assign`` is a credential word, a
separator and a value of 8 or more characters, ``access`` an access key id, ``hex`` 32 or more hex digits.

``guess`` is what the method adds: a value behind a credential word or in the user part of a URL that no shape has, and that would take
at least ``STRONG`` bits of guesses. The bits are those of the cheapest way to cut the value into

* words of a ranked list, in any case and with common substitutes of letters,
* dates, with and without separators, and years,
* repeats: a unit of up to ``UNIT`` characters, as often as it goes on,
* walks of three or more neighbouring keys, dearer with each turn,
* brute-force spans, priced by the kind of each character,

and each span costs ``SEGMENT`` bits more. So placeholders and prose stay out, and keys and good passwords don't. The list is that of a
public vocabulary file, whose ids are in order of frequency, behind a few words that are common in credentials; it is bounded by the file.

A value is looked at from left to right and left as soon as no way of cutting it can stay below the limit, so a very long one takes time
in proportion to its length at most. Documents aren't shuffled; a task holds a document at a time.

Defined cases: a null or empty text has no spans; rows that repeat a doc_id each give theirs; a null doc_id stays null; an empty table
gives an empty result; other columns are ignored by :func:`find_secrets` and kept by :func:`redact`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from math import comb, log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched, rows_of

#: Kinds in their order, and the patterns and least lengths of the shapes.
KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
MIN_ASSIGN, MIN_ACCESS = 8, 16
#: What a text must have, in lower case, for a pattern to be tried on it.
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth", "login")

_CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|bearer|auth(?:orization)?|login|(?:api|access|private|secret|auth)[_-]?key)["']?"""
    r"""(?:\x20{0,8}[:=]{1,2}>?\x20{0,8}|\x20(?:is|was)\x20)(?:(?:basic|bearer)\x20)?["'`]?([^\s"'`<>,;]+)""",
    re.A | re.I,
)
_USER_PART = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{0,19}://[^\s/:@]{1,64}:([^\s/@]+)@")
#: Values that only name where the secret is, and marks of prose at a value's end.
_REFERENCE = re.compile(r"\$|\{|%[({]|.*(?:\(|://)", re.S)
_PROSE = ".,;:!?)]}"
MIN_VALUE = 6

#: Bits of guesses from which a value counts as a secret (10 thousand million).
STRONG = log2(10**10)
SEGMENT, UNIT, LONGEST = 1.0, 16, 20
#: Words that credentials are often made of.
COMMON = """password admin welcome letmein changeme default secret login master dragon monkey qwerty test guest root user
hello love sunshine princess shadow football baseball superman batman trustno iloveyou access example sample dummy
placeholder your none null true false token value string server database""".split()
#: The rows of keys, plain and with shift.
ROWS = ["`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./"]
SHIFTED = ["~!@#$%^&*()_+", "QWERTYUIOP{}|", 'ASDFGHJKL:"', "ZXCVBNM<>?"]
_START, _STRAIGHT, _TURN = log2(sum(map(len, ROWS))), 0.5, log2(4.6)
#: Letters that other characters stand for; 1 stands for either of two.
LEET = {"0": "o", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_DAY, _MONTH, _YEAR = "(?:0[1-9]|[12][0-9]|3[01])", "(?:0[1-9]|1[0-2])", "(?:19|20)[0-9][0-9]"
_SHORT = "(?:0?[1-9]|[12][0-9]|3[01])"
_DATES = [
    (re.compile(_YEAR), log2(200)),
    *((re.compile(p), log2(365 * 200)) for p in (_YEAR + _MONTH + _DAY, _DAY + _MONTH + _YEAR, _MONTH + _DAY + _YEAR)),
    (re.compile(_DAY + _MONTH + "[0-9][0-9]"), log2(365 * 100)),
    *((re.compile(p), log2(365 * 200) + 2) for p in (rf"{_YEAR}([-/._]){_SHORT}\1{_SHORT}(?![0-9])", rf"{_SHORT}([-/._]){_SHORT}\1{_YEAR}")),
]


def _neighbours() -> dict[str, dict[str, tuple[int, int]]]:
    """For each character on the keys: the neighbouring ones with the direction of the step; each row stands half a key further right."""
    place = {c: (r, k) for rows in (ROWS, SHIFTED) for r, row in enumerate(rows) for k, c in enumerate(row, 0 if r == 0 else 1)}
    steps = {(0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)}
    return {a: {b: (rb - ra, kb - ka) for b, (rb, kb) in place.items() if (rb - ra, kb - ka) in steps} for a, (ra, ka) in place.items()}


NEIGHBOURS = _neighbours()


def char_bits(c: str) -> float:
    """Guesses for one character by its kind, in bits."""
    if "0" <= c <= "9":
        return log2(10)
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return log2(26)
    return log2(33) if c < "\x80" else log2(100)


def case_bits(word: str) -> float:
    """Ways to set capitals like those of ``word``: none, the first, the last or all are cheap."""
    upper, lower = sum("A" <= c <= "Z" for c in word), sum("a" <= c <= "z" for c in word)
    if not upper:
        return 0.0
    if not lower or upper == 1 and ("A" <= word[0] <= "Z" or "A" <= word[-1] <= "Z"):
        return 1.0
    return log2(sum(comb(upper + lower, i) for i in range(1, min(upper, lower) + 1)))


@lru_cache(maxsize=4)
def lexicon(path: str | None = None) -> dict[str, float]:
    """Bits of each known word: the logarithm of its place in the list."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    ranked = dict.fromkeys(COMMON)
    for token in sorted(vocabulary, key=vocabulary.get):
        word = token.lstrip("Ġ").lower()
        if 3 <= len(word) <= LONGEST and word.isascii() and word.isalpha():
            ranked.setdefault(word)
    return {w: log2(i + 1) for i, w in enumerate(ranked, 1)}


class Guesser:
    """Guess costs of values against one list of words."""

    def __init__(self, words: dict[str, float]):
        self.words = words
        self.unit_bits = lru_cache(maxsize=4096)(lambda unit: self.bits(unit, repeats=False))

    def jumps(self, value: str, forms: list[str], at: int, repeats: bool) -> Iterator[tuple[int, float]]:
        """(end, bits) of the words, dates and repeats that begin at ``at``."""
        words, lower = self.words, forms[0]
        for end in range(at + 3, min(at + LONGEST, len(value)) + 1):
            for form in forms:
                word = form[at:end]
                if word in words:
                    changed = len({c for c, d in zip(lower[at:end], word, strict=True) if c != d})
                    yield end, words[word] + case_bits(value[at:end]) + (1 + changed if changed else 0)
        for pattern, bits in _DATES:
            if m := pattern.match(value, at):
                yield m.end(), bits
        if repeats:
            for size in range(1, min(UNIT, (len(value) - at) // 2) + 1):
                unit = value[at : at + size]
                if not value.startswith(unit, at + size):
                    continue
                end = at + 2 * size
                while value.startswith(unit, end):
                    end += size
                times = (end - at) // size
                if times > 2 or size > 1:
                    yield end, self.unit_bits(unit) + log2(times)

    def bits(self, value: str, stop: float = float("inf"), repeats: bool = True) -> float:
        """Bits of guesses of the cheapest way to cut ``value``; from ``stop`` on, only some number that isn't below it."""
        lower = "".join(c.lower() if c < "\x80" else c for c in value)
        forms = list(dict.fromkeys(lower.translate(str.maketrans(t)) for t in ({}, LEET | {"1": "i"}, LEET | {"1": "l"})))
        n, never = len(value), float("inf")
        ahead = {0: 0.0}  # the least cost of what ends there
        brute = start = two = walk = never  # of what ends here and can go on: a brute-force span, a walk of one key, of two, and of more
        turn = None
        for at in range(n):
            best = ahead.pop(at, never)
            best = min(best, brute, walk)
            most = min(ahead.get(n, never), stop)
            if best < most:
                for end, bits in self.jumps(value, forms, at, repeats):
                    ahead[end] = min(ahead.get(end, never), best + bits + SEGMENT)
            brute = min(brute, best + SEGMENT) + char_bits(value[at])
            step = NEIGHBOURS.get(value[at - 1], {}).get(value[at]) if at else None
            if step is None:
                two = walk = never
            else:
                price = _STRAIGHT if step == turn else _TURN
                walk, two = min(walk, two) + price, (start + _TURN if start < never else never)
            start = best + SEGMENT + _START if value[at] in NEIGHBOURS else never
            turn = step
            if min(brute, two, walk, start, *ahead.values()) >= stop:
                return stop
        return min(ahead.get(n, never), brute, walk) if n else 0.0


def values_in_context(text: str, lower: str) -> list[tuple[int, int]]:
    """Spans of values behind credential words and in the user part of URLs, in order, none over another."""
    found = []
    if any(w in lower for w in _CONTEXT_WORDS):
        found += [m.span(1) for m in _CONTEXT.finditer(text)]
    if "://" in text:
        found += [m.span(1) for m in _USER_PART.finditer(text)]
    out: list[tuple[int, int]] = []
    for start, end in sorted(found):
        while end > start and text[end - 1] in _PROSE:
            end -= 1
        if end - start >= MIN_VALUE and (not out or start >= out[-1][1]) and not _REFERENCE.match(text, start, end):
            out.append((start, end))
    return out


def spans_of(text: str | None, guesser: Guesser, strong: float = STRONG) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind in the order of ``KINDS``."""
    if not text:
        return []
    lower = text.lower()  # to look for words only; its places aren't used
    out: list[tuple[str, int, int]] = []
    if any(w in lower for w in _ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    covered = sorted((a, b) for _, a, b in out)
    i, reach = 0, 0
    for start, end in values_in_context(text, lower):
        while i < len(covered) and covered[i][0] < end:
            reach = max(reach, covered[i][1])
            i += 1
        if reach <= start and guesser.bits(text[start:end], strong) >= strong:
            out.append(("guess", start, end))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = "doc_id long, spans array<struct<kind: string, start: long, end: long>>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])


def find_secrets(docs: DataFrame, vocabulary: str | None = None, strong: float = STRONG) -> DataFrame:
    """(doc_id, spans) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesser = Guesser(lexicon(vocabulary))
        rows = ((d, [{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t, guesser, strong)]) for d, t in rows_of(batches, "doc_id", "text"))
        return batched(rows, _ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, SPANS)


def redact(docs: DataFrame, vocabulary: str | None = None, strong: float = STRONG) -> DataFrame:
    """``docs`` with each span (spans that overlap as one) as ``[kind]`` of its first; all columns stay."""

    def masked(text: str | None, guesser: Guesser) -> str | None:
        parts, reach = [], 0
        for kind, start, end in spans_of(text, guesser, strong):
            if start >= reach:
                parts += [text[reach:start], f"[{kind}]"]
            reach = max(reach, end)
        return "".join([*parts, text[reach:]]) if parts else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesser = Guesser(lexicon(vocabulary))
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = pa.array([masked(t, guesser) for (t,) in rows_of(iter([batch]), "text")], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    return docs.mapInArrow(run, docs.schema)


def of_kinds(spans: str, *kinds: str) -> Column:
    """The spans of some kinds."""
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def joined(spans: str, *kinds: str) -> Column:
    """kind:start:end of the spans of some kinds, comma-joined."""
    return F.array_join(F.transform(of_kinds(spans, *kinds), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
