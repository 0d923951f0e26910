"""Token ids of whole texts with a byte-level BPE vocabulary file, exactly and with little repeated work.

A text of ASCII, Latin letters and common marks is cut into the pre-tokeniser's own pieces by its pattern, written with
plain ranges. Each piece is encoded once by the tokenizers library's model, and later ones come from a bounded
memory. Texts with other characters, or with a special token's string, are encoded in one go.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: Pieces kept in each of two generations of memory, and the longest that is kept.
PIECES, LONGEST = 1 << 18, 48
END_ID = 0
#: All letters and numbers below U+0250, and marks beyond (dashes, quotes, signs of money and trade).
_LETTER, _NUMBER, _MARK = "a-zA-ZªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "‐-‧‰-⁞€™"
#: Fixed value: the byte-level pre-tokeniser's pattern, for texts that :data:`_ODD` isn't found in.
_PIECE = re.compile(rf" ?[{_LETTER}]++|'(?:[stmd]|re|ve|ll)| ?[{_NUMBER}]++| ?[^\s{_LETTER}{_NUMBER}]++|\s+(?!\S)|\s++")
#: What isn't ASCII, Latin or a known mark, and what only some definitions count as white space.
_ODD = re.compile(f"[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-ɏ{_MARK}]")
#: Fixed value: what it finds among the first 256 characters.
_ODD_LATIN = "\x1c\x1d\x1e\x1f\x85\xa0"


def _odd(text: str) -> bool:
    """Whether :data:`_ODD` is found in ``text``; texts of the first 256 characters aren't searched by it, as most are such."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return bool(_ODD.search(text))
    return any(c in text for c in _ODD_LATIN)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where printable, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


class _Memory(dict):
    """Ids of pieces as bytes; what is asked for again outlives the clearing of older pieces."""

    def __init__(self, make, most: int = PIECES):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(piece) <= LONGEST:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class TextEncoder:
    """Encodes texts with the tokenizers library, without special tokens."""

    def __init__(self, path: str, pieces: int = PIECES):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self._plain = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self._special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self._tokenize, self._letters = tokenizer.model.tokenize, _byte_letters()
        self._spelt = {n: n.to_bytes(4, "little") for n in range(tokenizer.get_vocab_size())}.__getitem__
        tokenizer.model._resize_cache(0)  # pieces are remembered here
        self._memory = _Memory(self._piece, pieces)

    def _piece(self, piece: str) -> bytes:
        plain = piece.isascii() and piece.isprintable()  # then all but the space is written as itself
        spelt = piece.replace(" ", self._letters[0x20]) if plain else piece.encode().decode("latin-1").translate(self._letters)
        return b"".join([self._spelt(t.id) for t in self._tokenize(spelt)])

    def encode(self, text: str | None) -> np.ndarray:
        """The ids as unsigned 32-bit integers (a null text is empty)."""
        return np.frombuffer(self._encoded(text), "<u4")

    def _encoded(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _odd(text) or any(s in text for s in self._special):
            return self._plain(text)
        return b"".join(map(self._memory.__getitem__, _PIECE.findall(text)))

    def rest(self) -> None:
        """Forget the older pieces, at a task's end: a worker that goes on to other work holds half as much."""
        self._memory.old.clear()

    def document(self, text: str | None) -> np.ndarray:
        """The ids with the end id."""
        return np.frombuffer(self._encoded(text) + END_ID.to_bytes(4, "little"), "<u4")


@lru_cache(maxsize=2)
def text_encoder(path: str, pieces: int = PIECES) -> TextEncoder:
    """One encoder a worker, vocabulary and size of memory."""
    return TextEncoder(path, pieces)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
