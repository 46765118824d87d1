"""A word-end BPE vocabulary read from a tokenizers file, and a short way to its ids.

Most pre-tokens of a text are one token of the vocabulary. ``prove`` finds out ahead of
any text, on the driver, which vocabulary strings encode alone as exactly one token; the
executors look those up and send only the other pre-tokens through the merges (each once
for a run of texts, whatever stands beside it, as results are kept in a bounded table).

The short way holds only where this module splits texts as the library does. It is
used for stretches whose characters are all in ``_KNOWN``, whose case, normal form and class
are the same in every Unicode version. Any other stretch between white space goes to the
library as it is, and so do stretches with a special token's string.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import unicodedata
from functools import lru_cache

#: Bytes of stretches, about, whose results are kept; longer stretches than _LONGEST are never kept.
_MOST_KEPT = 48_000_000
_LONGEST = 1_000

_SPACES = " \t\n\x0b\x0c\r"
#: Letters of Latin scripts that have one-character lower forms, ASCII, and marks of common typography.
_LATIN = [c for c in map(chr, range(0xA1, 0x250)) if unicodedata.normalize("NFC", c) == c and len(c.lower()) == 1 and not unicodedata.category(c).startswith("C")]
_TYPE = list("–—‘’“”•…€")
_ASCII = [chr(c) for c in range(0x21, 0x7F)]
_LETTERS = [c for c in _ASCII + _LATIN if unicodedata.category(c).startswith("L")]
_NUMBERS = [c for c in _ASCII + _LATIN if unicodedata.category(c).startswith("N")]
_KNOWN = _ASCII + _LATIN + _TYPE


def _set(chars) -> str:
    """A regular expression's class of these characters, by runs."""
    points, runs = sorted(map(ord, chars)), []
    for p in points:
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)


_UNKNOWN = re.compile(f"[^{_set(_KNOWN + list(_SPACES))}]")
_SPACE_RUN = re.compile(f"[{_set(_SPACES)}]+")
#: Within known characters, what the file's own pattern matches.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_set(_LETTERS)}]+|[{_set(_NUMBERS)}]|[^{_set(_LETTERS + _NUMBERS + list(_SPACES))}]+")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def prove(source: str, suffix: str = "</w>") -> dict[str, int]:
    """The strings that the vocabulary in this JSON source encodes as one token each."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(source)
    letters = {c: b for b, c in byte_letters().items()}
    words: list[str] = []
    for entry in library.get_vocab(with_added_tokens=False):
        stem = entry.removesuffix(suffix)
        if stem != entry and all(c in letters for c in stem):
            word = bytes(letters[c] for c in stem).decode(errors="replace")
            if word and not _UNKNOWN.search(word) and word == word.lower() and _PIECES.findall(word) == [word]:
                words.append(word)
    found = library.encode_batch(words, add_special_tokens=False)
    return {w: e.ids[0] for w, e in zip(words, found, strict=True) if len(e.ids) == 1}


class _Table(dict):
    """Results by stretch of text, made where missing; the proved strings are there from the start."""

    def __init__(self, proved: dict, make):
        super().__init__(proved)
        self.proved, self.make, self.kept = proved, make, 0

    def __missing__(self, stretch: str):
        found = self.make(stretch)
        if len(stretch) <= _LONGEST:
            self.kept += 100 + 3 * len(stretch)
            if self.kept > _MOST_KEPT:
                self.clear()
                self.update(self.proved)
                self.kept = 0
            self[stretch] = found
        return found


class Encoder:
    """Ids and counts of whole texts, as the library gives them."""

    def __init__(self, source: str, whole: dict[str, int]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.whole, self.letters = whole, byte_letters()
        self.counts = _Table(dict.fromkeys(whole, 1), self._count)
        self.ids = _Table({w: _packed([i]) for w, i in whole.items()}, self._ids)

    def _count(self, stretch: str) -> int:
        pieces = _PIECES.findall(stretch)
        return len(self._merged(stretch)) if len(pieces) == 1 else sum(map(self.counts.__getitem__, pieces))

    def _ids(self, stretch: str) -> bytes:
        pieces = _PIECES.findall(stretch)
        return _packed([t.id for t in self._merged(stretch)]) if len(pieces) == 1 else b"".join(map(self.ids.__getitem__, pieces))

    def _merged(self, piece: str) -> list:
        """The tokens of one pre-token by the model's merges; in ASCII each byte's letter is the character itself."""
        return self.library.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters))

    def _hard(self, text: str) -> bool:
        return bool(_UNKNOWN.search(text)) or any(s in text for s in self.special)

    def _library(self, stretch: str) -> list[int]:
        return self.library.encode(stretch, add_special_tokens=False).ids

    def count(self, text: str) -> int:
        counts = self.counts
        if not self._hard(text):
            return sum(map(counts.__getitem__, text.lower().split()))
        return sum(len(self._library(p)) if self._hard(p) else counts[p.lower()] for p in _SPACE_RUN.split(text))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        ids = self.ids
        if not self._hard(text):
            return b"".join(map(ids.__getitem__, text.lower().split()))
        return b"".join(_packed(self._library(p)) if self._hard(p) else ids[p.lower()] for p in _SPACE_RUN.split(text))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def read(path: str) -> tuple[str, dict[str, int]]:
    """On the driver: the file's content and its proved one-token strings."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    return source, prove(source)


_encoders: dict[str, Encoder] = {}


class SharedEncoder:
    """A vocabulary broadcast once; ``get`` gives the one encoder of an executor's process."""

    def __init__(self, spark, path: str):
        content = read(path)
        self.name = hashlib.sha256(content[0].encode()).hexdigest()
        self.content = spark.sparkContext.broadcast(content)

    def get(self) -> Encoder:
        if self.name not in _encoders:
            _encoders.clear()
            _encoders[self.name] = Encoder(*self.content.value)
        return _encoders[self.name]
