"""Exact token ids and counts through bounded worker caches of whitespace-delimited units.

A text is cut only where the tokenizer's own pre-tokenizer cuts too, so each unit's ids don't depend on its neighbours. Units that a worker hasn't
seen are encoded by the library itself, many in a call; the rest are looked up.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterable

#: Units that a worker keeps; beyond that its cache starts anew. Units of more than KEPT characters (text without white space: some scripts, encoded data) are
#: encoded each time and kept nowhere, so a cache has some 200 bytes a unit, 100 MB in all, whatever the texts are.
CACHE_UNITS, KEPT = 500_000, 64

_TWO_SPACES = re.compile(r"\s\s")
_SAFE_CUT = re.compile(r"(?<!\s)(?=[ \n]\S)")
_tokenizers: dict[str, object] = {}
_caches: dict[tuple, dict] = {}


def tokenizer(file: str):
    """file: a name in the installed public vocabulary folder, or a path."""
    if file not in _tokenizers:
        import os

        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        t = Tokenizer.from_file(file if os.path.sep in file else public_tokenizers.path(file))
        t.no_padding()
        t.no_truncation()
        _tokenizers[file] = t
    return _tokenizers[file]


def space_units(text: str) -> list[str]:
    """For tokenizers that compose (NFC), lower-case and drop white space: what stands between spaces and line ends.

    In usual texts the units are lowered, so that a cache has fewer of them. Usual: composed already, without special strings or letters whose lower case
    depends on the context.
    """
    if "<|" in text or "Σ" in text or "İ" in text or not unicodedata.is_normalized("NFC", text):
        return text.replace("\n", " ").split(" ")
    return text.lower().replace("\n", " ").split(" ")


def leading_units(text: str) -> list[str]:
    """For byte-level tokenizers, which keep a single space or line end with what follows it: units that begin with it.

    A cut stands before one space or line end between two characters that aren't white space. No pre-token spans such a place: only white-space
    runs look ahead, and every other pre-token ends in a character that isn't white space.
    """
    if "\0" in text or _TWO_SPACES.search(text):
        return [u for u in _SAFE_CUT.split(text) if u]
    units = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
    return units if units[0] else units[1:]


class _Known(dict):
    """Unit to packed ids; a unit that it lacks is encoded and kept.

    A sign after a word of letters is a pre-token of its own. Lower-case words of Latin letters are one pre-token each, so the library's model takes their
    bytes (as the characters that stand for them) directly; all other units go through the whole tokenizer.
    """

    def __init__(self, tok, code: str):
        super().__init__({"": b""})
        self.encode, self.merge, self.code = tok.encode, tok.model.tokenize, code
        letters = [c for c in map(chr, range(0xC0, 0x250)) if c.isalpha() and c.islower()]
        self.stands_for = str.maketrans({c: tok.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters})

    def __missing__(self, unit: str) -> bytes:
        if unit[-1] in ".,;:!?" and unit[:-1].isalpha():
            packed = self[unit[:-1]] + self[unit[-1]]
            if len(unit) <= KEPT:
                self[unit] = packed
            return packed
        if unit.isalpha() and unit.islower() and max(unit) < "\u0250" and not ("\x80" < max(unit) < "\xc0" or "\xaa" in unit or "\xb5" in unit or "\xba" in unit) and unicodedata.is_normalized("NFC", unit):
            ids = [t.id for t in self.merge(unit if unit.isascii() else unit.translate(self.stands_for))]
        else:
            ids = self.encode(unit, add_special_tokens=False).ids
        packed = array(self.code, ids).tobytes()
        if len(unit) <= KEPT:
            self[unit] = packed
        return packed


class IdCache:
    """Unit to packed little-endian ids. One for each worker process and vocabulary."""

    def __init__(self, file: str, limit: int = CACHE_UNITS):
        self.tok, self.limit = tokenizer(file), limit
        self.kind, self.code = ("<u2", "H") if self.tok.get_vocab_size() <= 1 << 16 else ("<u4", "I")
        if (file, "ids") not in _caches:
            _caches[file, "ids"] = _Known(self.tok, self.code)
        self.known = _caches[file, "ids"]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        out = []
        for t in texts:
            out.append(b"".join(map(self.known.__getitem__, space_units(t))))
            if len(self.known) > self.limit:
                self.known.clear()
                self.known[""] = b""
        return out


class LengthCache:
    """Two tiers of unit to token count: a table that all workers get, and what this worker has met itself."""

    def __init__(self, file: str, frequent: dict[str, int], limit: int = CACHE_UNITS):
        self.tok, self.limit, self.frequent = tokenizer(file), limit, frequent
        self.own = _caches.setdefault((file, "lengths"), {})

    def counts(self, texts: list[str]) -> list[int]:
        units = [leading_units(t) for t in texts]
        new = list(set().union(*units) - self.frequent.keys() - self.own.keys())
        if len(self.own) + len(new) > self.limit:
            self.own.clear()
            new = list(set().union(*units) - self.frequent.keys())
        lengths = dict(zip(new, (len(e.ids) for e in self.tok.encode_batch(new, add_special_tokens=False)), strict=True))
        both = _Tiers(self.frequent)
        both.own, both.once = self.own, {u: lengths.pop(u) for u in new if len(u) > KEPT}
        self.own.update(lengths)
        return [sum(map(both.__getitem__, u)) for u in units]


class _Tiers(dict):
    """The frequent table, which asks the worker's own cache for what it lacks, and what isn't kept last."""

    own: dict[str, int]
    once: dict[str, int]

    def __missing__(self, unit: str) -> int:
        return self.own[unit] if len(unit) <= KEPT else self.once[unit]


def small_batches(values: list, size: int, weight=len) -> Iterable[tuple[int, int]]:
    """Index ranges over values of about `size` weight each."""
    start = total = 0
    for i, v in enumerate(values):
        total += weight(v)
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(values):
        yield start, len(values)
