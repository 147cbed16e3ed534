"""Encoding inside tasks with a public tokenizer file, remembering pieces that were seen before.

A byte-level tokenizer cuts a text into pieces and merges inside each piece only. ``units`` cuts at places
where pieces always end, so a unit's ids depend on nothing around it and are encoded by the library once.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

#: Units that one Python worker remembers; beyond it the memory is emptied and filled anew.
REMEMBERED = 500_000
#: Unicode white space, as the pieces' pattern understands it.
WHITE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Letters whose run ends a piece when an ASCII character that is no letter follows.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿĀ-ſ"
_UNIT = re.compile(rf"[{WHITE}]*+[{LETTERS}]++(?![^\x00-\x7f])|[{WHITE}]*+[^{WHITE}]++|[{WHITE}]++")
units = _UNIT.findall
one_piece = re.compile(rf" ?[{LETTERS}]+").fullmatch
#: Characters whose units are held at a time, and where a long text may be cut: a unit ends there.
PART = 1 << 18
_END = re.compile(rf"[^{WHITE}](?=[{WHITE}])")


def parts(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > PART and (end := _END.search(text, start + PART)):
        yield text[start : end.end()]
        start = end.end()
    yield text[start:]


@lru_cache(maxsize=4)
def load(name: str) -> Tokenizer:
    """A tokenizer by the name of its public file."""
    return Tokenizer.from_file(public_tokenizers.path(name))


class Remembered:
    """Results by unit; ``compute`` gives those of a list of new units.

    When ``REMEMBERED`` units are held, they become the older half and a new half begins: what is still in use
    moves over, the rest is forgotten with the next change.
    """

    def __init__(self, compute):
        self.compute = compute
        self.now: dict = {}
        self.older: dict = {}

    def of(self, text: str) -> Iterator[Iterator]:
        """The results of a text's units in order, part by part."""
        for part in parts(text):
            cut = units(part)
            new = set(cut).difference(self.now)
            if len(self.now) + len(new) > REMEMBERED:
                self.older, self.now, new = self.now, {}, set(cut)
            older = self.older
            self.now.update((u, older[u]) for u in new if u in older)
            unknown = [u for u in new if u not in older]
            if unknown:
                self.now.update(zip(unknown, self.compute(unknown)))
            yield map(self.now.__getitem__, cut)

    def joined(self, text: str) -> bytes:
        return b"".join([b"".join(results) for results in self.of(text)])


def byte_alphabet() -> dict[int, str]:
    """The printable character that a byte-level vocabulary writes for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder:
    """Ids of whole texts as packed little-endian integers of ``dtype``."""

    def __init__(self, name: str, dtype: str):
        tokenizer, alphabet = load(name), byte_alphabet()
        merge, code = tokenizer.model.tokenize, {2: "H", 4: "I"}[np.dtype(dtype).itemsize]

        def ids(unit: str) -> list[int]:
            # a word is one piece and goes to the merges at once
            if one_piece(unit):
                return [t.id for t in merge(unit.encode().decode("latin-1").translate(alphabet))]
            return tokenizer.encode(unit, add_special_tokens=False).ids

        def packed(found: list[int]) -> bytes:
            held = array(code, found)
            if sys.byteorder == "big":
                held.byteswap()
            return held.tobytes()

        self.memory = Remembered(lambda new: [packed(ids(unit)) for unit in new])

    def encode(self, texts: list[str]) -> list[bytes]:
        return list(map(self.memory.joined, texts))


@lru_cache(maxsize=4)
def encoder(name: str, dtype: str) -> Encoder:
    return Encoder(name, dtype)
