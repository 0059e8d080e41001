"""Terms of texts by arrays: runs of letters, lowered, as numbers of a fixed vocabulary."""

from __future__ import annotations

import re
import sys
from functools import cached_property

import numpy as np
import xxhash

TERM = re.compile(r"[^\W\d_]+")
#: Which code points are letters, as the pattern has it.
LETTER = np.zeros(sys.maxunicode + 1, bool)
LETTER[np.fromiter((ord(c) for c in "".join(TERM.findall("".join(map(chr, range(sys.maxunicode + 1)))))), np.int64)] = True
#: Runs of up to so many characters are hashed by arrays, longer ones each by itself.
LONG = 64
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(LONG)], np.uint64)


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").lower())


class Runs:
    """The letter runs of some texts, one after another, with 64-bit hashes."""

    def __init__(self, texts: list[str | None]):
        lowered = [(t or "").lower() for t in texts]
        self.code = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = LETTER[self.code]
        edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        edges = np.concatenate([[0], edges]) if letter[0] else edges  # the last character is none
        self.starts, self.sizes = edges[::2], edges[1::2] - edges[::2]
        self.bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1)])
        #: every letter, and its place in its run
        self.letters = self.code[letter]
        self.first = np.cumsum(self.sizes) - self.sizes
        self.inside = np.arange(len(self.letters), dtype=np.int32) - np.repeat(self.first.astype(np.int32), self.sizes)
        self.keys = np.zeros(0, np.uint64)
        if len(self.starts):
            sums = np.add.reduceat((self.letters + np.uint64(1)) * _POWERS[np.minimum(self.inside, LONG - 1)], self.first)  # as 64-bit numbers
            self.keys = (sums ^ (sums >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + self.sizes.view(np.uint64)
            for run in np.flatnonzero(self.sizes > LONG):
                self.keys[run] = xxhash.xxh64_intdigest(self.at(run).encode("utf-8", "surrogatepass"))

    def at(self, run: int) -> str:
        return self.code[self.starts[run] : self.starts[run] + self.sizes[run]].tobytes().decode("utf-32-le", "surrogatepass")


class Vocabulary:
    """Numbers of terms. A hash finds a term's place and its characters are compared, so no term is taken for another."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        runs = Runs(terms)
        if len(runs.starts) != len(terms):
            raise ValueError("a term is not one run of lower-case letters")
        self.bits = max(8, (4 * len(terms)).bit_length())
        self.places = np.full(1 << self.bits, -1, np.int32)
        self.keys, self.letters, self.first, self.sizes = runs.keys, runs.letters, runs.first, runs.sizes
        left = np.arange(len(terms), dtype=np.int32)
        slot = self._slots(self.keys)
        while len(left):
            free = left[self.places[slot[left]] < 0]
            self.places[slot[free]] = free
            left = left[self.places[slot[left]] != left]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def __len__(self) -> int:
        return len(self.terms)

    @cached_property
    def number(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.terms)}

    def __getstate__(self) -> list[str]:
        return self.terms

    def __setstate__(self, terms: list[str]) -> None:
        self.__init__(terms)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def numbers(self, runs: Runs) -> np.ndarray:
        """The number of each run, -1 for those that aren't terms."""
        out = np.full(len(runs.starts), -1, np.int64)
        if not len(self.terms) or not len(out):
            return out
        slot, left = self._slots(runs.keys), np.arange(len(out))
        while len(left):
            found = self.places[slot[left]]
            hit = (self.keys[found] == runs.keys[left]) & (found >= 0)
            out[left[hit]] = found[hit]
            left = left[~hit & (found >= 0)]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        # the letters of those found, against the vocabulary's
        wrong = (out >= 0) & (self.sizes[out] != runs.sizes)
        place = np.minimum(np.repeat(self.first[out], runs.sizes) + runs.inside, len(self.letters) - 1)
        wrong |= (out >= 0) & np.logical_or.reduceat(self.letters[place] != runs.letters, runs.first)
        for run in np.flatnonzero(wrong):
            out[run] = self.number.get(runs.at(run), -1)
        return out

    def counted(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text and term in it, ascending: text, term, how often."""
        runs, size = Runs(texts), max(1, len(self.terms))
        terms = self.numbers(runs)
        of_text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(runs.starts, runs.bounds)))
        known = terms >= 0
        pairs, n = np.unique(of_text[known] * size + terms[known], return_counts=True)
        return pairs // size, pairs % size, n


__all__ = ["Runs", "Vocabulary", "terms_of"]
