"""Context-tree weighting over bytes, from counts of byte strings.

A string of depth + 1 bytes is a context (its first bytes) and the byte after it,
packed into an integer with that byte lowest. The byte is decomposed into eight
binary decisions, each with a tree over contexts of 0 to ``depth`` bytes.
"""

from __future__ import annotations

import math

import numpy as np

#: Stands before the first byte of a text, and is what comes after its last: no byte of UTF-8.
EDGE = 0xFF


def strings(data: bytes, depth: int) -> np.ndarray:
    """The context and byte at each position of ``data``, which starts with ``depth`` edges."""
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros(len(raw) - depth, np.int64)
    for i in range(depth + 1):
        out = out << 8 | raw[i : len(raw) - depth + i]
    return out


_LGAMMA_HALF = math.lgamma(0.5)
_SMALL = np.array([math.lgamma(n + 0.5) - _LGAMMA_HALF for n in range(1 << 12)])
_WHOLE = np.array([math.lgamma(n + 1) for n in range(1 << 13)])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x of some hundreds and more, by Stirling's series."""
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a zeros and b ones in any one order."""
    out = np.zeros(len(a))
    small = (a < len(_SMALL)) & (b < len(_SMALL))
    out[small] = _SMALL[a[small]] + _SMALL[b[small]] - _WHOLE[(a + b)[small]]
    x, y = a[~small].astype(float), b[~small].astype(float)
    half = lambda v: np.where(v < len(_SMALL), _SMALL[np.minimum(v, len(_SMALL) - 1).astype(int)], _log_gamma(np.maximum(v, 100) + 0.5) - _LGAMMA_HALF)
    out[~small] = half(x) + half(y) - _log_gamma(x + y + 1)
    return out


def _sums(starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else values[:0]


class Level:
    """The binary nodes of all contexts of one depth: zeros, ones, weighted probability."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        kt = log_kt(zeros, ones)
        self.weighted = kt if below is None else np.logaddexp(kt, below) - math.log(2)
        #: Share of the estimate at this depth against those further down.
        self.own = np.ones(len(keys)) if below is None else np.exp(kt - math.log(2) - self.weighted)
        self.chance = (ones + 0.5) / (zeros + ones + 1)


def grouped(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> Level:
    """A level from parts of its nodes in any order."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return Level(keys[starts], _sums(starts, zeros[order]), _sums(starts, ones[order]), None if below is None else _sums(starts, below[order]))


def node_keys(found: np.ndarray, depth: int, bit: int) -> np.ndarray:
    """Node of the ``bit``-th decision in the last ``depth`` bytes of context, for packed strings."""
    context = (found >> 8) & ((1 << 8 * depth) - 1)
    return context << 8 | (1 << bit) | ((found & 0xFF) >> (8 - bit))


def upward(found: np.ndarray, counts: np.ndarray, depth: int, top: int) -> list[list[Level]]:
    """Levels of depth ``top`` to ``depth`` for each bit, deepest last, from distinct strings and their counts."""
    out: list[list[Level]] = []
    for bit in range(8):
        one = (found >> (7 - bit)) & 1
        level = grouped(node_keys(found, depth, bit), counts * (1 - one), counts * one, None)
        levels = [level]
        for d in range(depth - 1, top - 1, -1):
            context = (level.keys >> 8) & ((1 << 8 * d) - 1)
            level = grouped(context << 8 | (level.keys & 0xFF), level.zeros, level.ones, level.weighted)
            levels.append(level)
        out.append(levels[::-1])
    return out


def downward(found: np.ndarray, trees: list[list[Level]], depth: int, top: int) -> np.ndarray:
    """Natural logarithm of the probability of each string's last byte in its context.

    An estimate of a context that training never reached is left out, so the
    deepest one with counts closes the mixture; if there is none it is one half.
    """
    total = np.zeros(len(found))
    for bit, levels in enumerate(trees):
        chance, rest = np.zeros(len(found)), np.ones(len(found))
        last = np.full(len(found), 0.5)
        for d, level in zip(range(top, depth + 1), levels, strict=True):
            keys = node_keys(found, d, bit)
            at = np.minimum(np.searchsorted(level.keys, keys), max(len(level.keys) - 1, 0))
            seen = (level.keys[at] == keys) & (level.zeros[at] + level.ones[at] > 0) if len(level.keys) else np.zeros(len(found), bool)
            own = np.where(seen, level.own[at], 0) if len(level.keys) else np.zeros(len(found))
            p = np.where(seen, level.chance[at], last) if len(level.keys) else last
            chance += rest * own * p
            rest = rest * (1 - own)
            last = p
        chance += rest * last
        one = (found >> (7 - bit)) & 1
        total += np.log(np.where(one == 1, chance, 1 - chance))
    return total
