"""Token ids of many texts by the tokenizers library, each distinct piece encoded once.

Texts are cut where a pre-token surely begins, whatever stands around: at most
changes between ASCII letters, digits, marks and white space. A hash finds a
piece's entry in a bounded table and its bytes are compared with the entry's;
pieces not known yet are encoded by the library, texts with a piece whose hash
is another's are encoded whole, and all ids are put together by arrays.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
from tokenizers import Tokenizer

from .bpe import Lookup, byte_alphabet, require_byte_level

#: White space outside ASCII, in UTF-8. Texts with it are encoded whole.
OTHER_WHITE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
LETTER, DIGIT, MARK, APOSTROPHE, SPACE, BREAK, OTHER = range(7)
BLOCK = 500_000
BASE = 0x9E3779B97F4A7C15


def _classes() -> np.ndarray:
    out = np.full(256, MARK, np.uint8)
    out[128:] = OTHER
    for low, high, kind in ((65, 90, LETTER), (97, 122, LETTER), (48, 57, DIGIT), (9, 13, BREAK), (32, 32, SPACE), (39, 39, APOSTROPHE)):
        out[low : high + 1] = kind
    return out


def _cuts() -> np.ndarray:
    """Whether a piece begins between two classes; after a lone break this is decided apart.

    A letter may go on an apostrophe (a contraction), a space leads what follows,
    and characters outside ASCII may be of any kind.
    """
    cut = np.zeros((8, 8), bool)
    solid = (LETTER, DIGIT, MARK, APOSTROPHE, OTHER)
    for a in solid:
        cut[a, [SPACE, BREAK]] = True
    cut[LETTER, [DIGIT, MARK, APOSTROPHE]] = True
    cut[DIGIT, [LETTER, MARK, APOSTROPHE]] = True
    cut[MARK, [LETTER, DIGIT]] = True
    cut[APOSTROPHE, DIGIT] = True
    return cut.ravel()


CLASS, CUT = _classes(), _cuts()


def starts_of(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces start in joined texts that start at ``first`` (some byte in each)."""
    kind = CLASS[data]
    begins = np.zeros(len(data), bool)
    begins[1:] = CUT[kind[:-1] * 8 + kind[1:]]
    begins[first] = True
    # a break by itself, or with what follows if white space stands before it
    after = np.flatnonzero((kind[:-1] == BREAK) & (kind[1:] != BREAK) & (kind[1:] != SPACE)) + 1
    if len(after):
        white = np.zeros(len(data) + 1, bool)
        white[1:] = (kind == SPACE) | (kind == BREAK)
        text_start = np.zeros(len(data), bool)
        text_start[first] = True
        begins[after] |= ~white[after - 1] | text_start[after - 1]
    return np.flatnonzero(begins)


class TokenIds:
    """Ids of texts by a byte-level BPE file, with a bounded table of pieces.

    A file of another pre-tokenisation or with a normaliser raises ValueError.
    """

    def __init__(self, path: str, pieces: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        require_byte_level(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.stand_ins = {b: ord(c) for c, b in byte_alphabet().items() if b != 10}
        self.most = pieces
        powers = [1]
        for _ in range(BLOCK):
            powers.append(powers[-1] * BASE % (1 << 64))
        self.powers = np.array(powers, np.uint64)
        inverse = pow(BASE, -1, 1 << 64)
        back = [1]
        for _ in range(BLOCK):
            back.append(back[-1] * inverse % (1 << 64))
        self.back = np.array(back, np.uint64)
        self.forget()

    def forget(self) -> None:
        self.table = Lookup(12, 20)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.sizes = np.zeros(1 << 16, np.int64)
        #: the bytes of entries, where each one's start, and how many
        self.text = np.zeros(1 << 20, np.uint8)
        self.text_starts = np.zeros(1 << 16, np.int64)
        self.text_sizes = np.zeros(1 << 16, np.int64)
        self.n = self.used = self.held = 0

    def encoded(self, pieces: list[str]) -> list[list[int]]:
        """The library's ids of texts, those of one word by its model alone."""
        word = [p.isalpha() or p[:1] == " " and p[1:].isalpha() for p in pieces]
        words = [p for p, w in zip(pieces, word, strict=True) if w]
        mapped = "\n".join(words).encode().decode("latin-1").translate(self.stand_ins).split("\n") if words else []
        known = iter([[t.id for t in tokens] for tokens in map(self.tokenizer.model.tokenize, mapped)])
        other = [p for p, w in zip(pieces, word, strict=True) if not w]
        rest = iter([x.ids for low in range(0, len(other), 1000) for x in self.tokenizer.encode_batch_fast(other[low : low + 1000], add_special_tokens=False)])
        return [next(known) if w else next(rest) for w in word]

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        ids = self.encoded([p.decode() for p in pieces])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.held + int(lengths.sum()) > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        while self.n + len(keys) > len(self.starts):
            self.starts, self.sizes, self.text_starts, self.text_sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.text_starts, self.text_sizes))
        own = slice(self.n, self.n + len(keys))
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[own], self.sizes[own] = self.used + np.cumsum(sizes) - sizes, sizes
        self.text[self.held : self.held + int(lengths.sum())] = np.frombuffer(b"".join(pieces), np.uint8)
        self.text_starts[own], self.text_sizes[own] = self.held + np.cumsum(lengths) - lengths, lengths
        self.table.add(keys, np.arange(self.n, self.n + len(keys)))
        self.n += len(keys)
        self.used += len(flat)
        self.held += int(lengths.sum())

    def _places(self, joined: bytes, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Entry of each piece by its hash, new ones learnt."""
        if self.n > self.most or self.held > 1 << 25:
            self.forget()
        at = self.table.get(keys)
        if (at < 0).any():
            fresh, first = np.unique(keys[at < 0], return_index=True)
            which = np.flatnonzero(at < 0)[first]
            before = self.n
            self._learn(fresh, [joined[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)])
            new = np.flatnonzero(at < 0)
            at[new] = before + np.searchsorted(fresh, keys[new])
        return at

    def _others(self, data: np.ndarray, place: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Pieces whose bytes are not those of their entry."""
        wrong = self.text_sizes[place] != sizes
        at = np.repeat(self.text_starts[place] - starts, sizes) + np.arange(len(data))
        differ = self.text[np.minimum(at, len(self.text) - 1)] != data
        if differ.any():
            wrong |= np.logical_or.reduceat(differ, starts)
        return np.flatnonzero(wrong)

    def _plain(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Ids of texts of some bytes each, one after another, the number of each text's, and the texts whose ids are wrong."""
        joined = b"".join(texts)
        data = np.frombuffer(joined, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(sizes) - sizes
        starts = starts_of(data, first)
        ends = np.concatenate([starts[1:], [len(data)]])
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=sums[1:])
        keys = (sums[ends] - sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        keys = ((keys ^ (keys >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)
        keys[keys == -1] = -2  # marks a free slot
        place = self._places(joined, keys, starts, ends)
        wrong = self._others(data, place, starts, ends - starts)
        counts = self.sizes[place]
        total = np.cumsum(counts)
        ids = self.ids[np.repeat(self.starts[place] - total + counts, counts) + np.arange(total[-1])]
        return ids, np.add.reduceat(counts, np.searchsorted(starts, first)), np.unique(np.searchsorted(first, starts[wrong], side="right") - 1).tolist()

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)

    def of_batch(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text (UTF-8), special strings inside being their one token."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        some: list[int] = []
        size = 0

        def flush() -> None:
            ids, counts, wrong = self._plain([texts[i] for i in some])
            for i, a, b in zip(some, np.cumsum(counts) - counts, np.cumsum(counts), strict=True):
                out[i] = ids[a:b]
            for k in wrong:
                out[some[k]] = self._whole(texts[some[k]])

        for i, text in enumerate(texts):
            if len(text) > BLOCK or any(s in text for s in self.special) or not text.isascii() and OTHER_WHITE.search(text):
                out[i] = self._whole(text)
            elif text:
                if size + len(text) > BLOCK:
                    flush()
                    some, size = [], 0
                some.append(i)
                size += len(text)
        if some:
            flush()
        return out


__all__ = ["TokenIds", "starts_of"]
