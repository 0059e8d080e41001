"""Byte-level BPE over pieces of text that can be encoded apart from each other.

A space that follows a character other than white space always starts a new
pre-token, so a text can be cut there and every piece encoded by itself. Pieces
repeat, so a bounded table keeps what was computed for each.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, compress, repeat
from operator import is_

import numpy as np
import regex

#: The pre-tokenisation pattern of the byte-level BPE files, with
#: Unicode white space spelt out.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
PRE_TOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + WHITE + r"\p{L}\p{N}]+|[" + WHITE + "]+(?![^" + WHITE + "])|[" + WHITE + "]+"
)
CONTRACTIONS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))

_WHITE = frozenset(WHITE)
#: Marks the key of a text's first piece, which has no leading space. A lone surrogate is in no UTF-8 text.
FIRST = "\ud800"


def pieces(text: str) -> list[str]:
    """Cut ``text`` before every space that follows a non-white character.

    The leading space of each piece but the first is left out. Joining the
    pieces with spaces gives the text back.
    """
    out: list[str] = []
    held: str | None = None
    for part in text.split(" "):
        held = part if held is None else f"{held} {part}"
        if held and held[-1] not in _WHITE:
            out.append(held)
            held = None
    if held is not None:
        out.append(held)
    return out


ONE = (1,)
#: White space before a space, where a plain split at spaces would cut wrongly.
_BEFORE_SPACE = [w + " " for w in WHITE]
_BEFORE_SPACE_ASCII = [w for w in _BEFORE_SPACE if w.isascii()]


def cut_at_spaces(text: str) -> list[str]:
    """The same as :func:`pieces`, by a plain split where that is right."""
    if not text or text[0] == " " or text[-1] in _WHITE or any(w in text for w in (_BEFORE_SPACE_ASCII if text.isascii() else _BEFORE_SPACE)):
        return pieces(text)
    return text.split(" ")


class PieceTable:
    """``make`` of each piece, kept for about ``size`` short pieces.

    ``make`` gets full pieces (leading space included) and returns one bytes
    object for each. The table is emptied when it is full and texts are taken a
    few at a time, so memory is bounded whatever they hold.
    """

    def __init__(self, make: Callable[[list[str]], Iterable[bytes]], size: int = 300_000, longest: int = 40, chars: int = 1_000_000):
        self.make, self.size, self.longest, self.chars = make, size, longest, chars
        self.known: dict[str, bytes] = {}
        #: After a letter, each of these is a pre-token of its own at a piece's end.
        self.ends = dict(zip(",.", make([",", "."]), strict=True))

    def of_batch(self, texts: list[str]) -> list[bytes]:
        """For each text, the values of its pieces joined."""
        out: list[bytes] = []
        some: list[str] = []
        chars = 0
        for text in texts:
            some.append(text)
            chars += len(text)
            if chars > self.chars:
                out += self._of_some(some)
                some, chars = [], 0
        return out + self._of_some(some)

    def _of_some(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.size:  # short pieces are the most frequent
            short = {k: v for k, v in self.known.items() if len(k) <= 7}
            self.known = short if len(short) < self.size // 2 else {}
        known = self.known
        get = known.get
        cuts: list[tuple[list[str], list[bytes | None]]] = []
        missing: dict[str, None] = {}
        for text in texts:
            cut = cut_at_spaces(text)
            cut[0] = FIRST + cut[0]
            found = list(map(get, cut))
            cuts.append((cut, found))
            if None in found:
                missing.update(dict.fromkeys(compress(cut, map(is_, found, repeat(None)))))
        if missing:
            ended = [k for k in missing if k[-1:] in self.ends and k[-2:-1].isalpha()]
            need = dict.fromkeys(k[:-1] for k in ended if k[:-1] not in known)
            need.update(dict.fromkeys(missing.keys() - set(ended)))
            known.update(zip(need, self.make([k[1:] if k[:1] == FIRST else f" {k}" for k in need]), strict=True))
            known.update((k, known[k[:-1]] + self.ends[k[-1]]) for k in ended)
            missing.update(need)
        out = [b"".join(map(known.__getitem__, cut)) if None in found else b"".join(found) for cut, found in cuts]
        for k in missing:
            if len(k) > self.longest:
                del known[k]
        return out


def _changes(counts: list[int]) -> bytes:
    """Differences of neighbouring counts from 0 on, as signed bytes."""
    return bytes([(b - a) & 255 for a, b in zip((0, *counts), counts)])  # noqa: B905


def _white_runs(words: list[str]) -> Iterator[str]:
    """White runs as prefixes of a text may end in them: each pre-token's part of a run and all before it."""
    run = ""
    for word in words:
        lead = 0
        while lead < len(word) and word[lead] in _WHITE:
            lead += 1
        if lead:
            run += word[:lead]
            yield run
        if lead < len(word):
            run = ""


#: Pre-tokens of up to so many bytes are done together.
LONG = 32
#: Stands for no token before.
NONE = 65535
BASE = np.uint64(0x9E3779B97F4A7C15)
POWERS = [np.uint64(pow(int(BASE), k, 1 << 64)) for k in range(LONG + 1)]


def _spread(hashes: np.ndarray, length: int) -> np.ndarray:
    """64-bit keys of strings of a length, from their polynomial hashes."""
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(length)
    return (mixed ^ (mixed >> np.uint64(32))).view(np.int64)


def _hash_of(tokens: list[bytes]) -> np.ndarray:
    out = np.zeros(len(tokens), np.int64)
    for i, token in enumerate(tokens):
        h = 0
        for b in token:
            h = (h * int(BASE) + b + 1) % (1 << 64)
        out[i] = _spread(np.array([h], np.uint64), len(token))[0]
    if len(np.unique(out)) < len(out):
        raise ValueError("two tokens have the same key")
    return out


class Lookup:
    """Arrays of 64-bit keys to small values by open addressing; emptied when half full."""

    def __init__(self, tries: int, bits: int):
        self.tries, self.shift = tries, np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        self.used = 0

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        at = (keys.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> self.shift
        return (at.astype(np.int64) + probe) & (len(self.keys) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, -1 for those that aren't there."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for probe in range(self.tries):
            at = self._slot(keys[left], probe)
            found = self.keys[at]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[hit]]
            left = left[(~hit) & (found != -1)]
            if not len(left):
                break
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keep distinct new keys, those that find no slot in ``tries`` left out."""
        if self.used > len(self.keys) // 2:
            self.keys[:], self.values[:], self.used = -1, -1, 0
        for probe in range(self.tries):
            at = self._slot(keys, probe)
            free = self.keys[at] == -1
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]
            put = self.keys[at] == keys
            self.used += int(put.sum())
            keys, values = keys[~put], values[~put]
            if not len(keys):
                return


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 as itself, the rest from 256 up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def require_byte_level(path: str) -> dict:
    """A file in the tokenizers format, if its texts are cut by the pattern that this module has."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut = spec.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    if not plain or spec.get("normalizer") or spec["model"].get("type") != "BPE" or spec["model"].get("ignore_merges") or spec["model"].get("dropout"):
        raise ValueError(f"{path} is not a plain byte-level BPE")
    if any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec["added_tokens"]):
        raise ValueError(f"{path} has added tokens that are not matched as they are")
    return spec


class PrefixCounter:
    """Exact token counts of every prefix of a text, without encoding prefixes.

    Within a pre-token the count of a prefix of i bytes is one more than that of
    i - len(t), where t is the one token that may follow the last token there:
    two neighbours are right exactly when encoding their joined bytes gives them
    back, and the last token of each prefix is unique. So one pass of dynamic
    programming over the bytes gives all counts.
    """

    def __init__(self, path: str):
        spec = require_byte_level(path)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.ids = {raw(k): v for k, v in spec["model"]["vocab"].items() if k not in set(self.special)}
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.longest = max(map(len, self.ids))
        self.lengths = [n for n in range(1, LONG + 1) if any(len(t) == n for t in self.ids)]
        self.tokens = Lookup(16, 19)
        self.tokens.add(_hash_of(list(self.ids)), np.fromiter(self.ids.values(), np.int64))
        if (self.tokens.get(_hash_of(list(self.ids))) != np.fromiter(self.ids.values(), np.int64)).any():
            raise ValueError("the vocabulary does not fit its table")
        self.by_id = {i: t for t, i in self.ids.items()} | {NONE: b""}
        #: the bytes of tokens by id, against which the strings that a hash finds are compared
        self.bytes_of = np.zeros((max(self.ids.values()) + 1, LONG), np.uint8)
        for token, i in self.ids.items():
            self.bytes_of[i, : len(token[:LONG])] = np.frombuffer(token[:LONG], np.uint8)
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.fits = Lookup(8, 21)
        self.words: dict[str, bytes] = {}
        self.table = PieceTable(self.steps)
        self.around = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def merged(self, data: bytes) -> list[bytes]:
        """Plain BPE of a few bytes."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.rank
        while len(parts) > 1:
            best, at = min((rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 60:
                break
            a, b = parts[at], parts[at + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def follows(self, last: bytes, token: bytes) -> bool:
        """Whether encoding ``last + token`` gives these two; ``last`` may be empty."""
        if (known := self.pairs.get((last, token))) is None:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            known = self.merged(last + token) == ([last, token] if last else [token])
            self.pairs[last, token] = known
        return known

    def long_word(self, word: str) -> bytes:
        """The pass over one pre-token of any length; the changes of its count at each character."""
        data = word.encode()
        last, count = [b""], [0]
        for i in range(1, len(data) + 1):
            for n in range(min(i, self.longest), 0, -1):
                token = data[i - n : i]
                if token in self.ids and self.follows(last[i - n], token):
                    last.append(token)
                    count.append(count[i - n] + 1)
                    break
            else:
                raise ValueError("the vocabulary does not hold every byte")
        return _changes([count[e] for e in accumulate(len(c.encode()) for c in word)])

    def short_words(self, words: list[bytes]) -> list[bytes]:
        """The same for many pre-tokens of at most ``LONG`` bytes, all at once, byte by byte."""
        n, sizes = len(words), np.fromiter(map(len, words), np.int64)
        width = int(sizes.max())
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        prefix = np.zeros((width + 1, n), np.uint64)
        for i in range(width):
            prefix[i + 1] = prefix[i] * BASE + text[:, i] + np.uint64(1)
        last = np.full((width + 1, n), NONE, np.int64)
        count = np.zeros((width + 1, n), np.int64)
        for i in range(1, width + 1):
            rows = np.flatnonzero(sizes >= i)
            for k in reversed(self.lengths):
                if k > i or not len(rows):
                    continue
                token = self.tokens.get(_spread(prefix[i][rows] - prefix[i - k][rows] * POWERS[k], k))
                some = token >= 0
                some[some] = (self.bytes_of[token[some], :k] == text[rows[some], i - k : i]).all(1)
                if not some.any():
                    continue
                at, token = rows[some], token[some]
                pair = last[i - k][at] << 16 | token
                fit = self.fits.get(pair)
                if (fit < 0).any():
                    fresh = np.unique(pair[fit < 0])
                    known = [self.follows(self.by_id[p >> 16], self.by_id[p & 65535]) for p in fresh.tolist()]
                    self.fits.add(fresh, np.array(known, np.int64))
                    unknown = fit < 0
                    fit[unknown] = np.array(known)[np.searchsorted(fresh, pair[unknown])]
                done = fit == 1
                last[i][at[done]] = token[done]
                count[i][at[done]] = count[i - k][at[done]] + 1
                rows = rows[(~some) | np.isin(rows, at[~done], assume_unique=True)] if not done.all() else rows[~some]
        # a character's count is that at its last byte
        ends = np.ones((n, width), bool)
        ends[:, :-1] = text[:, 1:] & 0xC0 != 0x80
        ends &= np.arange(width) < sizes[:, None]
        counts = count[1:].T[ends]
        chars = ends.sum(1)
        starts = np.cumsum(chars) - chars
        change = np.diff(counts, prepend=0)
        change[starts[chars > 0]] = counts[starts[chars > 0]]
        data = change.astype(np.int8).tobytes()
        return [data[a : a + c] for a, c in zip(starts.tolist(), chars.tolist(), strict=True)]

    def learn(self, words: Iterable[str]) -> None:
        """Put the changes of these pre-tokens into ``words``."""
        if len(self.words) > 150_000:
            self.words.clear()
        new = [w for w in words if w not in self.words]
        for w in new:
            if len(w) > LONG // 2 and len(w.encode()) > LONG:
                self.words[w] = self.long_word(w)
        short = sorted((w for w in new if w not in self.words), key=len)
        for low in range(0, len(short), 8192):
            some = short[low : low + 8192]
            self.words.update(zip(some, self.short_words([w.encode() for w in some]), strict=True))

    def steps(self, pieces: list[str]) -> Iterator[bytes]:
        """For each piece, the changes of the count at its characters, as signed bytes."""
        plain = [p for p in pieces if p[:1] == " " and p[1:].isalpha()]
        cut = [PRE_TOKEN.findall(p) for p in pieces if p[:1] != " " or not p[1:].isalpha()]
        self.learn({*plain, *(w for words in cut for w in words), *(r for words in cut for r in _white_runs(words)), *CONTRACTIONS})
        parts = iter(cut)
        for p in pieces:
            if p[:1] == " " and p[1:].isalpha():
                yield self.words[p]
            else:
                yield self.joined(next(parts))
        for w in [w for words in cut for w in words if len(w) > LONG]:
            self.words.pop(w, None)

    def joined(self, words: list[str]) -> bytes:
        """Changes over neighbouring pre-tokens.

        A prefix that ends in white space has that whole run as its last
        pre-token, whatever follows; one that ends within a contraction of three
        characters has two pre-tokens for it.
        """
        totals: list[int] = []
        done, run = 0, ""  # tokens of whole pre-tokens so far; the white run that ends there
        before = 0  # tokens before that run
        for word in words:
            counts = list(accumulate(s - 256 if s > 127 else s for s in self.words[word]))
            lead = 0
            while lead < len(word) and word[lead] in _WHITE:
                lead += 1
            if lead:
                if not run:
                    before = done
                run += word[:lead]
                totals += [before + c for c in list(accumulate(s - 256 if s > 127 else s for s in self.words[run]))[-lead:]]
            if lead < len(word):
                run = ""
                if len(word) > 2 and word in CONTRACTIONS:
                    totals += [done + 1, done + 2, done + counts[-1]]
                else:
                    totals += [done + c for c in counts[lead:]]
            done += counts[-1]
        return _changes(totals)

    def of_batch(self, texts: list[str]) -> list[bytes]:
        """For each text, the changes of the count at its characters, as signed bytes."""
        cut = [self.around.split(t) if self.around and any(s in t for s in self.special) else [t] for t in texts]
        plain, where = [], []
        for i, parts in enumerate(cut):
            for k in range(0, len(parts), 2):
                inside = parts[k + 1][:-1] if k + 1 < len(parts) else ""
                where.append((i, len(parts[k]), bool(inside)))
                plain.append(parts[k] + inside)
        out: list[list[bytes]] = [[] for _ in texts]
        for (i, own, more), steps in zip(where, self.table.of_batch(plain), strict=True):
            out[i].append(steps)
            if more:  # the whole special string is one token after the text before it
                extra = sum(s - 256 if s > 127 else s for s in steps[own:])
                out[i].append(bytes([(1 - extra) & 255]))
        return [b"".join(x) for x in out]
