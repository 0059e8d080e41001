"""Removal of passages that an earlier document holds, by longest previous factors.

Candidates are found first: windows of ``length`` bytes whose least short string
other documents have as well. Where such windows meet they are put in suffix
order, as far as ``length`` bytes go. The previous and the next smaller position
in that order, which are the nearest windows of smaller documents on either side,
tell whether a window's longest previous factor reaches ``length``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Chunk, chunked, restored, squeezed
from .common import checkpointed, utf8, written
from .exchange import ANSWERS, KEYS, KeyExchange, Route, parts, regions_of

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits of an anchor's key below those that choose its bucket.
KEY_BITS = 32


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def rolling(data: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of all strings of these lengths, by joining those of powers of two; entry i is that at position i."""
    by = {1: data.astype(np.uint64) + np.uint64(1)}
    n = 1
    while 2 * n <= max(lengths):
        h = by[n]
        by[2 * n] = h[: max(0, len(h) - n)] * _power(n) + h[n:]
        n *= 2
    out = {}
    for length in lengths:
        whole, done = None, 0
        for n in sorted(by, reverse=True):
            if length & n:
                if whole is None:
                    whole = by[n]
                else:
                    part = by[n][done:]
                    whole = whole[: len(part)] * _power(n) + part
                done += n
        out[length] = _mixed(whole)
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _least_ahead(h: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours from a position on."""
    n = 1
    while 2 * n <= width:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return h if n == width else np.minimum(h[: len(h) - (width - n)], h[width - n :])


class Anchors:
    """The windows of a run of documents, and for each its least string of ``piece`` bytes.

    Equal windows have their least string at the same place and of the same hash,
    whatever stands around them, so they meet under it.
    """

    def __init__(self, chunk: Chunk, low: int, high: int, length: int, piece: int):
        self.at = int(chunk.starts[low])
        end = int(chunk.starts[high - 1] + chunk.sizes[high - 1])
        self.data = np.frombuffer(chunk.data, np.uint8, end - self.at, self.at)
        self.doc = np.repeat(np.arange(low, high), chunk.sizes[low:high])
        width = length - piece + 1
        self.windows = np.zeros(0, np.int64)
        if len(self.data) < length:
            return
        hashes = rolling(self.data, (piece, length))
        own, self.whole = hashes[piece], hashes[length]
        least = _least_ahead(own, width)
        inside = self.doc[: len(least)] == self.doc[length - 1 :]
        self.windows = np.flatnonzero(inside)
        if not len(self.windows):
            return
        # a string is an anchor if it is the least of a window: then the largest of its windows' least ones is its own
        held = np.zeros(len(own) + width - 1, np.uint64)
        held[width - 1 : width - 1 + len(least)] = np.where(inside, least, np.uint64(0))
        chosen = own == ~_least_ahead(~held, width)
        hit = np.flatnonzero(chosen)
        before = np.cumsum(chosen) - chosen
        # the first anchor from a window on that has its least hash
        least = least[self.windows]
        turn = before[self.windows]
        left = np.flatnonzero(own[hit[turn]] != least)
        while len(left):
            turn[left] += 1
            left = left[own[hit[turn[left]]] != least[left]]
        self.anchor, self.key = hit[turn], least


def _keys(hashes: np.ndarray, bits: int) -> np.ndarray:
    hashes = _mixed(hashes)  # least hashes are small; their buckets shall be even
    return (hashes >> np.uint64(64 - bits - KEY_BITS)).astype(np.int64)


def _runs(chunk: Chunk, length: int, piece: int, bits: int) -> tuple[np.ndarray, ...]:
    """Runs of windows under one anchor: key, document, first and last window, and the hashes of these two windows."""
    parts = [tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))]
    for low, high in chunk.blocks():
        a = Anchors(chunk, low, high, length, piece)
        if len(w := a.windows):
            starts = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1] + 1) | (a.anchor[1:] != a.anchor[:-1])]))
            ends = np.concatenate([starts[1:], [len(w)]]) - 1
            parts.append((_keys(a.key[starts], bits), a.doc[w[starts]], w[starts] + a.at, w[ends] + a.at, a.whole[w[starts]], a.whole[w[ends]]))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _whole_run(one: np.ndarray, two: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """A run's hash, from those of its first and last window and its size."""
    return _mixed(one * np.uint64(3) + (two ^ (two >> np.uint64(7))) * BASE + windows.astype(np.uint64))


def _distinct(runs: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sorted, which are in more than one document, and some number of different runs of each, 255 at most.

    The number is that of all runs where these are fewer than 16.
    """
    key, doc, first, last, one, two = runs
    if not len(key):
        return key, np.zeros(0, bool), np.zeros(0, np.uint8)
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    n = sizes.copy()
    many = np.flatnonzero(np.repeat(sizes >= 16, sizes))
    if len(many):
        at = order[many]
        whole, place = _whole_run(one[at], two[at], last[at] - first[at]), np.repeat(np.arange(len(starts)), sizes)[many]
        turn = np.lexsort((whole, place))
        whole, place = whole[turn], place[turn]
        new = np.concatenate([[True], (whole[1:] != whole[:-1]) | (place[1:] != place[:-1])])
        n[np.unique(place)] = np.bincount(place[new])[np.unique(place)]
    return key[starts], np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts), np.minimum(n, 255).astype(np.uint8)


def _single(data: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of runs, one by one: the run of each, where it starts, and its hash."""
    windows = last - first + 1
    run = np.repeat(np.arange(len(first)), windows)
    inside = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
    hashes = np.zeros(len(run), np.uint64)
    at = np.cumsum(windows)
    low = 0
    while low < len(first):  # some runs at a time
        high = max(low + 1, int(np.searchsorted(at, at[low] + 100_000)))
        sizes = windows[low:high] + length - 1
        own = slice(at[low] - windows[low], at[high - 1])
        place = np.repeat(np.cumsum(sizes) - sizes, windows[low:high]) + inside[own]
        hashes[own] = rolling(_cut(data, first[low:high], sizes), (length,))[length][place]
        low = high
    return run, first[run] + inside, hashes


def _cut(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of runs one after another."""
    total = np.cumsum(sizes)
    return data[np.repeat(starts - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)]


def _equal_runs(data: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Which runs have the bytes of their counterparts."""
    out = size_a == size_b
    for low in range(0, len(a), 20_000):
        some = low + np.flatnonzero(out[low : low + 20_000])
        if len(some):
            sizes = size_a[some]
            out[some] = ~np.logical_or.reduceat(_cut(data, a[some], sizes) != _cut(data, b[some], sizes), np.cumsum(sizes) - sizes)
    return out


def _word(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as numbers in their order."""
    return np.lib.stride_tricks.sliding_window_view(data, 8)[at].view(">u8").ravel().astype(np.uint64)


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Positions of different strings of ``length`` bytes (8 at least) in order of their bytes.

    They are ordered by eight bytes, and those still equal by the next ones.
    """
    order = np.argsort(_word(data, starts), kind="stable")
    key = _word(data, starts[order])
    new = np.concatenate([[True], key[1:] != key[:-1]])
    for at in [*range(8, length - 7, 8), length - 8]:
        tied = ~new
        tied[:-1] |= ~new[1:]
        some = np.flatnonzero(tied)
        if not len(some):
            break
        segment = np.cumsum(new)[some]
        key = _word(data, starts[order[some]] + at)
        turn = np.lexsort((key, segment))
        order[some] = order[some][turn]
        key = key[turn]
        new[some[1:]] |= (key[1:] != key[:-1]) & (some[1:] == some[:-1] + 1)
    return order


def previous_smaller(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each position the nearest one before it of a smaller value, within runs that start where ``first`` is set; -1 for none.

    All between a position and its pointer are no smaller, so a pointer moves on
    to its target's own pointer until it finds a smaller value.
    """
    pointer = np.where(first, -1, np.arange(len(values)) - 1)
    left = np.flatnonzero(pointer >= 0)
    while True:
        left = left[values[pointer[left]] >= values[left]]
        if not len(left):
            return pointer
        pointer[left] = pointer[pointer[left]]
        left = left[pointer[left] >= 0]


def covered(data: np.ndarray, starts: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """Which positions start a string of ``length`` bytes that one of a smaller document starts as well.

    Equal strings are told by 64-bit hashes, which are then compared byte by byte;
    the different ones are put in suffix order. A position's longest previous
    factor reaches ``length`` if its previous or next smaller one in that order
    (smaller by document) is of an equal string.
    """
    hashes = np.zeros(len(starts), np.uint64)
    for low in range(0, len(starts), 100_000):  # starts ascend
        some = starts[low : low + 100_000]
        hashes[low : low + 100_000] = rolling(data[some[0] : some[-1] + length], (length,))[length][some - some[0]]
    order = np.argsort(hashes, kind="stable")
    new = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])
    del hashes
    strings = np.lib.stride_tricks.sliding_window_view(data, length)
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    again = np.flatnonzero(~new)
    same = all((strings[starts[order[some]]] == strings[starts[lead[some]]]).all() for some in (again[low : low + 50_000] for low in range(0, len(again), 50_000)))
    del lead, again
    if not same:  # two strings of one hash: order by their bytes
        order = np.lexsort(strings[starts].T[::-1])
        new = np.concatenate([[True], (strings[starts[order[1:]]] != strings[starts[order[:-1]]]).any(1)])
    runs = np.flatnonzero(new)
    sizes = np.diff(np.concatenate([runs, [len(order)]]))
    by_bytes = suffix_order(data, starts[order[runs]], length)
    sizes = sizes[by_bytes]
    ends = np.cumsum(sizes)
    order = order[np.repeat(runs[by_bytes] - ends + sizes, sizes) + np.arange(len(order))]
    first = np.zeros(len(order), bool)
    first[ends - sizes] = True
    ranks = docs[order]
    found = previous_smaller(ranks, first) >= 0
    last = np.concatenate([first[1:], [True]])
    found |= previous_smaller(ranks[::-1], last[::-1])[::-1] >= 0
    out = np.zeros(len(order), bool)
    out[order] = found
    return out


def _intervals(chunk: int, starts: np.ndarray, ends: np.ndarray) -> tuple[int, bytes]:
    return chunk, zstandard.compress(np.stack([starts, ends]).astype(np.int64).tobytes(), 1)


def _bucket_of(keys: np.ndarray, bits: int, known: int) -> np.ndarray:
    """So many first bits of the buckets of keys that have ``bits`` of them."""
    return keys >> (KEY_BITS + bits - known)


def _add(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of a key in several places: whether several documents have it (the last bit), and its runs."""
    several = (np.bitwise_or.reduceat(values, starts) & 1) | (sizes > 1)
    return np.minimum(np.add.reduceat(values >> 1, starts), 1 << 40) << 1 | several


class Runs:
    """Runs of windows on their way: rank, first place, chunk and key of each, and their bytes one after another."""

    def __init__(self, places: np.ndarray, sizes: np.ndarray, text: np.ndarray):
        self.places, self.sizes, self.text = places, sizes, text
        self.edges = np.concatenate([[0], np.cumsum(sizes)])

    def packed(self, some: slice | np.ndarray, columns: int) -> tuple[bytes, bytes]:
        sizes = self.sizes[some]
        text = self.text[self.edges[some.start] : self.edges[some.stop]] if isinstance(some, slice) else _cut(self.text, self.edges[some], sizes)
        return squeezed(self.places[some, :columns].ravel()), zstandard.compress(sizes.astype(np.uint16).tobytes() + text.tobytes(), 3)

    @classmethod
    def unpacked(cls, group: pa.Table, columns: int) -> tuple[Runs, np.ndarray]:
        """The runs of a group's rows, and the row of each."""
        places = [restored(x, np.int64).reshape(-1, columns) for x in group.column("places").to_pylist()]
        raw = [np.frombuffer(zstandard.decompress(x), np.uint8) for x in group.column("text").to_pylist()]
        sizes = [r[: 2 * len(p)].view(np.uint16).astype(np.int64) for r, p in zip(raw, places, strict=True)]
        text = [r[2 * len(p) :] for r, p in zip(raw, places, strict=True)]
        return cls(np.concatenate(places), np.concatenate(sizes), np.concatenate(text)), np.repeat(np.arange(len(places)), [len(p) for p in places])


def without_repeats(docs: DataFrame, length: int = 50, piece: int = 24, chunk_bytes: int = 8_000_000, bucket_bytes: int = 4_000_000, keep_bytes: bool = False, hot: int = 4096, fan: int = 8) -> DataFrame:
    """Remove each byte that a string of ``length`` bytes covers which also starts in a document of smaller id.

    Returns, per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256 and, if ``keep_bytes``, kept (the remaining bytes).

    Texts are UTF-8 bytes; null ones are empty, and those below ``length`` bytes
    lose nothing. Matches don't cross documents and are judged on the input. Rows
    of equal ids are not smaller than each other. Null ids come after all others.
    Other columns are left out. An empty table gives an empty one.

    Four steps. Documents are put into chunks, written once. Each chunk sends the
    keys of its anchors (the least string of ``piece`` bytes of every window)
    and learns which of them other documents have; two equal windows
    have the same anchor, so no match is lost. Windows under such anchors are then
    sent with their bytes, each distinct run of them once for a chunk, which
    decides the other copies itself (runs of one hash are compared byte by byte).
    Where they meet :func:`covered` decides, what is covered goes back to its
    chunk, and tasks hold a chunk or a bucket. An anchor with more than ``hot``
    different runs, summed over chunks, is split: its windows are sent one by one,
    to buckets by the hash of the whole window, where equal ones still meet. Equal
    windows are sent once for each chunk that has them. All exchanges tell ``fan``
    bits of the buckets apart at a time (:mod:`~.exchange`).
    """
    if not 8 <= piece < length or length - piece > 200 or 2 * length - piece > 65_535:
        raise ValueError("piece must be at least 8 and below length, by 200 at most, and length below 32768")
    total = docs.agg(F.sum(F.octet_length(utf8(F.col("text"))))).first()[0] or 0
    bits = max(1, math.ceil(math.log2(max(total, 1) / bucket_bytes))) if total > bucket_bytes else 1
    chunks = chunked(docs, chunk_bytes)
    route = Route(bits, chunks.count(), fan)
    ways = KeyExchange(route, bits, lambda keys, known: _bucket_of(keys, bits, known), _add)
    steps = len(route.steps)
    columns = 2 if steps == 1 else 4  # in one step a row's runs are of one chunk and one bucket

    def send_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, several, different = _distinct(_runs(Chunk.unpack(blob), length, piece, bits))
                found = ways.rows(keys, different.astype(np.int64) << 1 | several)
                packed = [pa.array([f[i] for f in found], pa.binary()) for i in (1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([number] * len(found), pa.int64()), *packed], ["bucket", "source", "keys", "values"])

    def match_keys(group: pa.Table) -> pa.Table:
        sizes, _, totals, place = ways.opened(group)
        flags = (totals & 1) | ((totals >> 1) > hot).astype(np.int64) << 1
        return pa.table(ways.answers(group, sizes, flags[place].astype(np.uint8)))

    def send_runs(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, bytes, bytes | None]] = []
        for number, blob in zip(left.column("chunk").to_pylist(), left.column("blob").to_pylist(), strict=True):
            chunk = Chunk.unpack(blob)
            runs = _runs(chunk, length, piece, bits)
            keys = np.unique(runs[0])
            flags = ways.back(keys, dict(zip(right.column("bucket").to_pylist(), right.column("values").to_pylist(), strict=True)), np.uint8)
            shared, split = (flags & 1).astype(bool), flags > 1
            place = np.searchsorted(keys, runs[0])
            repeated = shared[place]
            if not repeated.any():
                continue
            data = np.frombuffer(chunk.data, np.uint8)
            alone = repeated & split[place]
            repeated &= ~alone
            key, doc, first, last, one, two = (c[repeated] for c in runs)
            if alone.any():
                run, at, hashes = _single(data, runs[2][alone], runs[3][alone], length)
                key, doc, first, last, one, two = (np.concatenate(c) for c in zip((key, doc, first, last, one, two), (_keys(hashes, bits), runs[1][alone][run], at, at, hashes, hashes), strict=True))
            rank = chunk.ids[doc]
            # of runs of the same bytes the least document's is sent; larger ones are covered
            whole = _whole_run(one, two, last - first)
            order = np.lexsort((rank, whole))
            new = np.concatenate([[True], whole[order][1:] != whole[order][:-1]])
            lead = np.zeros(len(order), np.int64)
            lead[order] = np.repeat(order[new], np.diff(np.concatenate([np.flatnonzero(new), [len(order)]])))
            larger = rank > rank[lead]
            larger[larger] = _equal_runs(data, first[larger], first[lead[larger]], last[larger] - first[larger] + length, last[lead[larger]] - first[lead[larger]] + length)
            if larger.any():
                found.append((-1 - number, *_intervals(number, first[larger], last[larger] + length), None))
            own = np.flatnonzero(~larger)
            own = own[np.argsort(key[own], kind="stable")]
            sizes = last[own] - first[own] + length
            sent = Runs(np.stack([rank[own], first[own], np.full(len(own), number), key[own]], 1), sizes, _cut(data, first[own], sizes))
            found += [(bucket, number, *sent.packed(slice(low, high), columns)) for bucket, low, high in parts(_bucket_of(key[own], bits, route.steps[0]))]
        return pa.table({"bucket": pa.array([f[0] for f in found], pa.int64()), "source": pa.array([f[1] for f in found], pa.int64()), "places": pa.array([f[2] for f in found], pa.binary()), "text": pa.array([f[3] for f in found], pa.binary())})

    def join_runs(step: int):
        def join(group: pa.Table) -> pa.Table:
            held, _ = Runs.unpacked(group, columns)
            bucket = _bucket_of(held.places[:, 3], bits, route.steps[step])
            order = np.argsort(bucket, kind="stable")
            found = [(b, *held.packed(order[low:high], columns)) for b, low, high in parts(bucket[order])]
            return pa.table({"bucket": pa.array([f[0] for f in found], pa.int64()), "source": pa.array([group.column("next")[0].as_py()] * len(found), pa.int64()), "places": pa.array([f[1] for f in found], pa.binary()), "text": pa.array([f[2] for f in found], pa.binary())})

        return join

    def match_runs(group: pa.Table) -> pa.Table:
        if group.column("bucket")[0].as_py() < 0:  # what a chunk has decided itself
            return pa.table({"bucket": group.column("bucket"), "source": group.column("source"), "spans": group.column("places")})
        held, row = Runs.unpacked(group, columns)
        numbers = group.column("source").to_numpy()
        chunk = held.places[:, 2] if steps > 1 else numbers[row]
        windows = held.sizes - length + 1
        begin = held.edges[:-1]
        turn = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        gone = covered(held.text, np.repeat(begin, windows) + turn, np.repeat(held.places[:, 0], windows), length)
        run = np.repeat(np.arange(len(windows)), windows)[gone]
        at = held.places[run, 1] + turn[gone]
        out = []
        if len(at):
            new = np.concatenate([[True], (run[1:] != run[:-1]) | (at[1:] != at[:-1] + 1)])
            a = np.flatnonzero(new)
            b = np.concatenate([a[1:], [len(at)]]) - 1
            out = _by_source(chunk[run[a]], at[a], at[b] + length, numbers[row[run[a]]])
        return pa.table({"bucket": pa.array([group.column("bucket")[0].as_py()] * len(out), pa.int64()), "source": pa.array([s for s, _ in out], pa.int64()), "spans": pa.array([s for _, s in out], pa.binary())})

    def _by_source(chunk: np.ndarray, starts: np.ndarray, ends: np.ndarray, source: np.ndarray) -> list[tuple[int, bytes]]:
        """Spans for each source; with their chunks, where a source is several."""
        out = []
        order = np.argsort(source, kind="stable")
        for number, low, high in parts(source[order]):
            mine = order[low:high]
            rows = [starts[mine], ends[mine]] if steps == 1 else [starts[mine], ends[mine], chunk[mine]]
            out.append((number, zstandard.compress(np.stack(rows).astype(np.int64).tobytes(), 1)))
        return out

    def split_spans(step: int):
        """Spans of joint sources to those of the step before; to chunks at last."""

        def split(group: pa.Table) -> pa.Table:
            held = np.concatenate([np.frombuffer(zstandard.decompress(x), np.int64).reshape(3, -1) for x in group.column("spans").to_pylist()], axis=1)
            source = held[2] if step == 0 else regions_of(held[2], route.joint[step])
            if step == 0:
                order = np.argsort(source, kind="stable")
                out = [_intervals(number, held[0][order[low:high]], held[1][order[low:high]]) for number, low, high in parts(source[order])]
            else:
                out = _by_source(held[2], held[0], held[1], source)
            return pa.table({"bucket": pa.array([group.column("parent")[0].as_py()] * len(out), pa.int64()), "source": pa.array([s for s, _ in out], pa.int64()), "spans": pa.array([s for _, s in out], pa.binary())})

        return split

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        spans = [np.frombuffer(zstandard.decompress(b), np.int64).reshape(2, -1) for b in right.column("spans").to_pylist()]
        rows: list[tuple] = []
        for blob in left.column("blob").to_pylist():
            chunk = Chunk.unpack(blob)
            change = np.zeros(len(chunk.data) + 1, np.int32)
            for s in spans:
                np.add.at(change, s[0], 1)
                np.add.at(change, s[1], -1)
            gone = np.cumsum(change[:-1], dtype=np.int32) > 0
            data = np.frombuffer(chunk.data, np.uint8)
            for i, a, n in zip(range(len(chunk.ids)), chunk.starts.tolist(), chunk.sizes.tolist(), strict=True):
                mine = gone[a : a + n]
                removed = int(mine.sum())
                kept = data[a : a + n][~mine].tobytes() if removed else chunk.data[a : a + n]
                count = int(mine[:1].sum() + (mine[1:] & ~mine[:-1]).sum()) if removed else 0
                rows.append((int(chunk.ids[i]) if chunk.known[i] else None, n, removed, count, hashlib.sha256(kept).hexdigest(), *([kept] if keep_bytes else [])))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * keep_bytes]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_bytes]
        return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(zip(names, kinds, strict=True))})

    messages, answers = "bucket long, source long, places binary, text binary", "bucket long, source long, spans binary"
    asked = ways.up(chunks.mapInArrow(send_keys, KEYS))
    replies = ways.down(asked, asked[-1].groupBy("bucket").applyInArrow(match_keys, ANSWERS), np.uint8)
    runs = chunks.groupBy("chunk").cogroup(replies.groupBy("source")).applyInArrow(send_runs, messages)
    if steps > 1:
        runs = written(runs)
        own = runs.where("bucket < 0").select("bucket", "source", F.col("places").alias("spans"))
        runs = runs.where("bucket >= 0")
        for step in range(1, steps):
            runs = runs.withColumn("next", route.next_source(step - 1)).groupBy("bucket", "next").applyInArrow(join_runs(step), messages)
    spans = runs.groupBy("bucket").applyInArrow(match_runs, answers)
    if steps > 1:
        for step in reversed(range(steps - 1)):
            grouped = spans.withColumn("parent", F.shiftright("bucket", route.steps[step + 1] - route.steps[step])).groupBy("parent", "source")
            spans = grouped.applyInArrow(split_spans(step), answers)
        spans = spans.unionByName(own)
    spans = checkpointed(spans.select(F.col("source").alias("chunk"), "spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    return chunks.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(finish, schema)
