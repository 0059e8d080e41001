"""Bounded-space online packing of tokenised documents into windows."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8, written
from .token_ids import TokenIds

#: A piece: doc_id, start, length, ids (little-endian unsigned 32-bit), tokens of its document.
Piece = tuple[int | None, int, int, bytes, int]

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())]

_encoders: dict[str, TokenIds] = {}


def ids_of(path: str) -> TokenIds:
    """The encoder of a vocabulary file, one for each Python process."""
    if path not in _encoders:
        _encoders[path] = TokenIds(path)
    return _encoders[path]


class Packer:
    """At most ``open_windows`` windows stay open; a piece goes where it fits best.

    If it fits nowhere and no more window may be opened, the fullest window is
    emitted. A gap there of at least ``least_cut`` tokens is filled first, with
    the head of the piece; a smaller one becomes padding.
    """

    def __init__(self, window: int, open_windows: int, least_cut: int):
        self.window, self.most, self.least_cut = window, open_windows, least_cut
        self.gaps: list[tuple[int, int]] = []  # (gap, number), ascending
        self.held: dict[int, list[Piece]] = {}
        self.number = 0

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Place a piece of at most a window; gives windows that are emitted."""
        doc_id, start, length, ids, tokens = piece
        at = bisect_left(self.gaps, (length, -1))
        if at < len(self.gaps):
            gap, k = self.gaps.pop(at)
            self.held[k].append(piece)
            if gap == length:
                yield self.held.pop(k)
            else:
                insort(self.gaps, (gap - length, k))
            return
        if length == self.window:
            yield [piece]
            return
        if len(self.gaps) >= self.most:
            gap, k = self.gaps.pop(0)
            if gap >= self.least_cut:
                self.held[k].append((doc_id, start, gap, ids[: 4 * gap], tokens))
                yield self.held.pop(k)
                yield from self.add((doc_id, start + gap, length - gap, ids[4 * gap :], tokens))
                return
            yield self.held.pop(k)
        self.number += 1
        self.held[self.number] = [piece]
        insort(self.gaps, (self.window - length, self.number))

    def rest(self) -> Iterator[list[Piece]]:
        """The windows still open, the fullest first."""
        for _, k in self.gaps:
            yield self.held[k]
        self.gaps, self.held = [], {}


class _Out:
    """Rows of emitted windows, gathered into record batches."""

    def __init__(self, first: int):
        self.sequence, self.rows, self.bytes = first, [], 0

    def put(self, window: list[Piece], is_open: bool = False) -> None:
        offset = 0
        for doc_id, start, length, ids, tokens in window:
            self.rows.append((doc_id, start, length, ids, tokens, self.sequence, offset, is_open))
            offset += length
        self.bytes += 4 * offset
        self.sequence += 1

    def batch(self) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, (_, t) in zip(zip(*self.rows, strict=True), _FIELDS, strict=True)]
        self.rows, self.bytes = [], 0
        return pa.RecordBatch.from_arrays(columns, [n for n, _ in _FIELDS])


def pack(docs: DataFrame, vocabulary: str, window: int = 1024, end_id: int = 0, open_windows: int = 64, least_cut: int = 8, merge_windows: int = 8192) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens.

    Each text is encoded by the tokenizers library without added special tokens
    and ends with ``end_id``. Whole windows of a document are sequences by
    themselves; its remainder is placed by a :class:`Packer`, one for each input
    partition. The windows that are open when a partition ends are merged: one
    task for every ``merge_windows`` of them packs their pieces again.

    Returns a row per piece: doc_id, start (ids of the document before it),
    length, ids (binary, little-endian unsigned 32-bit), doc_tokens (with the end
    id), sequence_id, offset. A sequence that is shorter than the window is to be
    padded by the reader.

    Null and empty texts hold the end id alone. Null ids and repeated rows are
    packed as they come; other columns are left out. An empty table gives an
    empty one. No text is shuffled; a task holds one Arrow batch and
    ``open_windows`` windows.
    """

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_of(vocabulary).of_batch
        end = np.array([end_id], "<u4").tobytes()
        packer, out = Packer(window, open_windows, least_cut), _Out(TaskContext.get().partitionId() << 32)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for low in range(0, len(doc_ids), 256):  # few long texts at once
                texts = batch.column(1).slice(low, 256).to_pylist()
                for doc_id, found in zip(doc_ids[low : low + 256], encode(texts), strict=True):
                    ids = found.astype("<u4").tobytes() + end
                    tokens = len(ids) // 4
                    for start in range(0, tokens, window):
                        length = min(window, tokens - start)
                        for full in packer.add((doc_id, start, length, ids[4 * start : 4 * (start + length)], tokens)):
                            out.put(full)
                    if out.bytes > 4_000_000:
                        yield out.batch()
        for still in packer.rest():
            out.put(still, True)
        if out.rows:
            yield out.batch()

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one open window is filled after another, so that a task pads one sequence at most
        packer, out = Packer(window, 1, 1), _Out(1 << 62 | TaskContext.get().partitionId() << 32)
        for batch in batches:
            for piece in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                for full in packer.add(piece):
                    out.put(full)
            if out.bytes > 4_000_000:
                yield out.batch()
        for still in packer.rest():
            out.put(still)
        if out.rows:
            yield out.batch()

    made = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("data")).mapInArrow(first, PIECES + ", open boolean"))
    still_open = made.where("open")
    tasks = 1 + still_open.select("sequence_id").distinct().count() // merge_windows
    merged = still_open.repartition(tasks, F.col("sequence_id")).sortWithinPartitions("sequence_id", "offset").mapInArrow(merge, PIECES + ", open boolean")
    return made.where("not open").unionByName(merged).drop("open")
