"""Documents put together in chunks, one compressed row each, that are written once.

A chunk that is read again, by whatever task, holds the same documents, so what
other tasks reply to it needs no keys of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8, written

#: Stands for a null id, after all others.
LAST = (1 << 63) - 1
_BLOCK = 150_000


class Chunk:
    """Some whole documents: ids, sizes and their bytes in one row."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, data: bytes):
        self.ids, self.known, self.sizes, self.data = ids, known, sizes, data
        self.starts = np.cumsum(sizes) - sizes

    def pack(self) -> bytes:
        head = np.array([len(self.ids)], np.int64).tobytes()
        return zstandard.compress(head + self.ids.tobytes() + self.known.tobytes() + self.sizes.tobytes() + self.data, 3)

    @classmethod
    def unpack(cls, blob: bytes) -> Chunk:
        raw = zstandard.decompress(blob)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        ids, known, sizes = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, bool, n, 8 + 8 * n), np.frombuffer(raw, np.int64, n, 8 + 9 * n)
        return cls(ids, known, sizes, raw[8 + 17 * n :])

    def blocks(self) -> Iterator[tuple[int, int]]:
        """First and end document of runs of some ``_BLOCK`` bytes."""
        low, size = 0, 0
        for i, n in enumerate(self.sizes.tolist()):
            if size and size + n > _BLOCK:
                yield low, i
                low, size = i, 0
            size += n
        if low < len(self.sizes):
            yield low, len(self.sizes)

    def texts(self) -> Iterator[bytes]:
        for a, n in zip(self.starts.tolist(), self.sizes.tolist(), strict=True):
            yield self.data[a : a + n]

    def doc_ids(self) -> list[int | None]:
        return [i if k else None for i, k in zip(self.ids.tolist(), self.known.tolist(), strict=True)]


def chunked(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Chunks of some ``chunk_bytes`` as a written table: chunk (a number), blob."""

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        texts: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            chunk = Chunk(np.array([LAST if i is None else i for i in ids], np.int64), np.array([i is not None for i in ids], bool), np.array([len(t) for t in texts], np.int64), b"".join(texts))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([chunk.pack()], pa.binary())], ["chunk", "blob"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if size >= chunk_bytes or len(ids) >= 1_000_000:
                    yield row()
                    number += 1
                    ids, texts, size = [], [], 0
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("data"))
    return written(rows.mapInArrow(gather, "chunk long, blob binary"))


def squeezed(values: np.ndarray) -> bytes:
    """An array compressed byte by byte of its items."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return zstandard.compress(raw.T.tobytes(), 1)


def restored(blob: bytes, kind: np.dtype) -> np.ndarray:
    kind = np.dtype(kind)
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()
