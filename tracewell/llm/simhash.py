"""SimHash fingerprints and bit-sliced search for those within a radius."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, unused, utf8
from .components import Union, components, dealt, whole_groups

BITS = 64


def fingerprint(data: bytes, words_per_shingle: int = 4, seed: int = 42) -> int:
    """Bits set in more than half of the shingles' hashes; 0 without words."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - words_per_shingle + 1)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[words_per_shingle - 1 :] or ends[-1:]
    hashed = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for low in range(0, n, 4096):
        h = np.array([hashed(joined[a:b], seed) for a, b in zip(starts[low : min(low + 4096, n)], last[low : low + 4096], strict=False)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number, for each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("data")).mapInArrow(run, "doc_id long, fp long")


def bands_for(rows: int, radius: int) -> int:
    """Bands so that keys of all but ``radius`` of them have about as many values as there are rows."""
    bands = radius + 2
    while bands < 2 * radius and BITS * (bands - radius) / bands + 4 < np.log2(max(rows, 2)):
        bands += 1
    return bands


def band_keys(fp: Column, radius: int, bands: int) -> Column:
    """Keys of which fingerprints within ``radius`` share one at least: they differ in ``radius`` bands at most."""
    edges = [BITS * i // bands for i in range(bands + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    keys = []
    for n, chosen in enumerate(combinations(masks, bands - radius)):
        mask = sum(chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(n).alias("n"), fp.bitwiseAND(F.lit(signed).cast("long")).alias("v")))
    return F.array(*keys)


def near_links(fps: np.ndarray, starts: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs within ``radius`` bits in runs of rows that ``starts`` flags.

    Plane k is one long integer with bit k of every row. Shifting the planes by s
    compares each row with the one s further on, all rows at once: two planes of
    differences at a time go through a carry-save adder into bitwise counters.
    A shift is abandoned when no pair of the same run is still within the radius.
    """
    n = len(fps)
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    planes = [int.from_bytes(np.packbits(bits[:, k], bitorder="little").tobytes(), "little") for k in range(BITS)]
    adjacent = int.from_bytes(np.packbits(~starts[1:], bitorder="little").tobytes(), "little")
    width = max(1, radius.bit_length())
    active, shift = adjacent, 1
    while active:
        low, within = 0, active
        upper = [0] * width
        for k in range(0, BITS, 2):
            x, y = planes[k] ^ (planes[k] >> shift), planes[k + 1] ^ (planes[k + 1] >> shift)
            carry, low = (low & x) | (low & y) | (x & y), low ^ x ^ y
            for i in range(1, width):
                upper[i], carry = upper[i] ^ carry, upper[i] & carry
            within &= ~carry  # ran over the counters
            if k % 8 == 6:
                within &= ~_above([low, *upper[1:]], radius)
                if not within:
                    break
        if within:
            at = np.flatnonzero(np.unpackbits(np.frombuffer(within.to_bytes(-(-n // 8), "little"), np.uint8), bitorder="little"))
            yield at, at + shift
        active &= adjacent >> shift
        shift += 1


def _above(counter: list[int], radius: int) -> int:
    """Where the number of these bits, least first, is above ``radius``."""
    above, equal = 0, -1
    for i in reversed(range(len(counter))):
        if radius >> i & 1:
            equal &= counter[i]
        else:
            above |= equal & counter[i]
            equal &= ~counter[i]
    return above


def simhash_groups(docs: DataFrame, radius: int = 4, most: int = 4096) -> DataFrame:
    """Fingerprints, and the components of documents within ``radius`` bits.

    Returns, per row of ``docs``: doc_id, fp (signed 64-bit), component_id (the
    least doc_id reachable by links, itself included).

    Texts are read as UTF-8 with A-Z lowered; null, empty and blank ones have
    fingerprint 0 and link with each other like any others. Null ids come after
    all others in components. Repeated rows stay. Other columns are left out.
    An empty table gives an empty one.

    Equal fingerprints are one node. Nodes that share a key (all but ``radius``
    of some bands) are compared in tasks that :func:`~.components.dealt` bounds,
    and a task gives links from each node to one other only.
    """
    prints = checkpointed(fingerprints(docs))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    bands = bands_for(nodes.count(), radius)
    rows = nodes.select(F.col("fp").alias("id"), F.explode(band_keys(F.col("fp"), radius, bands)).alias("k")).select(F.xxhash64("k.n", "k.v").alias("key"), "id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, 3, 8192):
            ids = t.column(3).to_numpy()
            fps = np.ascontiguousarray(ids).view(np.uint64)
            union = Union(len(ids))
            for a, b in near_links(fps, starts, radius):
                apart = union.root[a] != union.root[b]
                if apart.any():
                    union.add(a[apart], b[apart])
            at = np.flatnonzero(union.root != np.arange(len(ids)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[union.root[at]])], ["a", "b"])

    links = dealt(rows, most).select("key", "key_a", "key_b", "id").mapInArrow(run, "a long, b long")
    reached = components(links)
    roots = nodes.join(reached, nodes["fp"] == reached["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(roots.select("fp", "root").join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, radius: int = 4) -> DataFrame:
    """``docs``, all columns, with the document of least id of each component.

    Rows of one id stay or go together; of null ids those stay that link with no
    other id.
    """
    key = unused(docs, "kept_id")
    groups = simhash_groups(docs, radius).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(key))
    return docs.join(groups.distinct(), F.col("doc_id").cast("long").eqNullSafe(F.col(key)), "left_semi")
