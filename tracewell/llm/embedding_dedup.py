"""Near-duplicate embeddings by randomised-rotation binary codes."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .components import Union, components, dealt, whole_groups

#: What a vector sends with each key: see :func:`_sent`.
_ROWS = "key long, id long, times long, turn int, sent binary"
#: Steps of a component of a rotated vector, as it is sent, on either side of zero.
STEPS = 127


@lru_cache(16)
def rotation(dims: int, number: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dims, number]).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def codes(vectors: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits of rotated unit vectors, packed, and the correction factors.

    The factor is the inner product of a vector with its code, seen as a unit
    vector of equal magnitudes. Dividing a code's inner product with another
    vector by it gives an unbiased estimate of the two vectors' cosine.
    """
    turned = vectors @ rotation(vectors.shape[1], 0, seed)
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / math.sqrt(vectors.shape[1])


def quantised(vectors: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rotated unit vectors in whole steps of their largest component, and the steps' sizes."""
    turned = vectors @ rotation(vectors.shape[1], 0, seed)
    step = np.abs(turned).max(1) / STEPS
    return np.rint(turned / step[:, None]).astype(np.int8), step.astype(np.float32)


def estimates(code: np.ndarray, factor: np.ndarray, turned: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Estimated cosines of coded vectors (rows) with quantised ones (columns)."""
    dims = turned.shape[1]
    signs = np.unpackbits(code, axis=1, count=dims).astype(np.float32) * 2 - 1
    return (signs @ turned.astype(np.float32).T) * step / (factor[:, None] * math.sqrt(dims)).astype(np.float32)


def least_estimate(factor: np.ndarray, step: np.ndarray, dims: int, threshold: float, deviations: float) -> np.ndarray:
    """Below this an estimate's upper confidence bound is under ``threshold``, for each code and the largest step.

    The error is sqrt(1 - f^2) / f * sqrt(1 - c^2) * u with u the component of a
    random direction, of deviation 1 / sqrt(dims - 1) and never above 1. Rounding
    to steps adds half a step times sqrt(dims) / f at most.
    """
    u = min(1.0, deviations / math.sqrt(max(dims - 1, 1)))
    return threshold - np.sqrt(np.maximum(0, 1 - factor**2)) / factor * math.sqrt(1 - threshold**2) * u - step.max(initial=0) * math.sqrt(dims) / 2 / factor - 1e-5


def nearest_possible(turned: np.ndarray, step: np.ndarray, others: np.ndarray, other_step: np.ndarray) -> np.ndarray:
    """The largest cosines that vectors rounded to steps can have.

    Each differs from its rounded form by a vector of at most half a step times
    sqrt(dims), and both are unit vectors.
    """
    dims = turned.shape[1]
    a, b = turned.astype(np.float32) * step[:, None], others.astype(np.float32) * other_step[:, None]
    off, other_off = step * math.sqrt(dims) / 2, other_step * math.sqrt(dims) / 2
    return a @ b.T + off[:, None] + other_off + off[:, None] * other_off + 1e-5


def plan(rows: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits of a key, and how many keys leave a pair at the threshold without one in common with chance ``miss``.

    A key's bits grow with the logarithm of the rows, so that a key has some 1024
    rows at any size.
    """
    bits = max(6, math.ceil(math.log2(max(rows, 1) / 1024)))
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-together))


def embedding_groups(vectors: DataFrame, threshold: float = 0.95, miss: float = 1e-6, deviations: float = 6.0, seed: int = 11, most: int = 2048) -> DataFrame:
    """Links between vectors of cosine ``threshold`` or more, and their components.

    ``vectors`` has vec_id and embedding (an array of floats or doubles). Returns,
    per row: vec_id, n_links (other rows linked directly), component_id (least
    vec_id reachable, itself included), kept (whether it is that one).

    Null, empty and zero vectors and those with null or non-finite components link
    with nothing; vectors of different lengths don't link. Null ids come after all
    others in components; a component of null ids alone has a null id, and its
    rows are kept. Repeated ids are rows of their own. Other columns are left out.
    An empty table gives an empty one.

    Equal vectors are one node with a weight. Nodes get keys of sign bits under
    several rotations and meet in the tasks of :func:`~.components.dealt`, each
    with its code, factor and rotated components of a byte. There the estimate
    from code and factor leaves out pairs whose upper bound is below the
    threshold, and then the bytes do. Tasks return the rows that have a pair left
    in the first key that the two share; only these get their vectors, meet again
    and are compared exactly, in double precision. Tasks return sums and one link
    per node, no pairs. A pair at the threshold shares no key with chance
    ``miss``, one of higher cosine with less.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    nodes = own.where(fine).groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("times"))
    nodes = checkpointed(nodes.withColumn("id", F.monotonically_increasing_id()))
    bits, n_keys = plan(nodes.count(), threshold, miss)

    small = np.dtype(np.min_scalar_type((1 << bits) - 1))

    def signed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each batch and length: the rows, their unit vectors, key bits, and keys with the length and the key's number above the bits."""
        for whole in batches:
            for low in range(0, whole.num_rows, 1000):
                batch = whole.slice(low, 1000)
                for at, v in _units(batch.column(2)):
                    dims = v.shape[1]
                    signs = np.concatenate([v @ rotation(dims, 1 + i, seed) > 0 for i in range(-(-bits * n_keys // dims))], axis=1)[:, : bits * n_keys]
                    keys = signs.reshape(len(at), n_keys, bits) @ (1 << np.arange(bits, dtype=np.int64))
                    yield batch, at, v, keys.astype(small), keys + ((dims * n_keys + np.arange(n_keys)) << bits)

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, v, keys, full in signed(batches):
            code, factor = codes(v, seed)
            turned, step = quantised(v, seed)
            own = np.concatenate([x.reshape(len(at), -1).view(np.uint8) for x in (code, factor.astype(np.float32), step, turned, keys)], axis=1)
            head = own.shape[1] - n_keys * small.itemsize
            sent = [own[i, : head + turn * small.itemsize].tobytes() for i in range(len(at)) for turn in range(n_keys)]
            rows = pa.array(np.repeat(at, n_keys))
            turns = np.tile(np.arange(n_keys, dtype=np.int32), len(at))
            yield pa.RecordBatch.from_arrays([pa.array(full.ravel()), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(turns), pa.array(sent, pa.binary())], ["key", "id", "times", "turn", "sent"])

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, full in signed(batches):
            keys, n = np.unique(full, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

    def grouped(batches: Iterable[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, 3, 512):
            cuts = [*np.flatnonzero(starts).tolist(), t.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a > 1 and (found := work(t.slice(a, b - a))):
                    yield found

    def likely(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from grouped(batches, lambda t: _likely(t, small, threshold, deviations))

    def linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from grouped(batches, lambda t: _compare(t, small, threshold))

    own_keys = nodes.select("id", "times", "embedding")
    sizes = own_keys.mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    met = dealt(own_keys.mapInArrow(keyed, _ROWS), most, sizes).select("key", "key_a", "key_b", "part", "id", "times", "turn", "sent")
    left = met.mapInArrow(likely, "key long, key_a int, key_b int, part int, id long, times long, turn int, earlier binary")
    again = left.join(nodes.select("id", "embedding"), "id").repartition("key", "key_a", "key_b").sortWithinPartitions("key", "key_a", "key_b")
    links = checkpointed(again.select("key", "key_a", "key_b", "part", "id", "times", "turn", "earlier", "embedding").mapInArrow(linked, "id long, links long, peer long"))
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    reached = components(links.select(F.col("id").alias("a"), F.col("peer").alias("b")))
    roots = nodes.select("id", "least").join(reached, nodes["id"] == reached["node"], "left").select("id", "least", F.coalesce("root", "id").alias("root"))
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    about = (
        nodes.select("id", "embedding", "times")
        .join(roots.select("id", "root").join(named, "root"), "id")
        .join(counts, "id", "left")
        .select(F.col("embedding").alias("known"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    )
    joined = own.join(about, own["embedding"] == about["known"], "left")
    root = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.col("vec_id").eqNullSafe(root).alias("kept"))


def _units(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of each length, and their unit vectors."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy().astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for dims in np.unique(sizes):
        at = np.flatnonzero(sizes == dims)
        v = flat[starts[at][:, None] + np.arange(dims)]
        v /= np.abs(v).max(1, keepdims=True)
        v /= np.sqrt((v * v).sum(1, keepdims=True))
        yield at, v


def _pairs(t: pa.Table, earlier: np.ndarray, near) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a task's rows for which ``near`` of a range of rows holds, those left out that share an earlier key or are a task's of their own."""
    n, part = t.num_rows, t.column("part").to_numpy()
    across = t.column("key_a")[0] != t.column("key_b")[0]
    for low in range(0, n, 512):
        i, j = np.nonzero(near(slice(low, min(low + 512, n))))
        i += low
        ahead = i < j
        if across:
            ahead &= part[i] != part[j]
        i, j = i[ahead], j[ahead]
        for k in range(0, len(i), 50_000):
            a, b = i[k : k + 50_000], j[k : k + 50_000]
            fresh = ~(earlier[a] == earlier[b]).any(1)
            yield a[fresh], b[fresh]


def _likely(t: pa.Table, small: np.dtype, threshold: float, deviations: float) -> pa.RecordBatch | None:
    """The rows of a task that may have a link in it."""
    n, turn = t.num_rows, t.column("turn")[0].as_py()
    raw = np.frombuffer(b"".join(t.column("sent").to_pylist()), np.uint8).reshape(n, -1)
    known = raw.shape[1] - turn * small.itemsize
    dims = next(d for d in range(1, known) if (d + 7) // 8 + 8 + d == known)
    cuts = np.cumsum([(dims + 7) // 8, 4, 4, dims])
    code, factor, step, turned, earlier = (np.ascontiguousarray(x) for x in np.split(raw, cuts, axis=1))
    factor, step, turned, earlier = factor.view(np.float32).ravel(), step.view(np.float32).ravel(), turned.view(np.int8), earlier.view(small) if turn else np.zeros((n, 0), small)
    least = least_estimate(factor.astype(np.float64), step, dims, threshold, deviations).astype(np.float32)

    def near(rows: slice) -> np.ndarray:
        out = estimates(code[rows], factor[rows], turned, step) >= least[rows, None]
        out &= estimates(code, factor, turned[rows], step[rows]).T >= least[None, :]
        return out & (nearest_possible(turned[rows], step[rows], turned, step) >= threshold)

    some = np.zeros(n, bool)
    for a, b in _pairs(t, earlier, near):
        some[a] = some[b] = True
    if not some.any():
        return None
    at = np.flatnonzero(some)
    columns = [t.column(c).combine_chunks().take(pa.array(at)) for c in ("key", "key_a", "key_b", "part", "id", "times", "turn")]
    return pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes() for x in earlier[at]], pa.binary())], ["key", "key_a", "key_b", "part", "id", "times", "turn", "earlier"])


def _compare(t: pa.Table, small: np.dtype, threshold: float) -> pa.RecordBatch | None:
    """Links of one task's rows: counts, and one peer for each linked row."""
    n = t.num_rows
    [(_, vectors)] = _units(t.column("embedding").combine_chunks())
    times, ids = t.column("times").to_numpy(), t.column("id").to_numpy()
    earlier = np.frombuffer(b"".join(t.column("earlier").to_pylist()), small).reshape(n, -1)
    counts, union = np.zeros(n, np.int64), Union(n)
    for a, b in _pairs(t, earlier, lambda rows: vectors[rows] @ vectors.T >= threshold - 1e-9):
        near = np.einsum("ij,ij->i", vectors[a], vectors[b]) >= threshold
        a, b = a[near], b[near]
        counts += np.bincount(a, times[b], n).astype(np.int64) + np.bincount(b, times[a], n).astype(np.int64)
        union.add(a, b)
    at = np.flatnonzero(counts)
    if not len(at):
        return None
    return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(counts[at]), pa.array(ids[union.root[at]])], ["id", "links", "peer"])
