"""Exchanges between many sources and many buckets, with rows that stay few and large.

If each of n sources sent a row to each of n buckets, rows would grow with the
square of the text. So a step tells only ``fan`` bits of the buckets apart, and
before the next step as many sources are put together to one as there are ways
apart. Rows are then sources times 2 ** fan in every step, whatever the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import restored, squeezed
from .common import checkpointed

#: Rows of keys: the bucket by the bits known so far, who sends, the keys and a number for each.
KEYS = "bucket long, source long, keys binary, values binary"
ANSWERS = "bucket long, source long, values binary"

BucketOf = Callable[[np.ndarray, int], np.ndarray]
#: Numbers of equal keys put together: values in order of keys, where each key's begin, how many each has.
Add = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def regions_of(numbers: np.ndarray, bits: int) -> np.ndarray:
    """So many first bits of a hash of each number, as :func:`region` has them."""
    known, place = np.unique(numbers, return_inverse=True)
    if not bits:
        return np.zeros(len(numbers), np.int64)
    return np.array([xxhash.xxh64_intdigest(int(n).to_bytes(8, "little", signed=True), seed=42) >> (64 - bits) for n in known.tolist()], np.int64)[place]


def region(number: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(number.cast("long")), 64 - bits) if bits else F.lit(0).cast("long")


class Route:
    """The steps from ``sources`` to buckets of ``bits`` bits.

    ``steps[i]`` is the number of a bucket's bits that step i knows, and
    ``joint[i]`` the bits that name a joint source of step i (none for step 0,
    whose sources go by their numbers).
    """

    def __init__(self, bits: int, sources: int, fan: int):
        self.steps = [min(bits, fan * (i + 1)) for i in range(max(1, -(-bits // fan)))]
        together = (max(1, sources) - 1).bit_length()
        self.joint = [64, *(max(0, together - fan * (i + 1)) for i in range(len(self.steps) - 1))]

    def next_source(self, step: int) -> Column:
        """Who has what a row's source sent, in the step after ``step``."""
        own = F.col("source")
        return region(own, self.joint[1]) if step == 0 else F.shiftright(own, self.joint[step] - self.joint[step + 1])


def parts(places: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of equal places: place, start, end."""
    there, starts = np.unique(places, return_index=True)  # places ascend
    yield from zip(there.tolist(), starts.tolist(), [*starts[1:].tolist(), len(places)], strict=True)


class KeyExchange:
    """Distinct keys with numbers go from sources to buckets, and an answer for each key comes back.

    ``bucket_of(keys, bits)`` are a bucket's first bits, ``add`` puts the numbers
    of equal keys together.
    """

    def __init__(self, route: Route, bits: int, bucket_of: BucketOf, add: Add):
        self.route, self.bits, self.bucket_of, self.add = route, bits, bucket_of, add

    def order(self, keys: np.ndarray) -> np.ndarray:
        """Keys are sent by bucket and key."""
        return np.lexsort((keys, self.bucket_of(keys, self.bits)))

    def rows(self, keys: np.ndarray, values: np.ndarray, step: int = 0) -> list[tuple[int, bytes, bytes]]:
        """Bucket, keys and values of each row that ordered keys make in a step."""
        cuts = parts(self.bucket_of(keys, self.route.steps[step]))
        return [(b, squeezed(np.diff(keys[low:high], prepend=0)), squeezed(values[low:high].astype(np.int64))) for b, low, high in cuts]

    def opened(self, group: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
        """Sizes of the rows; distinct keys, ordered, with their numbers; for all rows' keys in turn their place among these."""
        rows = [np.cumsum(restored(x, np.int64)) for x in group.column("keys").to_pylist()]
        values = np.concatenate([restored(x, np.int64) for x in group.column("values").to_pylist()])
        keys = np.concatenate(rows)
        turn = np.argsort(keys, kind="stable")
        keys = keys[turn]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        keys, totals = keys[starts], self.add(values[turn], starts, sizes)
        back = np.arange(len(keys))
        bucket = self.bucket_of(keys, self.bits)
        if (bucket[1:] < bucket[:-1]).any():
            order = np.lexsort((keys, bucket))
            back[order] = np.arange(len(order))
            keys, totals = keys[order], totals[order]
        place = np.empty(len(turn), np.int64)
        place[turn] = np.repeat(back, sizes)
        return [len(r) for r in rows], keys, totals, place

    @staticmethod
    def answers(group: pa.Table, sizes: list[int], values: np.ndarray) -> dict[str, pa.Array]:
        """Rows of answers to a group's rows, from one value for each of their keys in turn."""
        ends = np.cumsum(sizes)
        return {"bucket": group.column("bucket"), "source": group.column("source"), "values": pa.array([squeezed(values[e - n : e]) for n, e in zip(sizes, ends.tolist(), strict=True)], pa.binary())}

    def up(self, sent: DataFrame) -> list[DataFrame]:
        """The rows of every step; those of the last one are to be answered."""
        levels = [sent]

        def joined(step: int) -> Callable[[pa.Table], pa.Table]:
            def join(group: pa.Table) -> pa.Table:
                _, keys, totals, _ = self.opened(group)
                found = self.rows(keys, totals, step)
                columns = [pa.array([f[0] for f in found], pa.int64()), pa.array([group.column("next")[0].as_py()] * len(found), pa.int64()), *(pa.array([f[i] for f in found], pa.binary()) for i in (1, 2))]
                return pa.Table.from_arrays(columns, ["bucket", "source", "keys", "values"])

            return join

        for step in range(1, len(self.route.steps)):
            grouped = levels[-1].withColumn("next", self.route.next_source(step - 1)).groupBy("bucket", "next")
            levels.append(checkpointed(grouped.applyInArrow(joined(step), KEYS)))
        return levels

    def down(self, levels: list[DataFrame], answers: DataFrame, kind: type) -> DataFrame:
        """Answers (bucket, source, values) to the last step's rows, as answers to those of the first."""
        for step in reversed(range(len(levels) - 1)):

            def split(left: pa.Table, right: pa.Table) -> pa.Table:
                sizes, keys, _, place = self.opened(left)
                turn = np.argsort(right.column("bucket").to_numpy(), kind="stable")
                blobs = right.column("values").to_pylist()
                values = np.concatenate([restored(blobs[i], kind) for i in turn])
                if len(values) != len(keys):
                    raise RuntimeError("keys and their answers differ")
                return pa.table(self.answers(left, sizes, values[place]))

            asked = levels[step].withColumn("next", self.route.next_source(step)).groupBy("bucket", "next")
            known = answers.withColumn("parent", F.shiftright("bucket", self.route.steps[step + 1] - self.route.steps[step])).groupBy("parent", "source")
            answers = asked.cogroup(known).applyInArrow(split, ANSWERS)
        return answers

    def back(self, keys: np.ndarray, reply: dict[int, bytes], kind: type) -> np.ndarray:
        """What a source was answered, in its own order of keys."""
        order = self.order(keys)
        out = np.zeros(len(keys), kind)
        for bucket, low, high in parts(self.bucket_of(keys[order], self.route.steps[0])):
            out[order[low:high]] = restored(reply[bucket], kind)
        return out


__all__ = ["ANSWERS", "KEYS", "KeyExchange", "Route", "parts", "region", "regions_of"]
