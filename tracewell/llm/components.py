"""Connected components, and the dealing of candidate groups to tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, written


def components(links: DataFrame) -> DataFrame:
    """The least node that each linked node reaches.

    ``links`` has long columns a and b, in any order, repeated or not. Every
    round points a node's larger neighbours at its least one, then its smaller
    ones, which keeps components and ends in stars after few rounds. Only minima
    are gathered for a node, so a node with many links is no large group.

    Returns node, root; nodes without links to others are absent.
    """
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(down, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = checkpointed(small.unionByName(down.select("a", F.col("least").alias("b"))).distinct())


def dealt(rows: DataFrame, most: int, sizes: DataFrame | None = None) -> DataFrame:
    """Rows of equal ``key`` brought together in tasks of about 2 x ``most`` rows at most.

    A key of more than ``most`` rows is cut into parts by a hash of ``id``, and
    every two parts (and each alone) make a task, so that each pair of rows meets
    once whatever the key's size. Adds key_a, key_b (the parts of the task, equal
    if it is one) and part; sorted by key, key_a, key_b within partitions.

    ``sizes`` (key, n) spares computing ``rows`` twice. The large keys are written,
    so that Spark knows their size when it chooses how to join them.
    """
    large = (sizes or rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))).where(F.col("n") > most).select("key", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    large = written(large)
    parts = F.coalesce(F.col("parts"), F.lit(1))
    own = rows.join(large, "key", "left").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    tasks = met.withColumns({"key_a": F.least("part", "other"), "key_b": F.greatest("part", "other")}).drop("other", "parts")
    return tasks.repartition("key", "key_a", "key_b").sortWithinPartitions("key", "key_a", "key_b")


def whole_groups(batches: Iterable[pa.RecordBatch], keys: int, least: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of whole groups of at least ``least`` rows, and each row's group start flag.

    A group is a run of rows with the same values in the first ``keys`` columns.
    """

    def starts(t: pa.Table) -> np.ndarray:
        out = np.zeros(t.num_rows, bool)
        out[:1] = True
        for i in range(keys):
            v = t.column(i).to_numpy()
            out[1:] |= v[1:] != v[:-1]
        return out

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        while rows >= least:
            t = pa.Table.from_batches(held)
            first = starts(t)
            cuts = np.flatnonzero(first)
            if len(cuts) < 2:
                least_now = rows + 1
            else:
                cut = int(cuts[min(np.searchsorted(cuts, least), len(cuts) - 1)])
                yield t.slice(0, cut), first[:cut]
                rest = t.slice(cut)
                held, rows = rest.to_batches(), rest.num_rows
                least_now = least
            if rows < least_now:
                break
    if rows:
        t = pa.Table.from_batches(held)
        yield t, starts(t)


class Union:
    """Union of positions 0..n-1 with roots at the least one, by arrays of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            low, high = np.minimum(ra, rb)[apart], np.maximum(ra, rb)[apart]
            np.minimum.at(root, high, low)
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up
