"""Exact duplicates by deterministic naming of blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, unused, utf8, written

_BLOCKS = "row_id long, at int, n_blocks int, own long, local long, block binary, doc_id long, text_sha256 string"


def _blocks(docs: DataFrame, block_bytes: int, held_bytes: int) -> DataFrame:
    """Blocks of all texts; bytes only where the partition has not sent them yet.

    ``own`` numbers the block, ``local`` is the own number of the block that this
    partition sent for the same bytes.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        seen: dict[bytes, int] = {}
        held = 0
        schema = pa.schema([("row_id", pa.int64()), ("at", pa.int32()), ("n_blocks", pa.int32()), ("own", pa.int64()), ("local", pa.int64()), ("block", pa.binary()), ("doc_id", pa.int64()), ("text_sha256", pa.string())])
        for batch in batches:
            rows, size = [], 0
            for doc_id, data, digest in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                row_id, n = number, max(1, -(-len(data) // block_bytes))
                for at in range(n):
                    block = data[at * block_bytes : (at + 1) * block_bytes]
                    local = seen.get(block)
                    sent = None
                    if local is None:
                        if held > held_bytes:
                            seen.clear()
                            held = 0
                        seen[block] = local = number
                        held += len(block) + 100
                        sent = block
                    rows.append((row_id, at, n, number, local, sent, doc_id, digest if at == 0 else None))
                    number += 1
                    size += 60 + len(sent or b"")
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    data = utf8(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("data"), F.sha2(data, 256).alias("digest")).mapInArrow(run, _BLOCKS)


def identities(docs: DataFrame, block_bytes: int = 2048, held_bytes: int = 48_000_000) -> DataFrame:
    """A collision-free identity of every text: equal exactly for equal texts.

    Texts are cut into blocks of ``block_bytes``. Blocks are sorted and each gets
    an integer name, the least number of a block with its bytes. Then adjacent
    names are paired, and pairs named in the same way, until a text has one name;
    names are compared between texts of as many blocks.

    Returns row_id (a number of the row), doc_id, text_sha256, n_blocks, name.
    """
    blocks = written(_blocks(docs, block_bytes, held_bytes))
    # A partition sends each of its blocks once, so a common block has as many rows here as partitions.
    sent = blocks.where(F.col("block").isNotNull())
    names = sent.select(F.col("own").alias("local"), F.min("own").over(Window.partitionBy("block").orderBy("own")).alias("name"))
    level = blocks.select("row_id", "at", "n_blocks", "own", "local").join(names, "local").select("row_id", "at", F.col("n_blocks").alias("n"), "n_blocks", "own", "name")
    done = level.where("n = 1")
    longest = blocks.agg(F.max("n_blocks")).first()[0] or 1
    if longest > 1:
        level = checkpointed(level.where("n > 1"))
    while longest > 1:
        left, right = F.col("at") % 2 == 0, F.col("at") % 2 == 1
        pairs = level.groupBy("row_id", F.floor(F.col("at") / 2).cast("int").alias("at"), ((F.col("n") + 1) / 2).cast("int").alias("n"), "n_blocks").agg(
            F.min("own").alias("own"), F.max(F.when(left, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(right, F.col("name"))), F.lit(-1)).alias("right")
        )
        named = pairs.groupBy("left", "right").agg(F.min("own").alias("name"))
        level = checkpointed(pairs.join(named, ["left", "right"]).select("row_id", "at", "n", "n_blocks", "own", "name"))
        done = done.unionByName(level.where("n = 1"))
        level = level.where("n > 1")
        longest = (longest + 1) // 2
    heads = blocks.where("at = 0").select("row_id", "doc_id", "text_sha256")
    return heads.join(done.select("row_id", "n_blocks", "name"), "row_id")


def exact_groups(docs: DataFrame, block_bytes: int = 2048) -> DataFrame:
    """Groups of equal texts, and the row of each that stays: the one of largest id.

    Returns, per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    A null text equals an empty one. Null ids come before all others, so keep_id
    is null only where all ids of a group are; of repeated rows of the largest id
    one is kept. Other columns are left out. An empty table gives an empty one.
    A text crosses the network once for each partition that holds it.
    """
    rows = identities(docs, block_bytes)
    groups = rows.groupBy("n_blocks", "name").agg(F.max(F.struct("doc_id", "row_id")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, ["n_blocks", "name"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("keep.row_id")).alias("kept"), "text_sha256"
    )


def without_copies(docs: DataFrame, block_bytes: int = 2048) -> DataFrame:
    """``docs``, all columns, with one row of each group of equal texts: that of :func:`exact_groups`."""
    key, digest, turn = (unused(docs, c) for c in ("kept_id", "kept_text", "turn"))
    kept = exact_groups(docs, block_bytes).where("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(digest))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.sha2(utf8(F.col("text")), 256) == F.col(digest))
    joined = docs.join(kept, same, "left_semi")
    # rows that agree in id and text are copies as well
    one = Window.partitionBy("doc_id", F.sha2(utf8(F.col("text")), 256)).orderBy(F.lit(1))
    return joined.withColumn(turn, F.row_number().over(one)).where(F.col(turn) == 1).drop(turn)
