import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.llm.exchange import ANSWERS, KEYS, KeyExchange, Route, region, regions_of


def test_regions_agree(spark):
    numbers = [0, 1, 7, 1 << 40, -5, (3 << 32) + 9]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    for bits in (0, 1, 5, 16):
        got = {r.n: r.r for r in df.select("n", region(F.col("n"), bits).alias("r")).collect()}
        assert [got[n] for n in numbers] == regions_of(np.array(numbers), bits).tolist()


def exchange(spark, sources, bits, fan):
    """What each source's keys are answered: the sum over all sources, and the rows that each step exchanged."""

    def bucket_of(keys, known):  # here, so that it goes to the workers with what uses it
        mixed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
        return (mixed >> np.uint64(63 - known)).astype(np.int64)

    ways = KeyExchange(Route(bits, len(sources), fan), bits, bucket_of, lambda values, starts, _: np.add.reduceat(values, starts))
    rows = []
    for number, keys in sources.items():
        keys = np.array(sorted(keys))
        order = ways.order(keys)
        rows += [(b, number, k, v) for b, k, v in ways.rows(keys[order], np.full(len(keys), number))]
    levels = ways.up(spark.createDataFrame([(b, n, bytearray(k), bytearray(v)) for b, n, k, v in rows], KEYS))

    def total(group: pa.Table) -> pa.Table:
        sizes, _, totals, place = ways.opened(group)
        return pa.table(ways.answers(group, sizes, totals[place]))

    replies = ways.down(levels, levels[-1].groupBy("bucket").applyInArrow(total, ANSWERS), np.int64).collect()
    by_source = {n: {} for n in sources}
    for r in replies:
        by_source[r.source][r.bucket] = bytes(r.values)
    return {n: ways.back(np.array(sorted(keys)), by_source[n], np.int64).tolist() for n, keys in sources.items()}, [level.count() for level in levels]


@pytest.mark.parametrize("bits,fan", [(0, 8), (3, 8), (5, 2), (6, 3)])
def test_answers_come_back(spark, bits, fan):
    r = np.random.default_rng(bits)
    sources = {int(n) << 32: set(r.integers(0, 500, 60).tolist()) for n in range(20)} | {5: {1}}
    sums = {}
    for n, keys in sources.items():
        for k in keys:
            sums[k] = sums.get(k, 0) + n
    got, rows = exchange(spark, sources, bits, fan)
    assert got == {n: [sums[k] for k in sorted(keys)] for n, keys in sources.items()}
    assert len(rows) == max(1, -(-bits // fan))


def test_rows_grow_with_the_text(spark):
    """Four sizes, each twice the one before in sources and buckets: rows of each step double, and don't go with the square."""
    r = np.random.default_rng(9)
    seen = []
    for size in (8, 16, 32, 64):
        sources = {n: set(r.integers(0, 1 << 40, 400).tolist()) for n in range(size)}
        seen.append(sum(exchange(spark, sources, size.bit_length(), 2)[1]) / size)
    steps = [-(-size.bit_length() // 2) for size in (8, 16, 32, 64)]
    assert all(rows <= 4 * 4 * step for rows, step in zip(seen, steps, strict=True))
    assert seen[-1] < 64 / 2  # the square would be 128 rows for each source
