import math

from tracewell.llm.mixing import emit, mixed, source_targets


def by_rounds(sizes, weights=(1, 2, 3), most=3):
    """Shares by weight, those above their bound held there, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > most * sizes[s] + 1e-9}
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 30, None: 5}, {"b": 7}, {"é": 0, "z": 4, "Z": 100, "a": 1, None: 0}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in source_targets(df).collect()}
        want = by_rounds(sizes)
        assert all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in sizes), (got, want)


def test_copies(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 3}", 1) for i in range(3000)] + [(None, None, None, 2), (5, "", "s0", 3), (6, "x y", None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, rate int")
    mix = mixed(df)
    got = mix.collect()
    assert len(got) == len(rows)
    assert all(0 <= r.copies <= 3 for r in got)
    taken, target = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.1 * target[s] + 6 for s in taken)
    assert emit(df).count() == sum(r.copies for r in got)
    assert emit(df).columns == df.columns
    assert sorted(map(str, got)) == sorted(map(str, mixed(df).collect()))
    assert mixed(df.limit(0)).count() == 0
