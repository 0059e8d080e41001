import math

import numpy as np
import pytest

from tracewell.llm.embedding_dedup import codes, embedding_groups, estimates, least_estimate, nearest_possible, plan, quantised


def brute(rows, threshold=0.95):
    ok = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, (_, v) in enumerate(rows) if ok(v)}
    links = {i: {j for j in unit if j != i and i in unit and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold} for i in range(len(rows))}
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        named = [rows[j][0] for j in seen if rows[j][0] is not None]
        root = min(named) if named else None
        out.append((vec_id, len(links[i]), root, vec_id == root))
    return sorted(out, key=str)


def vectors(seed=0):
    r = np.random.default_rng(seed)
    rows = [(i, r.standard_normal(24).tolist()) for i in range(300)]
    for g in range(10):
        base = r.standard_normal(24)
        rows += [(1000 + 100 * g + k, (base + r.standard_normal(24) * 0.05 * (g + 1)).tolist()) for k in range(20)]
    rows += [(5000 + k, rows[3][1]) for k in range(30)] + [(None, [2 * x for x in rows[4][1]]), (None, rows[5][1]), (3, rows[6][1])]
    rows += [(6000, None), (6001, [0.0] * 24), (6002, [float("nan")] * 24), (6003, [1.0, None] * 12), (6004, [float("inf")] + [0.0] * 23), (6005, []), (6006, [1.0, 0.0]), (6007, [1.0, 0.01]), (None, [0.0])]
    return rows


@pytest.mark.parametrize("most", [2048, 16])
def test_against_brute_force(spark, most):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, id string").repartition(3)
    assert sorted((tuple(x) for x in embedding_groups(df, most=most).collect()), key=str) == brute(rows)


def test_empty(spark):
    assert embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(1)
    a = r.standard_normal((2000, 64))
    b = a + 0.3 * r.standard_normal((2000, 64))
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    code, factor = codes(a, 5)
    turned, step = quantised(b, 5)
    e = estimates(code, factor, turned, step).diagonal()
    cosines = (a * b).sum(1)
    assert abs((e - cosines).mean()) < 0.005
    assert (e >= least_estimate(factor, step, 64, 0.95, 6.0))[cosines >= 0.95].all()
    upper = nearest_possible(*quantised(a, 5), turned, step).diagonal()
    assert (upper >= cosines).all() and (upper - cosines).max() < 0.1
    assert plan(50_000, 0.95, 1e-6)[0] == 6 and plan(10**9, 0.95, 1e-6)[0] == 20
