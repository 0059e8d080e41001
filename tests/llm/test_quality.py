import random

import numpy as np

from tracewell.llm.quality import features, fit, fit_ordinal, graded


def test_features():
    at, weight = features(b"A b a %% c|d", 1000)
    assert abs(float((weight[:-2] ** 2).sum()) - 1) < 1e-5 and weight[-2:].tolist() == [1.0, 1.0]
    assert features(b"a a a b", 1000)[0][-2:].tolist() != features(b"a b c d", 1000)[0][-2:].tolist()
    assert len(features(b" \n", 1000)[0]) == 0


def test_ordered_grades():
    r = np.random.default_rng(0)
    rows = []
    for _ in range(1500):
        kind = r.integers(4)
        at = np.unique(np.concatenate([r.integers(10, 200, 20), [kind]])).astype(np.int32)
        rows.append((at, np.full(len(at), 0.3, np.float32), float(kind)))
    model = fit_ordinal(rows[:1000], 200)
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 3
    guess = [model.expected(model.tails(float(model.weights[a] @ w))) for a, w, _ in rows[1000:]]
    assert np.mean(np.abs(np.array(guess) - [g for *_, g in rows[1000:]])) < 0.4


def test_held_out(spark):
    r = random.Random(1)
    words = [f"{a}{b}" for a in "bdfgklm" for b in ("an", "er", "ion")]
    rows, labels = [], []
    for i in range(1000):
        junk = i % 5 == 0
        rows.append((i, " ".join(r.choice(words) + ("%%%" if junk and r.random() < 0.5 else "") for _ in range(40))))
        labels.append((i, 0 if junk else 1 + i % 2))
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows] + [(None, None, 2.0), (5000, "", 1.0), (5001, "x% " * 50_000, 1.0)], "doc_id long, text string, expected_grade double")
    model = fit(docs, spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, quality int"), examples=500)
    got = {x.doc_id: x for x in graded(docs, model, 1.0).collect()}
    assert len(got) == 1003
    assert np.mean([(got[i].tail_probability >= 0.5) == (q >= 1) for i, q in labels]) > 0.98
    assert all(0 <= x.expected_grade <= 2 and 0 <= x.tail_probability <= 1 for x in got.values())
    assert graded(docs.limit(0), model, 1.0).count() == 0
    one = fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert graded(docs, one, 1.0).first().tail_probability == 0.0


def test_two_grades_are_logistic_regression():
    """The same optimum as Newton's method finds on the penalised logistic loss."""
    r = np.random.default_rng(3)
    dims, decay = 5, 1e-2
    x = r.standard_normal((400, dims))
    y = (x @ np.array([1.0, -2.0, 0.5, 0.0, 1.5]) + 0.7 + r.logistic(size=400) > 0).astype(float)
    model = fit_ordinal([(np.arange(dims), row.astype(np.float32), g) for row, g in zip(x, y, strict=True)], dims, rounds=3000, rate=0.05, decay=decay)
    design, w = np.column_stack([x, -np.ones(400)]), np.zeros(dims + 1)
    penalty = np.diag([decay] * dims + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        w -= np.linalg.solve(design.T * (p * (1 - p)) @ design / 400 + penalty, design.T @ (p - y) / 400 + penalty @ w)
    assert np.allclose(model.weights, w[:dims], atol=2e-2) and abs(model.thresholds[0] - w[dims]) < 2e-2


def test_four_grades_are_at_an_optimum():
    """The loss can't be lowered by small changes of any parameter."""
    r = np.random.default_rng(4)
    x, decay = r.standard_normal((300, 3)), 1e-2
    score = x @ np.array([1.0, -1.0, 0.5]) + r.logistic(size=300)
    y = np.digitize(score, [-1.5, 0.0, 2.0]).astype(float)
    model = fit_ordinal([(np.arange(3), row.astype(np.float32), g) for row, g in zip(x, y, strict=True)], 3, rounds=3000, rate=0.05, decay=decay)

    def loss(thresholds, weights):
        below = 1 / (1 + np.exp(-(np.concatenate([[-np.inf], thresholds, [np.inf]])[None, :] - (x @ weights)[:, None])))
        at = y.astype(int)
        return -np.log(below[np.arange(300), at + 1] - below[np.arange(300), at]).mean() + decay / 2 * (weights**2).sum()

    best = loss(model.thresholds, model.weights)
    for step in (0.1, -0.1):
        for i in range(3):
            change = np.eye(3)[i] * step
            assert loss(model.thresholds + change, model.weights) > best and loss(model.thresholds, model.weights + change) > best


def test_grades_equal_brute_force(spark):
    import math
    import zlib
    from collections import Counter

    from tracewell.llm.quality import OrdinalModel

    r = np.random.default_rng(5)
    model = OrdinalModel(np.array([0.0, 1.0, 3.0]), np.array([-0.5, 0.8]), r.standard_normal(64))
    texts = ["", "a", "A b a", "x x x %% !", "one two three. four", "ä ö ä"]
    got = {x.doc_id: x for x in graded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, 3.0).collect()}
    for i, text in enumerate(texts):
        words = text.encode().lower().split()
        marks, run = [], b""
        for b in text.encode().lower() + b" ":
            if 33 <= b < 127 and not chr(b).isalnum():
                run += bytes([b])
            elif run:
                marks.append(run)
                run = b""
        counts = Counter([zlib.crc32(w) % 64 for w in words] + [zlib.crc32(m, 1) % 64 for m in marks])
        norm = math.sqrt(sum((1 + math.log(n)) ** 2 for n in counts.values())) or 1
        x = sum((1 + math.log(n)) / norm * model.weights[k] for k, n in counts.items())
        if words:
            repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
            x += model.weights[zlib.crc32(b"again%d" % (10 * repeats // len(words)), 2) % 64] + model.weights[zlib.crc32(b"fresh%d" % (10 * len(set(words)) // len(words)), 2) % 64]
        tails = [1 / (1 + math.exp(t - x)) for t in model.thresholds]
        assert abs(got[i].expected_grade - (tails[0] + 2 * tails[1])) < 1e-5 and abs(got[i].tail_probability - tails[1]) < 1e-5


def test_repeated_id_is_one_example(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "b"), (3, "c")], "doc_id long, text string")
    model = fit(docs, spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, quality int"), folds=1000)
    assert abs(model.thresholds[0]) < 3 and len(model.grades) == 2
