import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracewell.llm.context_tree import log_kt
from tracewell.llm.lm_scores import language_scores


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - 2 * math.lgamma(0.5)


def by_recursion(train, texts, depth):
    """Straight context-tree weighting, a dictionary for each binary tree."""
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)

    def decisions(text):
        data = b"\xff" * depth + text + b"\xff"
        for i in range(depth, len(data)):
            for k in range(8):
                yield data[i - depth : i], (1 << k) | (data[i] >> (8 - k)), data[i] >> (7 - k) & 1

    for text in train:
        for context, node, bit in decisions(text):
            for d in range(depth + 1):
                counts[context[depth - d :], node][bit] += 1
                if d:
                    children[context[depth - d + 1 :], node].add(context[depth - d :])
    memo = {}

    def weighted(context, node):
        if (context, node) not in memo:
            own = kt(*counts[context, node])
            if len(context) < depth:
                below = sum(weighted(c, node) for c in children[context, node])
                memo[context, node] = np.logaddexp(own, below) - math.log(2)
            else:
                memo[context, node] = own
        return memo[context, node]

    def predict(context, node, bit):
        rest, p, last = 1.0, 0.0, 0.5
        for d in range(depth + 1):
            at = (context[depth - d :], node)
            if at not in counts:
                break
            a, b = counts[at]
            last = (b + 0.5) / (a + b + 1)
            own = 1.0 if d == depth else math.exp(kt(a, b) - math.log(2) - weighted(*at))
            p += rest * own * last
            rest *= 1 - own
        p += rest * last
        return p if bit else 1 - p

    return [sum(math.log10(predict(*x)) for x in decisions(t)) for t in texts]


def rows():
    r = random.Random(3)
    words = ["the", "other", "Thing", "ÉTÉ", "a", "xx"]
    out = [(i, " ".join(r.choice(words) for _ in range(r.randrange(12)))) for i in range(60)]
    return out + [(100, None), (101, ""), (None, "no id"), (5, out[5][1]), (5, out[5][1]), (102, "\n\t zz "), (103, "q" * 50)]


@pytest.mark.parametrize("chunk_bytes,fan,hot", [(16_000_000, 8, 4_000_000), (300, 8, 5), (150, 2, 0)])
def test_against_recursion(spark, chunk_bytes, fan, hot):
    data = rows()
    df = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in data], "doc_id long, text string, n int, key string, chunk int").repartition(3)
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    train = [lowered(t) for i, t in data if not held(i)]
    counts = Counter(w for t in train for w in t.split())
    counts["end"] = len(train)
    n, v = sum(counts.values()), len(counts)
    scores = by_recursion(train, [lowered(t) for _, t in data], 3)
    want = []
    for (i, t), s in zip(data, scores, strict=True):
        tokens = [*lowered(t).split(), "end"]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        want.append((i, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 6), round(s, 4)))
    got = [(x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6), round(x.score, 4)) for x in language_scores(df, depth=3, chunk_bytes=chunk_bytes, bucket_bytes=chunk_bytes, fan=fan, hot=hot).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_no_rows(spark):
    assert language_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert language_scores(spark.createDataFrame([(None, "ab")], "doc_id long, text string")).first().train_tokens == 0


def test_large_counts():
    for a, b in ((0, 0), (3, 5000), (10**6, 7), (4095, 4096), (123456, 654321)):
        assert math.isclose(log_kt(np.array([a]), np.array([b]))[0], kt(a, b), rel_tol=1e-9, abs_tol=1e-6)
