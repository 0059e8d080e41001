import hashlib
import random

import numpy as np
import pytest

from tracewell.llm.repeats import covered, previous_smaller, suffix_order, without_repeats


def brute(rows, length):
    least = {}
    last = 1 << 70
    for doc_id, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            least[s] = min(least.get(s, last), last if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            if least[data[i : i + length]] < (last if doc_id is None else doc_id):
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def rows(seed=0):
    r = random.Random(seed)
    words = ["alpha", "be", "gamma", "délta", "x"]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    passages = [make(40) for _ in range(4)]
    out = []
    for i in range(120):
        parts = [make(r.randrange(60))]
        for _ in range(r.randrange(3)):
            p = r.choice(passages)
            a, b = sorted(r.sample(range(len(p)), 2))
            parts += [p[a:b], make(r.randrange(10))]
        out.append((r.randrange(100), " ".join(parts)))
    whole = make(100)
    out += [(500 + i, whole) for i in range(10)] + [(3, whole[20:]), (None, whole), (None, None), (None, passages[0]), (700, None), (701, ""), (702, "z" * 200), (703, "z" * 60), (1, "z" * 49), (704, "ab" * 3000)]
    return out


def result(spark, data, **more):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in data], "doc_id long, text string, chunk int, kept string").repartition(3)
    return sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256, bytes(x.kept)) for x in without_repeats(df, keep_bytes=True, **more).collect()), key=str)


@pytest.mark.parametrize("chunk_bytes,bucket_bytes,hot,fan", [(16_000_000, 8_000_000, 4096, 8), (2_000, 1_000, 4096, 8), (2_000, 1_000, 0, 8), (2_000, 1_000, 3, 8), (1_000, 1_000, 4096, 3), (1_000, 1_000, 3, 2)])
def test_against_brute_force(spark, chunk_bytes, bucket_bytes, hot, fan):
    data = rows()
    assert result(spark, data, chunk_bytes=chunk_bytes, bucket_bytes=bucket_bytes, hot=hot, fan=fan) == brute(data, 50)


@pytest.mark.parametrize("length,piece", [(220, 100), (300, 150), (24, 8)])
def test_other_lengths(spark, length, piece):
    r = random.Random(3)
    passage = " ".join(str(r.randrange(1000)) for _ in range(400))
    data = [(i, passage[r.randrange(300) : 600 + r.randrange(900)] + str(i)) for i in range(30)] + rows()[:40]
    assert result(spark, data, length=length, piece=piece, chunk_bytes=5_000, bucket_bytes=4_000) == brute(data, length)


def test_suffix_order_and_smaller_positions():
    r = np.random.default_rng(5)
    data = np.concatenate([r.integers(97, 99, 3000), np.tile(r.integers(97, 99, 37), 20)]).astype(np.uint8)
    strings = {}
    for i in range(len(data) - 50 + 1):
        strings.setdefault(data[i : i + 50].tobytes(), i)
    starts = np.array(r.permutation(list(strings.values())))
    assert [data[i : i + 50].tobytes() for i in starts[suffix_order(data, starts, 50)]] == sorted(strings)
    values, first = r.integers(0, 30, 500), r.random(500) < 0.05
    first[0] = True
    low = np.maximum.accumulate(np.where(first, np.arange(500), 0))
    want = [max((j for j in range(low[i], i) if values[j] < values[i]), default=-1) for i in range(500)]
    assert previous_smaller(values, first).tolist() == want


def test_empty(spark):
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_order_by_bytes_when_hashes_collide(monkeypatch):
    from tracewell.llm import repeats

    data = np.frombuffer(b"0123456789" * 3 + b"abcdefghij" * 3, np.uint8)
    starts = np.array([0, 5, 10, 30, 40])
    docs = np.array([2, 0, 1, 3, 3])
    want = covered(data, starts, docs, 12).tolist()
    monkeypatch.setattr(repeats, "rolling", lambda d, n: {n[0]: np.zeros(len(d) - n[0] + 1, np.uint64)})
    assert covered(data, starts, docs, 12).tolist() == want == [True, False, False, False, False]
