import random
import re

import numpy as np
import xxhash

from tracewell.llm.components import Union, components
from tracewell.llm.simhash import fingerprint, near_links, simhash_groups


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def reach(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint():
    for text in ("", " \t\n", "one", "One two THREE", "a b c d e f a b c d", "É é x y z ü", "w " * 9000 + "v"):
        assert fingerprint(text.encode()) == plain(text)


def test_near_links():
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(6)]
    fps = [b ^ sum(1 << k for k in r.sample(range(64), r.randrange(8))) for b in base for _ in range(40)]
    r.shuffle(fps)
    starts = np.zeros(len(fps), bool)
    starts[[0, 50, 51, 150]] = True
    run = np.cumsum(starts)
    for radius in (0, 1, 3, 4, 7):
        got = {(int(a), int(b)) for aa, bb in near_links(np.array(fps, np.uint64), starts, radius) for a, b in zip(aa, bb)}
        want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if run[i] == run[j] and (fps[i] ^ fps[j]).bit_count() <= radius}
        assert got == want


def test_union():
    r = random.Random(2)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(120)]
    u = Union(200)
    for i in range(0, 120, 10):
        u.add(np.array([a for a, _ in pairs[i : i + 10]]), np.array([b for _, b in pairs[i : i + 10]]))
    assert dict(enumerate(u.root.tolist())) == reach(pairs, range(200))


def test_components(spark):
    r = random.Random(3)
    pairs = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1200)] + [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(200)] + [(7, 7)]
    got = {x.node: x.root for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {n for p in pairs for n in p}
    want = {n: root for n, root in reach(pairs, nodes).items() if n != root}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = [(None, "lone words here"), (5000, None), (5001, ""), (5002, " \n"), (None, "")]
    for g in range(12):
        text = [r.choice(words) for _ in range(300)]
        for k in range(8):
            copy = list(text)
            for _ in range(k % 3):
                copy[r.randrange(300)] = r.choice(words)
            rows.append((g * 100 + k, " ".join(copy).upper() if k == 5 else " ".join(copy)))
    rows.append(rows[-1])
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, root string").repartition(3)
    fps = [plain(t) for _, t in rows]
    last = 1 << 60
    order = sorted(range(len(rows)), key=lambda n: last if rows[n][0] is None else rows[n][0])
    rank = {n: k for k, n in enumerate(order)}
    pairs = [(rank[i], rank[j]) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    roots = reach(pairs, range(len(rows)))
    want = sorted(str((rows[n][0], fps[n] - (1 << 64) if fps[n] >> 63 else fps[n], rows[order[roots[rank[n]]]][0])) for n in range(len(rows)))
    for most in (4096, 3):
        assert sorted(str(tuple(x)) for x in simhash_groups(df, most=most).collect()) == want
    assert simhash_groups(df.limit(0)).count() == 0
