import hashlib
from collections import defaultdict

from tracewell.llm.exact_dedup import exact_groups


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max(ids, key=lambda i: (i is not None, i or 0))
        digest = hashlib.sha256(text.encode()).hexdigest()
        done = False
        for i in ids:
            kept = i == keep and not done
            done |= kept
            out.append((i, keep, len(ids), kept, digest))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    base = "abcdefghij" * 50
    rows = [(i, base[: 100 + i % 40]) for i in range(200)] + [(300 + i, base[:i] + "X" + base[i + 1 :]) for i in range(0, 500, 7)]
    rows += [(900, None), (901, ""), (None, "a"), (902, "a"), (None, "lone"), (903, "x" * 5000), (904, "x" * 5000), (904, "x" * 5000), (905, "x" * 5001), (906, "é" * 33)]
    df = spark.createDataFrame([(i, t, "c", 5) for i, t in rows], "doc_id long, text string, name string, keep_id int").repartition(3)
    for block in (7, 64, 2048):
        got = sorted((tuple(r) for r in exact_groups(df, block).collect()), key=str)
        assert got == brute(rows)


def test_empty(spark):
    assert exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
