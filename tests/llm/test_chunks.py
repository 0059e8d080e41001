import numpy as np

from tracewell.llm.chunks import Chunk, chunked, restored, squeezed


def test_round_trips(spark):
    for kind in (np.int64, np.int32, np.float32, np.uint8):
        for values in (np.zeros(0, kind), np.arange(300).astype(kind)):
            assert (restored(squeezed(values), kind) == values).all()
    rows = [(1, "a"), (None, "é" * 100), (2, None), (2, ""), (3, "x" * 5000)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, blob string").repartition(2)
    for size in (10, 1_000_000):
        made = chunked(df, size).collect()
        assert len({r.chunk for r in made}) == len(made)
        found = [x for r in made for c in [Chunk.unpack(r.blob)] for x in zip(c.doc_ids(), c.texts(), strict=True)]
        assert sorted(map(str, found)) == sorted(str((i, (t or "").encode())) for i, t in rows)
    assert chunked(df.limit(0), 10).count() == 0
