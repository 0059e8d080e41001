import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tracewell.llm.mixing import mixed
from tracewell.llm.simhash import fingerprint
from tracewell.llm.toxicity import fit


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]
    rows, labels = [], []
    for i in range(600):
        text = [r.choice(words) for _ in range(r.randrange(80, 200))]
        if i % 6 == 0:
            for _ in range(3):
                text[r.randrange(len(text))] = r.choice(["zonk", "quux", "vile"])
        rows.append((i, " ".join(text), "en", f"s{i % 3}", 0, "extra"))
        labels.append((i, int(i % 6 == 0), 1))
    for k in range(40):  # copies, and near ones
        i = 1 + 6 * k
        rows.append((1000 + k, rows[i][1] if k % 2 else rows[i][1] + " more", "en", "s1", 0, None))
    rows += [(2000, None, None, None, None, None), (2001, "", "en", None, 0, None), (None, "null id", "en", "s0", 7, None), (7, rows[7][1], "en", "s1", 0, "extra")]
    where = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, turn string").repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{where}/labels.parquet")
    return str(where)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, model = docs.columns, fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        made = out.collect()
        if name == "toxicity":
            assert sorted(map(str, made)) == sorted(str(x) for x in rows if model.scored([x.text])[0][0] < 0.5)
            assert not any(w in (x.text or "") for x in made for w in ("zonk", "quux", "vile")) and len(made) > 520
        elif name == "exact_dedup":
            largest = defaultdict(list)
            for x in rows:
                largest[x.text or ""].append(x.doc_id)
            want = Counter((text, max(ids, key=lambda i: (i is not None, i or 0))) for text, ids in largest.items())
            assert Counter((x.text or "", x.doc_id) for x in made) == want
        elif name == "simhash":
            fps = {x.doc_id: fingerprint((x.text or "").encode()) for x in rows}
            ids = sorted(i for i in fps if i is not None)
            root = {i: i for i in ids}

            def find(i, root=root):
                while root[i] != i:
                    i = root[i]
                return i

            for n, a in enumerate(ids):
                for b in ids[n + 1 :]:
                    if (fps[a] ^ fps[b]).bit_count() <= 4:
                        x, y = find(a), find(b)
                        root[max(x, y)] = min(x, y)
            alone = None in fps and not any((fps[None] ^ fps[i]).bit_count() <= 4 for i in ids)
            assert {x.doc_id for x in made} == {i for i in ids if find(i) == i} | ({None} if alone else set())
            assert len(made) < len(rows)
        elif name == "mixing":
            times = {x.doc_id: x.copies for x in mixed(docs).collect()}
            assert Counter(x.doc_id for x in made) == Counter({i: n for i, n in times.items() if n})
        else:
            taken = Counter(x.doc_id for x in rows)
            pieces = Counter()
            for x in made:
                assert x.length == len(np.frombuffer(x.ids, "<u4")) <= 1024
                pieces[x.doc_id, x.doc_tokens] += x.length
            assert {i: n // t for (i, t), n in pieces.items()} == dict(taken)
        docs = spark.createDataFrame(made, out.schema)
        rows = made
    assert sum(x.length for x in corpus_pipeline.run(spark, folder).collect()) == sum(x.length for x in rows)


def test_each_stage_is_computed_once(spark, folder, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    stages = [("counted", lambda s, docs, d: docs.mapInArrow(count, docs.schema)), ("twice", lambda s, docs, d: docs.unionAll(docs))]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    out = corpus_pipeline.run(spark, folder)
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    assert out.count() == 2 * n and len(out.collect()) == 2 * n and seen.value == n
