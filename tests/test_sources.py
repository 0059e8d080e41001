import json

import pytest
from pyspark.sql import functions as F

from tracewell.sources import readers, schemas, sinks
from tracewell.streaming import ingest


def trace(name, starts=(1, 3), ends=(3, 5), n=5):
    spans = [{"sentence_index": i, "text": f"s{i}", "char_start": 2 * i, "char_end": 2 * i + 2, "token_start": a, "token_end": b} for i, (a, b) in enumerate(zip(starts, ends, strict=True))]
    return {"model": "m", "case_id": "c", "trace_id": name, "full_response": "x", "prompt_token_count": 1, "input_ids": list(range(n)), "sentences": spans, "raw_answer": " A ", "is_correct": True}


def test_traces(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps(t) for t in (trace("ok"), trace("short", n=4), trace("order", starts=(3, 1)))))
    rows = readers.traces(spark, str(tmp_path / "t.jsonl"))
    assert {x.trace_id: x.reason for x in readers.bad_spans(rows).collect()} == {"short": "range", "order": "empty span"}
    s = readers.trace_summaries(rows.where("trace_id = 'ok'"))
    got = s.withColumn("d", readers.depth(F.col("boundary_tokens"), F.col("prompt_token_count"), F.lit(1))).first()
    assert got.boundary_tokens == [1, 3, 5] and got.raw_answer == "A" and got.d == 0.5 and got.sentences == ["s0", "s1"]


def test_rollouts(spark, tmp_path):
    row = ("c-1", "t", 0, 0, 3, "h", [1, 2], "text", "stop", 7)
    rows = spark.createDataFrame([row, ("c-2", *row[1:])], schemas.ROLLOUTS)
    path = str(tmp_path / "rollouts")
    sinks.append_rollouts(rows, path)
    sinks.append_rollouts(rows.limit(1), path)
    assert readers.rollouts(spark, path).count() == 3
    one = readers.rollouts(spark, path, "c-2", ["trace_id"])
    assert one.count() == 1 and "PartitionFilters: [isnotnull(case_id" in one._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        sinks.append_rollouts(rows.withColumn("case_id", F.lit("../x")), path)
    part = next((tmp_path / "rollouts" / "case_id=c-1").glob("*.parquet"))
    (part.parent / "part-bad.parquet").write_bytes(b"PAR1 not really")
    state = readers.damaged_parts(spark, path).collect()
    assert sorted(x.rows is None for x in state) == [False, False, False, True]


def test_small_files(spark, tmp_path):
    path = str(tmp_path / "run" / "manifest.json")
    sinks.manifest({"a": 1}, path)
    sinks.manifest({"a": 1}, path)
    with pytest.raises(ValueError, match="a"):
        sinks.manifest({"a": 2}, path)
    assert readers.responses(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "cases.json").write_text(json.dumps([{"case_id": "1", "source": "s", "case": "x", "answer": "y"}]))
    assert readers.cohort(spark, str(tmp_path / "cases.json")).first().answer == "y"
    (tmp_path / "x.csv").write_text('model,case_id,note\nm,1,"a ""quoted""\nline"\nn,2,z\n')
    assert readers.csv(spark, str(tmp_path / "x.csv")).first().note == 'a "quoted"\nline'
    assert [x.case_id for x in readers.assigned_cases(spark, str(tmp_path / "x.csv"), "m").collect()] == ["1"]
    df = readers.cohort(spark, str(tmp_path / "cases.json"))
    assert not sinks.result_csv(df.limit(0), str(tmp_path / "empty")) and not (tmp_path / "empty").exists()
    assert sinks.result_csv(df, str(tmp_path / "out"))
    sinks.replace_table(df, str(tmp_path / "table"))
    sinks.append_lines(df, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 1


def test_arriving_samples(spark, tmp_path):
    row = ("c", "t", 0, 0, 3, "h", [1], "text", "stop", 7)
    path, table = str(tmp_path / "in"), str(tmp_path / "counts")
    for k in (1, 2):
        spark.createDataFrame([row, row, (*row[:3], k, *row[4:])], schemas.ROLLOUTS).write.mode("append").parquet(path)
        ingest.keep_histogram(ingest.arriving(spark, path), table, str(tmp_path / "state")).awaitTermination(60)
    assert ingest.histogram_so_far(spark, table).first().c == 3  # the first sample came in both batches
