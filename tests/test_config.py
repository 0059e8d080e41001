import pytest
from pyspark.sql import functions as F

from tracewell import config
from tracewell.functions import sentences
from tracewell.operators import preparing


def test_settings(tmp_path):
    (tmp_path / "m.yaml").write_text("hf_id: org/m\ndtype: null\nlayers: [3, 9]\nexpected_trace_format: think_block\nextra: 1\ndecoding: {max_new_tokens: 9, do_sample: true, temperature: 0.6}\n")
    model = config.model(tmp_path / "m.yaml")
    assert model.slug == "m" and model.layers == (3, 9)
    assert model.decoding.sampling() == {"temperature": 0.6, "top_p": 1.0, "top_k": -1, "repetition_penalty": 1.0, "max_tokens": 9}
    (tmp_path / "s.yaml").write_text("name: s\nmodels: [m]\nsolve: x_K6_y\nstrata: {}\npool_size: 5\n")
    study = config.study(tmp_path / "s.yaml")
    assert study.run("m", "sweep") == "s-m" and study.run("m", "screen") == "s-m-screen" and study.solve_at(8) == "x_K8_y" and study.floor == 40
    (tmp_path / "bad.yaml").write_text("name: s\nmodels: [m]\nsolve: x\nstrata: {}\npool: 5\n")
    with pytest.raises(ValueError, match="pool"):
        config.study(tmp_path / "bad.yaml")
    (tmp_path / "c.yaml").write_text("name: c\nprompt: p\nsources:\n  - {name: a, kind: csv, path: a.csv, case_field: t, answer_field: y}\n")
    assert config.cohort(tmp_path / "c.yaml").sources[0].path == "a.csv"
    (tmp_path / "t.yaml").write_text("name: t\nroster: [m]\nlayer_index: 1\n")
    assert config.taxonomy(tmp_path / "t.yaml").layer_of({"m": (3, 9)}) == {"m": 9}
    with pytest.raises(ValueError):
        config.taxonomy(tmp_path / "t.yaml").layer_of({"m": (3,)})
    assert "m" in config.slugs(tmp_path)
    with pytest.raises(ValueError):
        config.require_settings({"n_layers": 3}, {"n_layers": 4})
    assert config.provenance("r", model, "tok", {"a": "1"}, 10)["decoding"]["seed"] is None


def test_prepared_traces(spark):
    def encode(text):
        offsets = sentences.whitespace_tokens(text)
        return list(range(len(offsets))), offsets

    prompt = "Q: case"
    good = prompt + " <think> First one. Second one. </think> <answer>Gout</answer>"
    rows = [("a", prompt, good), ("b", "other", good), ("c", prompt, prompt), ("d", prompt, None)]
    made, skipped = preparing.prepare_traces(spark.createDataFrame(rows, "case_id string, prompt string, full_response string"), encode)
    trace = made.first()
    assert made.count() == 1 and [s.text for s in trace.sentences] == ["First one.", "Second one."] and trace.raw_answer == "Gout"
    assert [(s.token_start, s.token_end) for s in trace.sentences] == [(3, 5), (5, 7)] and trace.prompt_token_count == 2
    assert {x.case_id for x in skipped.collect()} == {"b", "c", "d"}
    assert preparing.rebuilt(good, encode(good)[1], 5, " More") == prompt + " <think> First one. More"
    n = preparing.eligible(spark.createDataFrame(rows[:1], "case_id string, prompt string, full_response string")).select(F.col("n_sentences")).first()[0]
    assert n == 2
