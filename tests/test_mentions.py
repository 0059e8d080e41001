import random

import pytest
from pyspark.sql import functions as F

from tracewell.functions.text import STOPWORDS
from tracewell.operators import mentions
from tracewell.plans import registry


def words_of(name):
    tokens = "".join(c if c.isascii() and c.isalnum() else " " for c in (name or "").lower()).split()
    return tuple(dict.fromkeys(t for t in tokens if t not in STOPWORDS))


def plain(traces):
    entities = {}
    for case, _, answer, _ in traces:
        if answer and case is not None:
            entities.setdefault(case, set()).add(answer)
    found = {}
    for case, trace, answer, sentences in traces:
        final = words_of(answer)
        others = [w for w in map(words_of, entities.get(case, ())) if w and w != final]
        for i, sentence in enumerate(sentences):
            flat = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in (sentence or "").lower()).split())
            named = lambda words: bool(words) and all(w in flat for w in words)
            found[trace, i] = (int(named(final)), int(not named(final) and any(map(named, others))), " ".join(final), len(others))
    return found


@pytest.mark.parametrize("short", (0, 1, 3, 64))
def test_mentions_equal_all_comparisons(spark, short):
    r = random.Random(short)
    parts = ("ka", "lo", "mi", "tre", "vu", "xen")
    word = lambda: "".join(r.choices(parts, k=r.randrange(2, 5)))
    vocabulary = [word() for _ in range(60)]
    name = lambda: r.choice(["", None, "acute", " ".join(r.choices(vocabulary, k=r.randrange(1, 4))), ", ".join(r.choices(vocabulary, k=2)), "the " + r.choice(vocabulary)])
    traces = []
    for t in range(120):
        sentences = [r.choice([None, "", "--", " ".join(r.choices(vocabulary, k=r.randrange(1, 25))), r.choice(vocabulary).upper() + "ly."]) for _ in range(r.randrange(1, 6))]
        traces.append((r.choice(["a", "b", "c", None]), t, name(), sentences))
    traces += [("d", 900, "mika lovu", ["lovu, mika", "lo vumika", "x"]), ("d", 901, "lovu mika", ["mika", "mika lovu"]), ("d", 902, "Lovu-mika", ["mikalovu"]), ("e", 903, None, ["mika", "f"]), ("f", 904, "f", ["F"])]
    df = spark.createDataFrame(traces, "case_id string, trace_id long, raw_answer string, sentences array<string>")
    words = mentions.case_words(df.select("case_id", F.col("raw_answer").alias("entity")))
    got = mentions.mentions(df, words, short).collect()
    assert len(got) == sum(len(s) for *_, s in traces) and all(x.n_sentences == len(traces[[t[1] for t in traces].index(x.trace_id)][3]) for x in got)
    assert {(x.trace_id, x.sentence_index): (x.mentions_final, x.mentions_other, x.final_words, x.n_other_entities) for x in got} == plain(traces)


def shuffled(spark):
    """Bytes that all stages so far have written for exchanges."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.fixture(scope="module")
def wordy(spark, tmp_path_factory):
    """Long documents of few sources; their folder and bytes of text."""
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(2, 9))) for _ in range(2000)]
    rows = [(i, "\n".join(" ".join(r.choices(vocabulary, k=60)) for _ in range(25)), "en", f"src{i % 3}", 0) for i in range(600)]
    folder = str(tmp_path_factory.mktemp("wordy"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder, sum(len(x[1]) for x in rows)


@pytest.mark.parametrize("name", ["kind_summary", "mention_flags", "mention_rates"])
def test_texts_are_not_exchanged(spark, wordy, name):
    folder, size = wordy
    before = shuffled(spark)
    registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    assert 0 < shuffled(spark) - before < size / 2


@pytest.mark.parametrize("name", ["kind_summary", "mention_rates"])
def test_a_word_of_all_names_does_not_bring_them_all(spark, tmp_path, name):
    rows = [(i, f"seen as hypertension of k{i:04d} \n" + "\n".join(f"line {n} on old hypertension" for n in range(20)), "en", "src", 0) for i in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    before, threshold = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with larger tables
    try:
        got = registry.QUERIES[name](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert 0 < shuffled(spark) - before < 8 * sum(len(x[1]) for x in rows)
    if name == "mention_rates":
        assert [(x.case_id, x.final_rate, x.other_rate, x.traces) for x in got] == [("src", round(1 / 21, 9), 0.0, 600)]
    else:
        assert {x.kind: x.n for x in got} == {"first": 600, "none": 12000}
