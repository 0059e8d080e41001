import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewell.operators import importance, ranking, scoring, selection, stats, summaries
from tracewell.shared import shared_dir


def test_scores_of_samples(spark):
    traces = spark.createDataFrame([("t", ["First one.", "Second."])], "trace_id string, sentences array<string>")
    long = "loop " * 2000
    rows = [
        ("c", "t", 0, 0, "First one. More <answer>Gout</answer>", "stop"),
        ("c", "t", 2, 1, "Tail <answer>Gout</answer>", "stop"),  # the last boundary leaves out no sentence
        ("c", "t", 1, 2, long, "length"),
        ("c", "t", 1, 3, long, "stop"),
        ("c", "t", 1, 4, None, None),
        ("c", "t", 1, 5, "<answer>Gout</answer>", "length"),
    ]
    rollouts = spark.createDataFrame(rows, "case_id string, trace_id string, boundary_index int, rollout_index int, continuation string, finish_reason string").withColumn("bucket", F.lit("x"))
    asked = spark.sparkContext.accumulator(0)

    def near(removed: pd.Series, first: pd.Series) -> pd.Series:
        asked.add(len(removed))
        return pd.Series([float(a == b) for a, b in zip(removed, first, strict=True)])

    got = {r.rollout_index: r for r in scoring.score_rollouts(rollouts, traces, near).collect()}
    assert tuple(got[0].asDict()) == scoring.COLUMNS and asked.value == 3
    assert (got[0].raw_answer, got[0].bucket, got[0].similarity, got[0].valid, got[0].is_correct) == ("Gout", "gout", 1.0, True, None)
    assert got[1].similarity is None and got[1].valid
    assert got[2].similarity is None and not got[2].valid and got[3].similarity == 0.0
    assert got[4].raw_answer is None and got[4].first_sentence is None and got[4].valid is False
    assert got[5].bucket == "gout" and got[5].valid is False
    held = scoring.withheld(scoring.score_rollouts(rollouts, traces, near)).collect()
    assert [(r.rollout_index, r.chars) for r in held] == [(2, 9999)]
    with pytest.raises(Exception, match="no trace"):
        scoring.score_rollouts(rollouts.withColumn("trace_id", F.lit("u")), traces, near).collect()
    assert scoring.score_rollouts(rollouts.limit(0), traces, near).count() == 0


def test_numbers_and_ranks_over_ranges(spark):
    r = random.Random(2)
    values = [r.randrange(40) for _ in range(500)]
    df = spark.createDataFrame([(i, v, f"n{v % 7}") for i, v in enumerate(values)] + [(900, None, "n")], "id int, v int, s string")
    got = {x.id: x.at for x in ranking.numbered(df.where("v is not null"), ["s", "v", "id"], "at").collect()}
    order = sorted(range(500), key=lambda i: (f"n{values[i] % 7}", values[i], i))
    assert [got[i] for i in order] == list(range(500))
    ranks = {x.id: x.rank for x in ranking.average_ranks(df, "v", "rank").collect()}
    assert all(ranks[i] == sum(w < v for w in values) + (values.count(v) + 1) / 2 for i, v in enumerate(values)) and 900 not in ranks
    one = ranking.strided_shard(df.where("v is not null"), ["v", "id"], 2, 7).select("id").collect()
    assert sorted(x.id for x in one) == sorted(sorted(range(500), key=lambda i: (values[i], i))[1::7])
    assert ranking.numbered(df.limit(0), ["id"], "at").count() == 0


def test_adjusted_probabilities(spark):
    r = random.Random(3)
    p = [round(r.random() ** 2, 2) for _ in range(120)]
    df = spark.createDataFrame([(i, x, "f") for i, x in enumerate(p)] + [(999, None, "f")], "id int, p double, family string")
    n, ordered = len(p), sorted(p)
    raw = {x: x * n / (max(i for i, v in enumerate(ordered) if v == x) + 1) for x in p}
    want = {i: min(1.0, *(raw[y] for y in p if y >= x)) for i, x in enumerate(p)} | {999: None}
    for by in ((), ("family",)):
        got = {x.id: x.q for x in ranking.adjust(df, "p", by).collect()}
        assert got.keys() == want.keys() and all(got[i] is None if w is None else abs(got[i] - w) < 1e-12 for i, w in want.items())


def test_draws_and_digests_of_pools(spark):
    cases = spark.createDataFrame([(s, f"{s}{i:02d}") for s in "ba" for i in range(30)], "source string, case_id string")
    quota = spark.createDataFrame([("a", 4), ("b", 6)], "source string, quota long")
    dice = random.Random(7)
    want = [c for s, n in (("a", 4), ("b", 6)) for c in sorted(dice.sample([f"{s}{i:02d}" for i in range(30)], n))]
    assert sorted(x.case_id for x in selection.seeded_draw(cases, quota, 7).collect()) == sorted(want)
    with pytest.raises(ValueError):
        selection.seeded_draw(cases, quota, 7, most=10)
    assert len(selection.id_digest(cases).first().digest) == 16
    with pytest.raises(Exception, match="at most"):
        selection.id_digest(cases, most=10).collect()


def test_tests_in_families(spark):
    r = random.Random(4)
    rows = [(r.choice("xy"), r.choice("ab"), float(r.randrange(9))) for _ in range(200)]
    df = spark.createDataFrame(rows, "family string, k string, v double")
    for f in stats.mann_whitney(df, "k", "v", ["family"]).collect():
        a, b = ([v for g, k, v in rows if g == f.family and k == kind] for kind in "ab")
        assert f.u == sum((x > y) + (x == y) / 2 for x in a for y in b) and (f.n_a, f.n_b) == (len(a), len(b))
    groups = {k: [v for _, g, v in rows if g == k] for k in "ab"}
    every = sorted(v for g in groups.values() for v in g)
    rank = {v: every.index(v) + (every.count(v) + 1) / 2 for v in every}
    n, ties = len(every), sum(every.count(v) ** 3 - every.count(v) for v in set(every))
    h = (12 / (n * (n + 1)) * sum(sum(rank[v] for v in g) ** 2 / len(g) for g in groups.values()) - 3 * (n + 1)) / (1 - ties / (n**3 - n))
    got = stats.kruskal(df, "k", "v").first()
    assert abs(got.h - h) < 1e-9 and got.df == 1


def test_normal_tail(spark):
    rows = spark.createDataFrame([(z / 2,) for z in range(-4, 9)] + [(None,)], "z double").select("z", stats.normal_probability(F.col("z")).alias("p")).collect()
    assert all(x.p is None if x.z is None else abs(x.p - math.erfc(abs(x.z) / math.sqrt(2))) < 1e-12 for x in rows)


def test_median_and_sentences_of_traces(spark):
    some = lambda *v: spark.createDataFrame([(x,) for x in v], "similarity float")
    assert importance.median_similarity(some(0.1, 0.4, None, 0.2, float("nan"), 0.3)) == pytest.approx(0.3)
    assert importance.median_similarity(some(0.1, 0.2, 0.3)) == pytest.approx(0.2)
    with pytest.raises(ValueError):
        importance.median_similarity(some(None, float("nan")))
    traces = spark.createDataFrame([("t", "m", "c", True, [("s0", 1, 4), ("s1", 4, 6)])], "trace_id string, model string, case_id string, is_correct boolean, sentences array<struct<text: string, token_start: int, token_end: int>>")
    table = spark.createDataFrame([("t", 0), ("t", 1), ("u", 0)], "trace_id string, sentence_index int")
    got = {(x.trace_id, x.sentence_index): (x.model, x.sentence_text, x.sentence_tokens, x.base_is_correct) for x in importance.with_sentences(table, traces).collect()}
    assert got == {("t", 0): ("m", "s0", 3, True), ("t", 1): ("m", "s1", 2, True), ("u", 0): (None, None, None, None)}


def test_summaries_of_empty_and_odd_rows(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 0.25)], "k string, v double")
    got = {(x.k, x.cut): (x.below, x.n) for x in summaries.cumulative_share(rows, "v", (0.5, 2.0), ["k"]).collect()}
    assert got == {("a", 0.5): (0, 1), ("a", 2.0): (1, 1), ("b", 0.5): (1, 1), ("b", 2.0): (1, 1)}
    assert summaries.mean_and_error(rows, "v", ["k"]).where("k = 'b'").first().se is None
    made = summaries.composition(rows, "k", ["b", "z"], "v", [0.25], "x").orderBy("place").collect()
    assert [(x.k, x["x0.25"], x.total) for x in made] == [("b", 1, 1), ("z", 0, 0)]
    assert summaries.cumulative_share(rows.limit(0), "v", (0.5,)).where("n > 0").count() == 0
    wide = summaries.cross_table(rows, ["v"], "k", ["a", "c"], F.count(F.lit(1)), "n_", fill=0).collect()
    assert {x.v: (x.n_a, x.n_c) for x in wide} == {1.0: (1, 0), None: (1, 0), 0.25: (0, 0)}


def test_shared_folder_needs_a_setting_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        shared_dir(Session())
    assert shared_dir(spark)
