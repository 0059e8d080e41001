import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewell.functions import probability
from tracewell.operators import curves, distributions, gates, grouping, importance, ledger, ranking, selection, stats


def histograms(spark, arms):
    """Histogram rows of {(trace, boundary): {entity: count}}."""
    rows = [(t, b, e, c) for (t, b), counts in arms.items() for e, c in counts.items()]
    return spark.createDataFrame(rows, "trace_id long, boundary_index int, entity string, c long")


def plain_tvd(p, q):
    n, m = sum(p.values()), sum(q.values())
    return sum(abs(p.get(e, 0) / n - q.get(e, 0) / m) for e in p.keys() | q.keys()) / 2


def test_distances(spark):
    r = random.Random(0)
    arms = {(t, b): {e: r.randrange(1, 9) for e in r.sample("ABCDE", r.randrange(1, 4))} for t in range(5) for b in range(6)}
    got = {(x.trace_id, x.i, x.j): x.num / x.den for x in distributions.forward_pairs(histograms(spark, arms)).collect()}
    want = {(t, i, j): plain_tvd(arms[t, i], arms[t, j]) for t in range(5) for i in range(6) for j in range(i + 1, 6)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_exact_tie_is_within_the_band(spark):
    arms = {(1, 0): {"A": 8, "B": 12}, (1, 1): {"A": 12, "B": 8}, (2, 0): {"A": 8, "B": 12}, (2, 1): {"A": 13, "B": 7}}
    curve = curves.forward_curve(distributions.forward_pairs(histograms(spark, arms)))
    assert {x.trace_id: x.within_band for x in curve.collect()} == {1: True, 2: False}


def test_share_may_hide_a_move(spark):
    arms = {(1, 0): {"A": 8, "B": 12}, (1, 1): {"A": 8, "C": 12}}
    assert distributions.forward_pairs(histograms(spark, arms)).first().num / 400 == 0.6


def test_commitment(spark):
    still = {b: {"A": 20} for b in range(4)}
    dips = {0: {"A": 20}, 1: {"A": 10, "B": 10}, 2: {"A": 20}, 3: {"A": 19, "B": 1}}
    never = {b: {"AB"[b % 2]: 20} for b in range(4)}
    hist = histograms(spark, {(t, b): c for t, arms in enumerate((still, dips, never)) for b, c in arms.items()})
    last = spark.createDataFrame([(t, 3) for t in range(4)], "trace_id long, last_boundary int")
    curve = curves.forward_curve(distributions.forward_pairs(hist))
    commit = lambda f: {x.trace_id: x.commit_boundary for x in curves.commitment(curve, last, f).collect()}
    assert commit("null") == {0: 0, 1: 2, 2: None, 3: None}
    assert commit("last") == {0: 0, 1: 2, 2: 3, 3: 3}
    drops = curves.drops(curve).groupBy("trace_id").agg(F.sum("tvd_drop").alias("s"), F.count("*").alias("n")).collect()
    ends = {t: [x.tvd_max_forward for x in sorted(curve.where(F.col("trace_id") == t).collect(), key=lambda x: x.boundary_index)] for t in range(3)}
    assert all(x.n == 2 and abs(x.s - (ends[x.trace_id][0] - ends[x.trace_id][-1])) < 1e-12 for x in drops)
    with pytest.raises(ValueError):
        curves.commitment(curve, last, "first")


def test_convergence(spark):
    # 0.8 - 0.6 is more than 0.2 in doubles
    rows = [(1, 0, 0.8), (1, 1, 0.6), (2, 0, 0.5), (2, 1, 0.6), (2, 2, 0.4), (3, 0, 0.5)]
    df = spark.createDataFrame(rows, "trace_id long, boundary_index int, share double")
    assert {x.trace_id: x.convergence_boundary for x in curves.convergence_index(df, "share").collect()} == {1: 1, 2: 0, 3: 0}
    assert {x.trace_id: x.convergence_boundary for x in curves.strict_convergence_index(df, "share").collect()} == {1: 1, 2: 0, 3: 0}


def test_thin_gate(spark):
    rows = [(1, 0, 11), (1, 1, 11), (2, 0, 11), (2, 1, 10), (3, 0, 30)]
    sizes = spark.createDataFrame(rows, "trace_id long, boundary_index int, n long")
    last = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "trace_id long, last_boundary int")
    assert [x.trace_id for x in gates.thin_gate(sizes, last).collect()] == [1]


def test_base_entity(spark):
    traces = spark.createDataFrame([("c", "t1", "Gout"), ("c", "t2", ""), ("c", "t3", None), ("c", "t4", "x")], "case_id string, trace_id string, raw_answer string")
    grades = spark.createDataFrame([("c", "Gout", "gout"), ("c", "x", ""), ("d", "x", "y")], "case_id string, raw_answer string, canonical string")
    assert [(x.trace_id, x.base_entity) for x in gates.base_entity(traces, grades).collect()] == [("t1", "gout")]


def test_divergences_with_missing_arms(spark):
    rows = [(1, 0, "A", True, 0.1), (1, 0, "B", True, 0.9), (1, 1, "A", True, None), (1, 1, "A", False, 0.2)]
    df = spark.createDataFrame(rows, "trace_id long, boundary_index int, entity string, valid boolean, similarity float").withColumn("is_correct", F.lit(True))
    last = spark.createDataFrame([(1, 2)], "trace_id long, last_boundary int")
    got = {x.sentence_index: x for x in importance.importance_table(df, last, 0.5).collect()}
    assert got[0].counterfactual_tvd == 1.0 and got[0].remove_n == 2 and got[0].keep_n == 2 and got[0].keep_invalid == 1
    assert got[1].keep_n == 0 and got[1].resampling_kl_keep_remove is None and got[1].counterfactual_tvd is None
    p, q = {"A": 1}, {"A": 1, "B": 1}
    kl = sum((p.get(e, 0) + 0.5) / 2 * math.log2(((p.get(e, 0) + 0.5) / 2) / ((q[e] + 0.5) / 3)) for e in "AB")
    assert abs(got[0].resampling_kl_keep_remove - kl) < 1e-12


def test_matched_counts_and_replacements(spark):
    rows = [(1, 0, i, "AB"[i % 2] if i else "C", True, 0.1, f"s{i % 4}") for i in range(12)] + [(1, 0, 12, "A", True, 0.9, "s0"), (1, 0, 13, "D", False, 0.9, "")]
    rows += [(1, 1, i, "A", True, None, None) for i in range(16)] + [(1, 2, 0, "E", True, None, None)]
    df = spark.createDataFrame(rows, "trace_id long, boundary_index int, rollout_index int, entity string, valid boolean, similarity float, first_sentence string").withColumn("is_correct", F.lit(True))
    last = spark.createDataFrame([(1, 2)], "trace_id long, last_boundary int")
    got = {x.sentence_index: x for x in importance.importance_table(df, last, 0.5).collect()}
    own = got[0]
    assert own.keep_counts == {"A": 16} and own.counterfactual_counts == {"A": 5, "B": 6, "C": 1} and own.similar_counts == {"A": 1} and own.remove_counts == {"A": 6, "B": 6, "C": 1}
    assert own.unique_replacement_fraction == 4 / 13 and got[1].unique_replacement_fraction is None and got[1].similar_counts == {}
    assert own.matched_n is None and own.matched_kl_cf_keep is None and own.matched_n10 == 10 and own.matched_effective_keep10 == 1.0
    draw = sorted(range(12), key=lambda i: hashlib.sha256(f"1:0:counterfactual:{i}".encode()).hexdigest())[:10]
    p = Counter(rows[i][3] for i in draw)
    effective = 2 ** -sum(c / 10 * math.log2(c / 10) for c in p.values())
    assert abs(own.matched_effective_counterfactual10 - effective) < 1e-12 and abs(own.matched_collapse_ratio10 - effective) < 1e-12 and own.matched_is_anchor10 == (effective >= 2)

    def kl(words):
        a, b = ({e: (c.get(e, 0) + 0.5) / (10 + 0.5 * len(words)) for e in words} for c in (p, {"A": 10}))
        return sum(a[e] * math.log2(a[e] / b[e]) for e in words)

    assert abs(own.matched_kl_cf_keep10 - kl({*p, "A"})) < 1e-12 and abs(own.matched_kl_cf_keep_fixed10 - kl("ABCE")) < 1e-12


def test_order_statistics(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 10)] + [("b", 5), ("c", None)], "k string, v int")
    assert {x.k: x.upper_median for x in ranking.upper_median(df, ["k"], "v").collect()} == {"a": 3, "b": 5}
    assert {x.k: x.nearest_rank for x in ranking.nearest_rank(df, ["k"], "v", 0.75).collect()} == {"a": 10, "b": 5}
    with pytest.raises(ValueError):
        ranking.strided_shard(df, ["v"], 3, 2)


def test_adjusted(spark):
    p = [0.01, 0.04, 0.03, 0.5, 0.04]
    got = {x.i: x.q for x in ranking.adjust(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p").collect()}
    order = sorted(range(5), key=lambda i: p[i])
    want = {i: min(1, min(p[j] * 5 / (k + 1) for k, j in enumerate(order) if k >= n)) for n, i in enumerate(order)}
    assert all(abs(got[i] - want[i]) < 1e-12 and got[i] >= p[i] - 1e-12 for i in want), (got, want)
    assert got[1] == got[4]


@pytest.mark.parametrize("available,total", [({"a": 5, "b": 100, "c": 100}, 60), ({"a": 1, "b": 2, "c": 3}, 60), ({"b": 10, "a": 10, "c": 10}, 20), ({"a": 0, "b": 9}, 4)])
def test_quotas(spark, available, total):
    left, pool, want = total, sorted(available), {}
    while pool:
        share = left // len(pool)
        small = [s for s in pool if available[s] <= share]
        for s in small:
            want[s] = available[s]
            left -= available[s]
        pool = [s for s in pool if s not in want]
        if not small:
            want |= {s: share + (i < left - share * len(pool)) for i, s in enumerate(pool)}
            break
    got = selection.quotas(spark.createDataFrame(list(available.items()), "source string, available long"), total)
    assert {x.source: x.quota for x in got.collect()} == want


def test_cases_keep_the_first_within_a_source(spark):
    rows = [(1, "s", "A b!"), (2, "s", "ab"), (3, "s", "Ab"), (4, "t", "Ab"), (5, "t", " \xa0"), (6, "t", None)]
    df = spark.createDataFrame(rows, "n int, source string, text string")
    assert sorted(x.n for x in selection.cases(df, ["n"]).collect()) == [1, 2, 4]
    with pytest.raises(ValueError):
        selection.expect(df, {"s": 2})
    assert selection.expect(df, {"s": 3}, 6).count() == 6


def test_ledger(spark):
    want = spark.createDataFrame([("a", 1), ("b", 2)], "k string, place int")
    there = spark.createDataFrame([("b", "x"), ("a", "y"), ("a", "z")], "k string, v string")
    assert [(x.k, x.v) for x in ledger.in_order(there, want, "k", ["v"]).collect()] == [("a", "y"), ("b", "x")]
    with pytest.raises(ValueError):
        ledger.require(want, there.where("k = 'a'"), ["k"], "a record")


def test_probabilities():
    assert abs(probability.t_two_sided(1.4369, 313.78) - 0.15174) < 1e-4
    assert abs(probability.t_two_sided(2.228, 10) - 0.05) < 1e-4
    assert abs(probability.normal_two_sided(1.959964) - 0.05) < 1e-6
    assert abs(probability.chi2_upper(3.841459, 1) - 0.05) < 1e-6 and abs(probability.chi2_upper(18.307, 10) - 0.05) < 1e-4
    assert probability.signed_rank_exact(0, 5) == 2 / 32


def test_statistics(spark):
    a, b = [1.0, 2.0, 2.0, 5.0], [2.0, 4.0, 6.0, 7.0, 9.0]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "k string, v double")
    u = sum((x > y) + (x == y) / 2 for x in a for y in b)
    assert stats.mann_whitney(df, "k", "v").first().u == u
    row = stats.welch(df, "k", "v").withColumn("p", stats.t_probability("t", "df")).first()
    assert 0 < row.p < 0.1 and row.df < 7
    h = stats.kruskal(df, "k", "v", least=1).withColumn("p", stats.chi2_probability("h", F.col("df").cast("double"))).first()
    assert 0 < h.p < 0.1
    w = stats.wilcoxon(spark.createDataFrame([(x,) for x in (1.0, -2.0, 3.0, 0.0, 3.0)], "d double"), F.col("d")).first()
    assert (w.n, w.w_plus, w.w_minus) == (4, 8.0, 2.0)


def test_within_equals_one_constant_per_unit(spark):
    import numpy as np

    r = np.random.default_rng(0)
    unit, x = r.integers(0, 6, 80), r.standard_normal(80)
    y = 0.5 * x + unit + 0.1 * r.standard_normal(80)
    got = stats.within(spark.createDataFrame(list(zip(unit.tolist(), x.tolist(), y.tolist(), strict=True)), "u long, x double, y double"), "u", "x", "y").first()
    design = np.column_stack([x, *(unit == k for k in range(6))]).astype(float)
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    e = y - design @ beta
    bread = np.linalg.inv(design.T @ design)
    meat = sum(np.outer(s, s) for s in (design[unit == k].T @ e[unit == k] for k in range(6)))
    se = np.sqrt((bread @ meat @ bread)[0, 0] * 6 / 5 * 79 / (80 - 7))
    assert abs(got.beta - beta[0]) < 1e-9 and abs(got.se - se) < 1e-9


def test_judge(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = [("c", a, i) for i, a in enumerate(["Gout", "gout!", "acute gout", "gout acute", "Sepsis"])]
    answers = spark.createDataFrame(rows, "case_id string, answer string, seen int")
    contexts = spark.createDataFrame([("c", "text")], "case_id string, case string")
    got = {x.answer: x.entity for x in grouping.group_answers(answers, contexts, grouping.rule_judge).collect()}
    assert got["gout!"] == "Gout" and got["acute gout"] == got["gout acute"] and len(set(got.values())) == 3
    assert grouping.assigned([" a", "b", "c"], [("X", ["a", "zz"]), ("Y", ["a", "b"]), (" ", ["c"])]) == {"a": "X", "b": "Y", "c": "c"}
    gold = spark.createDataFrame([("c", "Gout")], "case_id string, gold string")
    graded = grouping.grade(spark.createDataFrame([("c", e) for e in ("Gout", "Sepsis", "")], "case_id string, entity string"), gold, lambda g, e: 9.0 if g == e else None)
    assert {x.entity: x.is_correct for x in graded.collect()} == {"Gout": True, "Sepsis": None, "": False}
    assert grouping.json_in('x ```json\n{"a": 1}\n``` y') == {"a": 1} and grouping.json_in("none") is None
    assert grouping.pause(9, retry_after=100) == 60.0 and 15 <= grouping.pause(9) <= 45


def test_asking_once(spark):
    requests = spark.createDataFrame([("k1", "a"), ("k1", "a"), ("k2", "b"), ("k3", "c")], "key string, payload string")
    cache = spark.createDataFrame([("k2", "known")], "key string, reply string")
    got = {x.key: x.reply for x in grouping.ask_all(requests, cache, lambda p: None if p == "c" else p.upper(), attempts=1).collect()}
    assert got == {"k1": "A", "k2": "known", "k3": None}
    texts = spark.createDataFrame([("a  b",), ("a b",), (" ",), ("c",)], "text string")
    none = spark.createDataFrame([], "key string, vec array<float>")
    assert grouping.embed_all(texts, none, lambda ts: [[3.0, 4.0] for _ in ts], 2).count() == 2


def test_spearman_of_one_value_is_nan(spark):
    rows = [("same", 1, 4), ("same", 2, 4), ("same", 3, 4), ("one", 1, 1), ("up", 1, 10), ("up", 2, 20), ("up", 3, 20), ("down", 1, 2), ("down", 2, 1)]
    got = {x.k: (x.n, x.rho) for x in stats.spearman(spark.createDataFrame(rows, "k string, x int, y int"), "x", "y", ["k"]).collect()}
    assert {k: n for k, (n, _) in got.items()} == {"same": 3, "one": 1, "up": 3, "down": 2}
    assert math.isnan(got["same"][1]) and math.isnan(got["one"][1])
    assert abs(got["up"][1] - math.sqrt(0.75)) < 1e-12 and got["down"][1] == -1
