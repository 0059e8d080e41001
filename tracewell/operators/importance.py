"""What each sentence of a trace does to the answers sampled after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .distributions import arm_tvd, jensen_shannon, matched_arms, smoothed_kl, two_arms

SENTENCE = ("trace_id", "sentence_index")


def arm_of(similarity: Column, threshold: Column) -> Column:
    """Arm of a sample at a sentence's boundary; null without similarity. Single precision is widened before it is compared."""
    wide = similarity.cast("double")
    return F.when(wide.isNull() | F.isnan(wide), None).when(wide < threshold.cast("double"), "counterfactual").otherwise("similar")


def sentence_samples(samples: DataFrame, last: DataFrame, threshold: Column) -> DataFrame:
    """Each sample in the role that it plays for a sentence.

    A sample at boundary b is in the remove arm of sentence b, in the keep arm of
    sentence b - 1, and in the similar or counterfactual arm of sentence b. Trace
    of last boundary M has sentences 0 to M - 1. ``samples`` has trace_id,
    boundary_index, entity, valid, similarity.
    """
    rows = samples.withColumn("split", arm_of(F.col("similarity"), threshold))
    own = F.col("boundary_index")
    parts = F.array(
        F.struct(own.alias("sentence_index"), F.lit("remove").alias("arm")),
        F.struct((own - 1).alias("sentence_index"), F.lit("keep").alias("arm")),
        F.struct(F.when(F.col("split").isNotNull(), own).alias("sentence_index"), F.col("split").alias("arm")),
    )
    placed = rows.select("*", F.explode(parts).alias("part")).select("*", "part.sentence_index", "part.arm").drop("part", "split")
    return placed.join(last, "trace_id").where("sentence_index between 0 and last_boundary - 1")


def arm_counts(placed: DataFrame, by: Sequence[str] = SENTENCE) -> DataFrame:
    """Samples in each arm, those not valid in the remove and keep arms, and the replacement's figures."""
    n = lambda arm: F.count_if(F.col("arm") == arm)
    bad = lambda arm: F.count_if((F.col("arm") == arm) & ~F.col("valid"))
    scored = F.col("arm").isin("counterfactual", "similar")
    return placed.groupBy(*by).agg(
        n("remove").alias("remove_n"), n("keep").alias("keep_n"), n("counterfactual").alias("counterfactual_n"), n("similar").alias("similar_n"), bad("remove").alias("remove_invalid"), bad("keep").alias("keep_invalid"),
        F.try_divide(n("counterfactual"), F.count_if(scored)).alias("alternative_trajectory_fraction"), F.avg(F.when(scored, F.col("similarity").cast("double"))).alias("mean_replacement_similarity"),
    )


def divergences(placed: DataFrame, first: str, second: str, vocabulary: DataFrame | None = None, by: Sequence[str] = SENTENCE) -> DataFrame:
    """TVD, smoothed KL both ways and JSD of two arms; with ``vocabulary`` (trace_id, vocab_size) also KL over that support."""
    arms = two_arms(placed.where("valid"), by, "arm", first, second)
    found = [arm_tvd().alias("tvd"), smoothed_kl("p", "q", "n", "m").alias("kl"), smoothed_kl("q", "p", "m", "n").alias("kl_back"), jensen_shannon().alias("jsd")]
    if vocabulary is not None:
        arms = arms.join(vocabulary, "trace_id")
        size = F.max("vocab_size")
        found += [smoothed_kl("p", "q", "n", "m", support=size).alias("kl_fixed"), smoothed_kl("q", "p", "m", "n", support=size).alias("kl_back_fixed")]
    return arms.groupBy(*by).agg(*found)


def vocabulary(samples: DataFrame) -> DataFrame:
    """Distinct entities of each trace's valid samples."""
    return samples.where("valid").groupBy("trace_id").agg(F.count_distinct("entity").alias("vocab_size"))


def accuracies(placed: DataFrame, correct: str = "is_correct", by: Sequence[str] = SENTENCE) -> DataFrame:
    """Share of right answers in each arm among judged valid samples, and the differences from the keep arm."""
    mean = lambda arm: F.avg(F.when((F.col("arm") == arm) & F.col("valid"), F.col(correct).cast("double")))
    rows = placed.groupBy(*by).agg(mean("remove").alias("remove_accuracy"), mean("keep").alias("keep_accuracy"), mean("counterfactual").alias("counterfactual_accuracy"))
    return rows.withColumns({"resampling_accuracy_delta": F.col("keep_accuracy") - F.col("remove_accuracy"), "counterfactual_accuracy_delta": F.col("keep_accuracy") - F.col("counterfactual_accuracy")})


def matched(placed: DataFrame, n: int, key: Column, keep_most: float = 3.0, least_ratio: float = 2.0, vocabulary: DataFrame | None = None, by: Sequence[str] = SENTENCE) -> DataFrame:
    """Effective answers of the keep and counterfactual arms at ``n`` samples each, their ratio, KL, and whether the sentence is an anchor.

    Samples are drawn by the least hash of ``key``, so the draw does not depend on
    the order of rows. Sentences with fewer samples in an arm have no row. With
    ``vocabulary`` (trace_id, vocab_size) there is KL over that support as well.
    """
    arms = placed.where("valid and coalesce(entity, '') <> '' and arm in ('keep', 'counterfactual')")
    both = arms.withColumn("_arms", F.size(F.collect_set("arm").over(Window.partitionBy(*by)))).where("_arms = 2").drop("_arms")
    drawn = two_arms(matched_arms(both, by, "arm", n, key), by, "arm", "counterfactual", "keep")
    effective = lambda c: F.pow(F.lit(2.0), -F.sum(F.when(F.col(c) > 0, F.col(c) / n * F.log2(F.col(c) / n)).otherwise(0.0)))
    found = [effective("q").alias("matched_effective_keep"), effective("p").alias("matched_effective_counterfactual"), smoothed_kl("p", "q", "n", "m").alias("matched_kl_cf_keep")]
    if vocabulary is not None:
        drawn = drawn.join(vocabulary, "trace_id")
        found.append(smoothed_kl("p", "q", "n", "m", support=F.max("vocab_size")).alias("matched_kl_cf_keep_fixed"))
    rows = drawn.groupBy(*by).agg(*found)
    ratio = F.col("matched_effective_counterfactual") / F.col("matched_effective_keep")
    anchor = (F.round("matched_effective_keep", 6) <= keep_most) & (F.round(ratio, 6) >= least_ratio)  # sums of logarithms, in any order
    return rows.withColumns({"matched_n": F.lit(n), "matched_collapse_ratio": ratio, "matched_is_anchor": anchor})


def unique_replacements(placed: DataFrame, sentence: str = "first_sentence", by: Sequence[str] = SENTENCE) -> DataFrame:
    """Distinct share of the sentences that scored samples wrote instead, empty ones left out."""
    rows = placed.where(F.col("arm").isin("counterfactual", "similar") & (F.coalesce(F.col(sentence), F.lit("")) != ""))
    return rows.groupBy(*by).agg((F.count_distinct(sentence) / F.count(F.lit(1))).alias("unique_replacement_fraction"))


def median_similarity(samples: DataFrame) -> float:
    """The upper median of all similarities (that of the higher half's least), exact; ValueError if there is none."""
    found = samples.agg(F.expr("percentile_disc(0.5) within group (order by if(isnan(similarity), null, similarity) desc)").alias("m")).first()["m"]
    if found is None:
        raise ValueError("no similarity to take a median of")
    return float(found)


def with_sentences(table: DataFrame, traces: DataFrame) -> DataFrame:
    """An importance table with what its traces say: model, case, the sentence's text and tokens, and whether the trace itself was right.

    ``traces`` has trace_id, model, case_id, is_correct and sentences (structs of
    text, token_start, token_end).
    """
    own = F.get("sentences", F.col("sentence_index"))
    joined = table.join(traces.select("trace_id", "model", "case_id", F.col("is_correct").alias("base_is_correct"), "sentences"), "trace_id", "left")
    return joined.withColumns({"sentence_text": own["text"], "sentence_tokens": own["token_end"] - own["token_start"]}).drop("sentences")


def _kl_of(p: Column, q: Column, support: Column | None = None, alpha: float = 0.5) -> Column:
    """Smoothed KL of two arms' counts in bits, as an aggregate over entities; the union of both is the support if none is given."""
    inside = (p > 0) | (q > 0)
    k = F.count_if(inside) if support is None else support
    mass_p, mass_q = F.sum(p) + alpha * k, F.sum(q) + alpha * k
    own = F.sum(F.when(inside, (p + alpha) * F.log2((p + alpha) / (q + alpha)))) / mass_p
    return F.when((F.sum(p) > 0) & (F.sum(q) > 0), own + F.log2(mass_q / mass_p))


def _distances(p: Column, q: Column, n: Column, m: Column) -> tuple[Column, Column]:
    """TVD and JSD (bits) of two arms' counts of ``n`` and ``m``, as aggregates over entities."""
    both = (F.max(n) > 0) & (F.max(m) > 0)
    a, b = F.try_divide(p, n), F.try_divide(q, m)
    half = lambda x: F.when(x > 0, x * F.log2(2 * x / (a + b))).otherwise(0.0)
    return F.when(both, 1 - F.try_divide(F.sum(F.least(p * m, q * n)), F.max(n) * F.max(m))), F.when(both, (F.sum(half(a)) + F.sum(half(b))) / 2)


ARMS = ("keep", "remove", "counterfactual", "similar")


def arm_histograms(placed: DataFrame) -> DataFrame:
    """All four arms' counts of each entity of a sentence's valid samples side by side, and the arms' sizes (keep_all, ...)."""
    named = placed.where(F.col("valid") & (F.coalesce("entity", F.lit("")) != ""))
    counts = named.groupBy(*SENTENCE, "entity").agg(*(F.count_if(F.col("arm") == a).alias(a) for a in ARMS))
    whole = Window.partitionBy(*SENTENCE)
    return counts.withColumns({f"{a}_all": F.sum(a).over(whole) for a in ARMS})


def _all_divergences(placed: DataFrame, words: DataFrame) -> DataFrame:
    """The table's divergences and its histograms, from one table of counts."""
    rows = arm_histograms(placed).join(words, "trace_id", "left")
    keep, remove, other, similar = (F.col(a) for a in ARMS)
    size = lambda a: F.col(f"{a}_all")
    fixed = F.max("vocab_size")
    resampled, against, within = _distances(keep, remove, size("keep"), size("remove")), _distances(keep, other, size("keep"), size("counterfactual")), _distances(similar, other, size("similar"), size("counterfactual"))
    cells = {
        "resampling_kl_keep_remove": _kl_of(keep, remove), "resampling_kl_remove_keep": _kl_of(remove, keep), "resampling_kl_remove_keep_fixed": _kl_of(remove, keep, fixed), "resampling_jsd": resampled[1],
        "counterfactual_kl_keep_cf": _kl_of(keep, other), "counterfactual_kl_cf_keep": _kl_of(other, keep), "counterfactual_kl_keep_cf_fixed": _kl_of(keep, other, fixed), "counterfactual_kl_cf_keep_fixed": _kl_of(other, keep, fixed),
        "counterfactual_jsd": against[1], "counterfactual_tvd": within[0],
    }
    maps = {f"{a}_counts": F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(a) > 0, F.struct("entity", F.col(a).alias("c")))))) for a in ARMS}
    return rows.groupBy(*SENTENCE).agg(*(c.alias(n) for n, c in (cells | maps).items()))


def importance_table(samples: DataFrame, last: DataFrame, threshold: float | None = None, correct: str = "is_correct") -> DataFrame:
    """One row for each sentence of each trace, with its figures; arms that are missing count as empty.

    Without a ``threshold`` the samples' own :func:`median_similarity` splits them.

    The matched figures (at 16 samples, and at 10 with the suffix 10) are drawn by
    ``rollout_index``, a number unique within trace and boundary, and the share of
    unique replacements reads ``first_sentence``; without such a column in
    ``samples`` its figures are null.
    """
    threshold = median_similarity(samples) if threshold is None else threshold
    placed = sentence_samples(samples, last, F.lit(threshold))
    words = vocabulary(samples)
    out = last.select("trace_id", (F.col("last_boundary")).alias("n_sentences"), F.explode(F.sequence(F.lit(0), F.col("last_boundary") - 1)).alias("sentence_index")).where("n_sentences > 0")
    out = out.withColumn("position", F.col("sentence_index") / F.col("n_sentences")).join(words.withColumnRenamed("vocab_size", "case_vocab_size"), "trace_id", "left")
    parts = [arm_counts(placed), accuracies(placed, correct), _all_divergences(placed, words)]
    drawn = ["matched_n", "matched_effective_keep", "matched_effective_counterfactual", "matched_collapse_ratio", "matched_is_anchor", "matched_kl_cf_keep", "matched_kl_cf_keep_fixed"]
    kinds = ["int", "double", "double", "double", "boolean", "double", "double"]
    missing = {}
    for n, suffix in ((16, ""), (10, "10")):
        if "rollout_index" in samples.columns:
            key = F.concat_ws(":", *(F.col(c).cast("string") for c in (*SENTENCE, "arm", "rollout_index")))
            parts.append(matched(placed, n, key, vocabulary=words).select(*SENTENCE, *(F.col(c).alias(c + suffix) for c in drawn)))
        else:
            missing |= {c + suffix: F.lit(None).cast(kind) for c, kind in zip(drawn, kinds, strict=True)}
    if "first_sentence" in samples.columns:
        parts.append(unique_replacements(placed))
    else:
        missing["unique_replacement_fraction"] = F.lit(None).cast("double")
    for part in parts:
        out = out.join(part, list(SENTENCE), "left")
    empty = F.create_map().cast("map<string,bigint>")
    counts = {f"{arm}_counts": F.coalesce(f"{arm}_counts", empty) for arm in ARMS}
    return out.fillna(0, ["remove_n", "keep_n", "counterfactual_n", "similar_n", "remove_invalid", "keep_invalid"]).withColumns(counts | missing | {"threshold": F.lit(threshold)})
