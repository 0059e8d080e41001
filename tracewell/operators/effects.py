"""What naming an answer does to the curve: contrasts of sentences within traces.

Rows are sentences: model, trace_id, sentence_index, tvd_drop, pre_commit,
mentions_final, mentions_other (0 or 1), is_first, is_repeat (booleans).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import gates, mentions, ranking, stats


def drops_with_mentions(drops: DataFrame, mentioned: DataFrame) -> DataFrame:
    """Drops with what each sentence names; sentences in only one of the two are left out."""
    flags = mentioned.select("trace_id", "sentence_index", "mentions_final", "mentions_other", "is_first", "is_repeat")
    return drops.join(flags, ["trace_id", "sentence_index"])


def contrast_sets() -> dict[str, Column]:
    """Which sentences the first mention is compared within: all, it and repeats, it and those naming another answer."""
    return {"all": F.lit(True), "repeats": F.col("is_first") | F.col("is_repeat"), "others": F.col("is_first") | (F.col("mentions_other") == 1)}


def _stacked(rows: DataFrame, sets: dict[str, Column]) -> DataFrame:
    """Each row once for every set that it is in."""
    inside = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in sets.items())))
    return rows.withColumn("spec", F.explode(inside))


def first_mention_effects(rows: DataFrame, by: Sequence[str] = (), outcome: str = "tvd_drop", least: int = 0) -> DataFrame:
    """Within-trace effect of the first mention in each contrast set, and in each group of ``by``.

    Adds the number of first mentions, z and its normal tail. Groups with fewer
    than ``least`` first mentions, or without variation, are left out.
    """
    stacked = _stacked(rows, contrast_sets()).withColumn("_x", F.col("is_first").cast("double"))
    keys = ["spec", *by]
    named = stacked.groupBy(*keys).agg(F.count_if("is_first").alias("n_first"), F.count_if(~F.col("is_first")).alias("_rest"))
    fits = stats.within(stacked, "trace_id", "_x", outcome, keys).join(named.where((F.col("n_first") >= max(1, least)) & (F.col("_rest") > 0)), keys)
    z = F.try_divide("beta", "se")
    return fits.select(*keys, F.col("beta").alias("coef"), "se", z.alias("z"), stats.normal_probability(z).alias("p"), "n", F.col("units").alias("traces"), "n_first")


def effects_in_sentences(rows: DataFrame, outcome: str = "tvd_drop") -> DataFrame:
    """Each model's effect over all sentences, divided by its mean drop: how many average sentences a first mention is worth."""
    fits = first_mention_effects(rows, ["model"], outcome).where("spec = 'all'").select("model", "coef")
    lengths = rows.groupBy("model", "trace_id").agg(F.count(F.lit(1)).alias("n")).groupBy("model").agg(F.percentile("n", F.lit(0.5)).alias("median_sentences"))
    means = rows.groupBy("model").agg(F.avg(outcome).alias("mean_drop"))
    return lengths.join(means, "model").join(fits, "model").withColumn("in_sentence_units", F.try_divide("coef", "mean_drop"))


def mention_effects(rows: DataFrame, outcome: str = "tvd_drop") -> DataFrame:
    """First and any mention of the final answer, each against all other sentences and against those naming another answer."""
    first, final, other = F.col("is_first"), F.col("mentions_final") == 1, F.col("mentions_other") == 1
    parts = F.array_compact(
        F.array(*(F.when(inside, F.struct(F.lit(term).alias("regressor"), F.lit(against).alias("comparison"), x.cast("double").alias("x"))) for term, x, against, inside in (
            ("first_mention", first, "all", F.lit(True)), ("mentions_final", final, "all", F.lit(True)), ("first_mention", first, "others", first | other), ("mentions_final", final, "others", final | other),
        )))
    )
    stacked = rows.select("*", F.explode(parts).alias("_part")).select("*", "_part.regressor", "_part.comparison", F.col("_part.x").alias("_x"))
    keys = ["regressor", "comparison"]
    treated = stacked.groupBy(*keys).agg(F.sum("_x").cast("long").alias("treated"))
    fits = stats.within(stacked, "trace_id", "_x", outcome, keys).join(treated, keys)
    z = F.try_divide("beta", "se")
    return fits.select(*keys, "n", "treated", F.col("beta").alias("coef"), "se", z.alias("z"), stats.normal_probability(z).alias("p"))


def effects_with_depth(rows: DataFrame, depth: str = "token_position", outcome: str = "tvd_drop") -> DataFrame:
    """The first mention's effect in each contrast set, as it is and with depth as a second regressor."""
    stacked = _stacked(rows, contrast_sets()).withColumn("_x", F.col("is_first").cast("double"))
    plain = stats.within(stacked, "trace_id", "_x", outcome, ["spec"]).select("spec", F.col("beta").alias("coef"))
    both = stats.within_two(stacked, "trace_id", "_x", depth, outcome, ["spec"]).select("spec", F.col("beta_1").alias("coef_with_depth"), F.col("beta_2").alias("coef_of_depth"))
    return plain.join(both, "spec")


def first_and_repeats(rows: DataFrame, outcome: str = "tvd_drop") -> DataFrame:
    """Each trace's drop at its one first mention and its mean over repeats, where it has both; their difference."""
    pair = rows.groupBy("trace_id").agg(F.avg(F.when(F.col("is_first"), F.col(outcome))).alias("first"), F.avg(F.when(F.col("is_repeat"), F.col(outcome))).alias("repeats"), F.count_if("is_first").alias("_n"))
    return pair.where("_n = 1 and first is not null and repeats is not null").select("trace_id", "first", "repeats", (F.col("first") - F.col("repeats")).alias("difference"))


def agreement(rows: DataFrame, outcome: str = "tvd_drop", level: float = 0.05) -> DataFrame:
    """Per model the adjusted effect against the plain difference of means, and whether they agree.

    Both probabilities are adjusted over the models; agreement is of sign and of
    being under ``level``. ``stars`` marks the adjusted within-trace one.
    """
    fits = first_mention_effects(rows, ["model"], outcome).where("spec = 'all'").select("model", "coef", F.col("p").alias("p_within"))
    side = lambda v: F.avg(F.when(F.col("is_first") == v, F.col(outcome)))
    plain = rows.groupBy("model").agg((side(True) - side(False)).alias("raw_diff"))
    ranked = stats.mann_whitney(rows.withColumn("_k", F.when(F.col("is_first"), "a").otherwise("b")), "_k", outcome, ["model"])
    both = fits.join(plain, "model").join(ranked.select("model", stats.normal_probability(F.col("z")).alias("p_marginal")), "model")
    both = both.withColumn("_family", F.lit(0))  # a row for each model, so one task ranks them
    both = ranking.adjust(ranking.adjust(both, "p_within", ["_family"], "q_within"), "p_marginal", ["_family"], "q_marginal").drop("_family")
    agree = (F.signum("coef") == F.signum("raw_diff")) & ((F.col("q_within") < level) == (F.col("q_marginal") < level))
    return both.withColumns({"agree": agree, "stars": gates.stars(F.col("q_within"), "ns")})


def largest_drops(rows: DataFrame, sentences: DataFrame, most: int = 300, outcome: str = "tvd_drop") -> DataFrame:
    """The ``most`` largest drops with rank, kind of sentence and its text ('' if unknown); trace and sentence decide ties.

    ``sentences`` has trace_id and sentences (an array of text).
    """
    top = ranking.top_rows(rows, [F.desc(outcome), "trace_id", "sentence_index"], most)
    kind = gates.sentence_kind(F.col("is_first"), F.col("is_repeat"), F.col("mentions_other") == 1)
    named = top.join(sentences.select("trace_id", "sentences"), "trace_id", "left").withColumns({"kind": kind, "sentence": F.coalesce(F.get("sentences", F.col("sentence_index")), F.lit(""))})
    turn = F.row_number().over(Window.orderBy(F.desc(outcome), "trace_id", "sentence_index"))  # of ``most`` rows
    return named.drop("sentences").withColumn("rank", turn)


def rival_rates(mentioned: DataFrame, commits: DataFrame, least: int = 5) -> DataFrame:
    """Per trace the share of sentences that name another answer before and after commitment (trace_id, commit_boundary)."""
    rows = mentioned.join(commits.where("commit_boundary is not null").select("trace_id", "commit_boundary").distinct(), "trace_id")
    models = mentioned.select("trace_id", "model").distinct()
    return mentions.rate_before_after(rows, F.col("commit_boundary"), F.col("mentions_other") == 1, least).join(models, "trace_id")


def rival_tests(rates: DataFrame) -> DataFrame:
    """Per model the medians before and after, of their difference, and the signed-rank test of it, adjusted over models."""
    change = F.col("after") - F.col("before")
    median = lambda c: F.percentile(c, F.lit(0.5))
    about = rates.groupBy("model").agg(F.count(F.lit(1)).alias("traces"), median("before").alias("before_median"), median("after").alias("after_median"), median(change).alias("delta_median"))
    tests = stats.wilcoxon(rates, change, ["model"]).select("model", "w_plus", "w_minus", stats.normal_probability(F.col("z")).alias("p"))
    return ranking.adjust(about.join(tests, "model", "left").withColumn("_family", F.lit(0)), "p", ["_family"]).drop("_family")
