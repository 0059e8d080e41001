"""Summaries that studies report: shares, cross tables, and tables over bands and arms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_and_error(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean and standard error (sample deviation over the root of n) of the values that are there; the error of one value is null."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.try_divide(F.stddev_samp(value), F.sqrt(F.count(value))).alias("se"))


def mean_of_means(rows: DataFrame, value: str, inner: Sequence[str], outer: Sequence[str] = ()) -> DataFrame:
    """The same over the means of the inner groups, so that each counts once whatever its size."""
    each = rows.groupBy(*outer, *inner).agg(F.avg(value).alias("_mean"))
    return mean_and_error(each, "_mean", outer)


def cumulative_share(rows: DataFrame, value: str, cuts: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """How many of the values lie below each cut, of how many, in percent."""
    known = rows.where(F.col(value).isNotNull())
    below = F.array(*(F.struct(F.lit(float(c)).alias("cut"), F.lit(i).alias("place")) for i, c in enumerate(cuts)))
    counts = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(value) < c).alias(f"_{i}") for i, c in enumerate(cuts)))
    each = counts.select(*by, "n", F.explode(below).alias("_at"), F.array(*(F.col(f"_{i}") for i in range(len(cuts)))).alias("_below"))
    found = F.get("_below", F.col("_at.place"))
    return each.select(*by, F.col("_at.cut").alias("cut"), found.alias("below"), "n", (100 * F.try_divide(found, "n")).alias("percent"))


def cross_table(rows: DataFrame, index: Sequence[str], columns: str, values: Sequence, cell: Column, prefix: str = "", fill: float | None = None) -> DataFrame:
    """``cell`` for each index and each of the given values of a column, empty cells null or ``fill``."""
    made = rows.groupBy(*index).pivot(columns, list(values)).agg(cell)
    names = [f"{prefix}{v}" for v in values]
    out = made.select(*index, *(F.col(f"`{v}`").alias(n) for v, n in zip(values, names, strict=True)))
    return out if fill is None else out.fillna(fill, names)


def composition(rows: DataFrame, bin_column: str, bins: Sequence[str], columns: str, values: Sequence, prefix: str = "") -> DataFrame:
    """Rows of each bin and value, zero ones as well, with the bin's place and total."""
    spine = rows.sparkSession.createDataFrame([(b, i) for i, b in enumerate(bins)], f"{bin_column} string, place int")
    counts = rows.groupBy(bin_column).agg(*(F.count_if(F.col(columns) == v).alias(f"{prefix}{v}") for v in values), F.count(F.lit(1)).alias("total"))
    return F.broadcast(spine).join(counts, bin_column, "left").fillna(0)


def missing_similarity(samples: DataFrame, most: int = 10, by: Sequence[str] = ("trace_id", "boundary_index")) -> DataFrame:
    """The ``most`` boundaries with most samples without similarity (null or NaN), those with none left out."""
    gone = F.col("similarity").isNull() | F.isnan(F.col("similarity").cast("double"))
    counts = samples.groupBy(*by).agg(F.count_if(gone).alias("missing"), F.count(F.lit(1)).alias("n")).where("missing > 0")
    return counts.orderBy(F.desc("missing"), *by).limit(most)


def total_by_kind(rows: DataFrame, value: str, kind: str, trace: str = "trace_id") -> DataFrame:
    """Sum and number of a trace's values, then their means over the traces of each kind."""
    each = rows.groupBy(kind, trace).agg(F.sum(value).alias("total"), F.count(value).alias("size"))
    return each.groupBy(kind).agg(F.count(F.lit(1)).alias("traces"), F.avg("total").alias("mean_total"), F.avg("size").alias("mean_mentions"))


def case_difficulty(outcome: DataFrame) -> DataFrame:
    """Share of wrong answers among the graded ones of a case (model, case_id, n_wrong, n_graded), averaged over models."""
    share = F.try_divide("n_wrong", "n_graded")
    return outcome.groupBy("case_id").agg(F.avg(share).alias("case_wrong_frac"), F.count(share).alias("n_models"))


def direction_count(medians: DataFrame, unit: str, source: str, value: str, order: Sequence[str]) -> DataFrame:
    """For each source the number of units where its value is highest, ties going to the first in ``order``."""
    place = F.coalesce(*(F.when(F.col(source) == s, F.lit(-i)) for i, s in enumerate(order)))
    top = medians.where(F.col(source).isin(*order) & F.col(value).isNotNull()).groupBy(unit).agg(F.max_by(source, F.struct(F.col(value), place)).alias(source))
    return top.groupBy(source).agg(F.count(F.lit(1)).alias("units"))


def _quartiles(value: str, digits: int) -> Column:
    q = lambda p: F.round(F.percentile(value, F.lit(p)), digits)
    return F.when(q(0.5).isNotNull(), F.format_string(f"%.{digits}f [%.{digits}f, %.{digits}f]", q(0.5), q(0.25), q(0.75)))  # null for no values


def sensitivity_table(sweep: DataFrame) -> DataFrame:
    """What each band buys, as text: traces that commit, where, and what the answers are like there.

    ``sweep`` has a row per trace and delta: commits (boolean), depth, top_share
    and second_share at the commitment (null where there is none). Where no trace
    commits, only the percentage of those that do is there.
    """
    known = lambda c: F.when(F.col("commits"), F.col(c))
    rows = sweep.withColumns({c: known(c) for c in ("depth", "top_share", "second_share")})
    percent = lambda c: F.when(c.isNotNull(), F.format_string("%.1f%%", F.round(100 * c, 1)))
    return rows.groupBy("delta").agg(
        percent(F.avg(F.col("commits").cast("int"))).alias("committing"), _quartiles("depth", 3).alias("depth_median_iqr"), percent(F.avg((F.col("depth") < 0.5).cast("int"))).alias("before_mid_trace"),
        _quartiles("top_share", 2).alias("top_answer_share"), _quartiles("second_share", 2).alias("second_answer_share"),
    )


def delta_summary(sweep: DataFrame) -> DataFrame:
    """Per delta: percent of traces that commit, and the upper medians of depth and top share there (see :func:`.ranking.upper_median`)."""
    upper = lambda c: F.get(F.array_sort(F.collect_list(F.when(F.col("commits"), F.col(c)))), F.floor(F.count_if("commits") / 2).cast("int"))
    return sweep.groupBy("delta").agg((100 * F.avg(F.col("commits").cast("int"))).alias("committing"), upper("depth").alias("median_depth"), upper("top_share").alias("top_share"))


def restriction_summary(drops: DataFrame) -> DataFrame:
    """What leaving out sentences after commitment removes: one row.

    ``drops`` has a row per sentence: pre_commit (boolean), tvd_before, tvd_drop.
    """
    pre, at = F.col("pre_commit"), lambda side, c: F.when(F.col("pre_commit") == side, F.col(c))
    return drops.agg(
        F.count(F.lit(1)).alias("sentences"), F.count_if(~pre).alias("after"), (100 * F.avg((~pre).cast("int"))).alias("percent_after"), F.max(at(False, "tvd_before")).alias("highest_curve_after"),
        F.max(at(False, "tvd_drop")).alias("highest_drop_after"), F.max(at(True, "tvd_drop")).alias("highest_drop_before"), F.avg(at(False, "tvd_drop")).alias("mean_drop_after"), F.avg(at(True, "tvd_drop")).alias("mean_drop_before"),
    )


def kinds_before_commitment(drops: DataFrame) -> DataFrame:
    """Per kind of sentence: how many there are, and the percent of them that precede commitment.

    A sentence counts in each of its kinds (flags is_first, is_repeat, mentions_other).
    """
    flags = F.array(*(F.when(F.col(c).cast("boolean"), F.lit(n)) for c, n in (("is_first", "first"), ("is_repeat", "repeat"), ("mentions_other", "other"))))
    rows = drops.select("pre_commit", F.explode(F.array_compact(flags)).alias("kind"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("sentences"), (100 * F.avg(F.col("pre_commit").cast("int"))).alias("percent_before"))


def token_widths(widths: DataFrame, tokens: DataFrame, by: Sequence[str] = (), fractions: Sequence[float] = (0.8, 1.0)) -> DataFrame:
    """Windows of decline in tokens, over all traces or by columns of ``tokens``.

    ``widths`` is that of :func:`.curves.drop_widths`; ``tokens`` has trace_id,
    reasoning_tokens and the columns of ``by``. A fraction's width times the
    trace's tokens is its window; mean, median and quartiles, null where a group
    has none.
    """
    names = [f"tok{round(100 * f)}" for f in fractions]
    at = lambda f: F.max(F.when(F.abs(F.col("drop_fraction") - f) < 1e-9, F.col("width")))
    wide = widths.groupBy("trace_id").agg(*(at(f).alias(n) for f, n in zip(fractions, names, strict=True))).where(F.coalesce(*names).isNotNull())
    rows = wide.join(tokens.select("trace_id", "reasoning_tokens", *by), "trace_id")
    rows = rows.withColumns({n: F.col(n) * F.col("reasoning_tokens") for n in names})
    q = lambda c, p: F.percentile(c, F.lit(p))
    cells = [c for n in names for c in (F.avg(n).alias(f"{n}_mean"), q(n, 0.5).alias(f"{n}_median"), q(n, 0.25).alias(f"{n}_q25"), q(n, 0.75).alias(f"{n}_q75"))]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), q("reasoning_tokens", 0.5).alias("reasoning_median"), *cells)


def paired_arms(rows: DataFrame, unit: Sequence[str], arm: str, value: str) -> DataFrame:
    """Mean value of a unit's rows with a true and with a false ``arm``; units without either are left out."""
    side = lambda v: F.avg(F.when(F.col(arm) == v, F.col(value)))
    wide = rows.groupBy(*unit).agg(side(True).alias("correct"), side(False).alias("wrong"))
    return wide.where("correct is not null and wrong is not null")


def analysis_frame(traces: DataFrame, outcome: DataFrame, sources: DataFrame) -> DataFrame:
    """Traces (model, case_id, ...) with their case's source and how hard the case is for their model and for all.

    ``outcome`` has model, case_id, n_wrong, n_graded; traces without a row of it
    are left out. ``sources`` (case_id, source) may lack a case.
    """
    own = outcome.select("model", "case_id", F.try_divide("n_wrong", "n_graded").alias("wrong_frac"))
    hard = case_difficulty(outcome).select("case_id", "case_wrong_frac")
    return traces.join(sources.select("case_id", "source"), "case_id", "left").join(own, ["model", "case_id"]).join(hard, "case_id")


def describe(rows: DataFrame, value: str, by: Sequence[str], order: Column | None = None) -> DataFrame:
    """Size, mean, median and sample deviation of the values of each group."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.stddev_samp(value).alias("std"))


def shares(rows: DataFrame, by: Sequence[str], of: str) -> DataFrame:
    """How often each value occurs in its group, and its share."""
    counts = rows.groupBy(*by, of).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
