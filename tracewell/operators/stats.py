"""Statistics of hypothesis tests as aggregates; probabilities are for the few rows that come out."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import probability
from .ranking import average_rank, numbered


def _pairs(groups: DataFrame, by: str) -> DataFrame:
    """Every two groups of a table of groups, the lesser name first."""
    names = [c for c in groups.columns if c != by]
    left = groups.select(F.col(by).alias("a"), *[F.col(c).alias(f"{c}_a") for c in names])
    right = groups.select(F.col(by).alias("b"), *[F.col(c).alias(f"{c}_b") for c in names])
    return left.join(right, F.col("a") < F.col("b"))


def welch(df: DataFrame, by: str, value: str) -> DataFrame:
    """Welch's t and degrees of freedom of every two groups."""
    groups = df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
    u, v = F.try_divide("var_a", "n_a"), F.try_divide("var_b", "n_b")
    t = F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(u + v))
    freedom = F.try_divide((u + v) * (u + v), F.try_divide(u * u, F.col("n_a") - 1) + F.try_divide(v * v, F.col("n_b") - 1))
    return _pairs(groups, by).select("a", "b", "n_a", "n_b", t.alias("t"), freedom.alias("df"))


def mann_whitney(df: DataFrame, by: str, value: str, within: Sequence[str] = ()) -> DataFrame:
    """U of the first of every two groups, and its z with corrections for ties and continuity, in each family of ``within``.

    Counts of each value are met with each other group's, so no pair of rows is made.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*within, by, value).agg(F.count(F.lit(1)).alias("c"))
    members = _pairs(df.select(by).distinct(), by).select("a", "b", F.explode(F.array("a", "b")).alias(by))
    stacked = counts.join(members, by)
    family = [*within, "a", "b"]
    cells = stacked.groupBy(*family, value).agg(F.sum(F.when(F.col(by) == F.col("a"), F.col("c")).otherwise(0)).alias("ca"), F.sum(F.when(F.col(by) == F.col("b"), F.col("c")).otherwise(0)).alias("cb"))
    below = Window.partitionBy(*family).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("under", F.coalesce(F.sum("cb").over(below), F.lit(0)))
    both = F.col("ca") + F.col("cb")
    rows = cells.groupBy(*family).agg(
        F.sum("ca").alias("n_a"), F.sum("cb").alias("n_b"), F.sum(F.col("ca") * (F.col("under") + F.col("cb") / 2.0)).alias("u"), F.sum((both * both * both - both).cast("double")).alias("ties")
    )
    n = F.col("n_a") + F.col("n_b")
    spread = F.sqrt(F.col("n_a") * F.col("n_b") / 12.0 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    off = F.greatest(F.abs(F.col("u") - F.col("n_a") * F.col("n_b") / 2.0) - 0.5, F.lit(0.0))
    return rows.select(*family, "n_a", "n_b", "u", F.try_divide(off, spread).alias("z"))


def kruskal(df: DataFrame, by: str, value: str, least: int = 5) -> DataFrame:
    """H with tie correction over the groups of at least ``least`` rows, and its degrees of freedom: one row.

    Ranks are those of distinct values, so only their counts are ordered.
    """
    rows = df.where(F.col(value).isNotNull())
    large = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    cells = rows.join(large, by).groupBy(by, value).agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"))
    ties = cells.groupBy(value).agg(F.sum("_c").alias("_ties"))
    ranks = numbered(ties, [value], "_under", "_ties").withColumn("_rank", F.col("_under") + (F.col("_ties") + 1) / 2)
    sums = cells.join(ranks.select(value, "_rank"), value).groupBy(by).agg(F.max("_n").alias("n"), F.sum(F.col("_c") * F.col("_rank")).alias("r"))
    t = F.col("_ties").cast("double")
    whole = ties.agg(F.sum("_ties").cast("double").alias("all"), F.sum(t * t * t - t).alias("t"))  # one row
    n = F.max("all")
    h = 12.0 / (n * (n + 1)) * F.sum(F.col("r") * F.col("r") / F.col("n")) - 3 * (n + 1)
    return sums.join(F.broadcast(whole)).agg(F.try_divide(h, 1 - F.try_divide(F.max("t"), n * n * n - n)).alias("h"), (F.count(F.lit(1)) - 1).alias("df"))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation of average ranks, with the number of pairs and its t; both are NaN where x or y has one value only."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"_x": average_rank(x, by), "_y": average_rank(y, by)})
    spread = F.sqrt(F.var_pop("_x") * F.var_pop("_y"))  # corr fails where it is 0
    rho = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.try_divide(F.covar_pop("_x", "_y"), spread), F.lit(float("nan"))).alias("rho"))
    return rho.withColumn("t", F.col("rho") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("rho") * F.col("rho"))))


def wilcoxon(df: DataFrame, difference: Column, by: Sequence[str] = ()) -> DataFrame:
    """Signed-rank sums of differences other than zero, and z with tie correction."""
    rows = df.withColumn("_d", difference).where("_d <> 0").withColumn("_m", F.abs("_d"))
    rows = rows.withColumns({"_rank": average_rank("_m", by), "_ties": F.count(F.lit(1)).over(Window.partitionBy(*by, "_m"))})
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("_d") > 0, F.col("_rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("_d") < 0, F.col("_rank")).otherwise(0.0)).alias("w_minus"), F.sum((F.col("_ties") * F.col("_ties") - 1).cast("double")).alias("t")
    )
    n, w = F.col("n"), F.least("w_plus", "w_minus")
    z = F.try_divide(w - n * (n + 1) / 4.0, F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("t") / 48.0))
    return sums.select(*by, "n", "w_plus", "w_minus", w.alias("w"), z.alias("z"))


def one_sample(df: DataFrame, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """t of the mean against 0."""
    rows = df.withColumn("_v", value)
    return rows.groupBy(*by).agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.try_divide(F.avg("_v"), F.try_divide(F.stddev_samp("_v"), F.sqrt(F.count("_v")))).alias("t"))


def within(df: DataFrame, unit: str, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least squares of y on x within units, with errors clustered by unit.

    Both are taken from their unit's means. The variance is that of a fit with one
    constant for each unit: G / (G - 1) * (N - 1) / (N - 1 - G) times the sandwich.
    """
    group = Window.partitionBy(*by, unit)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"_x": F.col(x) - F.avg(x).over(group), "_y": F.col(y) - F.avg(y).over(group)})
    whole = Window.partitionBy(*by)
    units = rows.groupBy(*by, unit).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_x") * F.col("_x")).alias("xx"), F.sum(F.col("_x") * F.col("_y")).alias("xy"))
    units = units.withColumn("beta", F.try_divide(F.sum("xy").over(whole), F.sum("xx").over(whole)))
    score = F.col("xy") - F.col("beta") * F.col("xx")
    sums = units.groupBy(*by).agg(F.max("beta").alias("beta"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("units"), F.sum(score * score).alias("meat"), F.sum("xx").alias("bread"))
    n, g = F.col("n"), F.col("units")
    scale = F.try_divide(g, g - 1) * F.try_divide(n - 1, n - 1 - g)
    return sums.select(*by, "beta", F.try_divide(F.sqrt(F.col("meat") * scale), F.col("bread")).alias("se"), "n", "units")


def within_two(df: DataFrame, unit: str, x1: str, x2: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """The same with two regressors: both coefficients."""
    group = Window.partitionBy(*by, unit)
    names = {"_a": x1, "_b": x2, "_y": y}
    rows = df.withColumns({k: F.col(v) - F.avg(v).over(group) for k, v in names.items()})
    s = lambda u, v: F.sum(F.col(u) * F.col(v))
    det = s("_a", "_a") * s("_b", "_b") - s("_a", "_b") * s("_a", "_b")
    return rows.groupBy(*by).agg(F.try_divide(s("_a", "_y") * s("_b", "_b") - s("_b", "_y") * s("_a", "_b"), det).alias("beta_1"), F.try_divide(s("_b", "_y") * s("_a", "_a") - s("_a", "_y") * s("_a", "_b"), det).alias("beta_2"), F.count(F.lit(1)).alias("n"))


@F.pandas_udf(DoubleType())
def t_probability(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else probability.t_two_sided(a, b) for a, b in zip(t, df, strict=True)])


@F.pandas_udf(DoubleType())
def normal_probability(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else probability.normal_two_sided(v))


@F.pandas_udf(DoubleType())
def chi2_probability(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else probability.chi2_upper(a, b) for a, b in zip(x, df, strict=True)])
