"""Curves over the boundaries of a trace: where they settle, and how they fall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .distributions import tvd

#: Shares of the total decline that drop widths ask for: fixed steps of 5 per cent.
DROP_FRACTIONS = tuple(round(0.05 * k, 2) for k in range(1, 21))


def forward_curve(pairs: DataFrame, band: tuple[int, int] = (1, 5)) -> DataFrame:
    """For each boundary but the last: its distances to all later ones.

    Returns trace_id, boundary_index, n_forward, tvd_max_forward,
    tvd_median_forward, tvd_next, within_band (all of them at most the band, told
    by whole numbers).
    """
    p, q = band
    return pairs.groupBy("trace_id", F.col("i").alias("boundary_index")).agg(
        F.count(F.lit(1)).alias("n_forward"),
        F.max(tvd()).alias("tvd_max_forward"),
        F.percentile(tvd(), F.lit(0.5)).alias("tvd_median_forward"),
        F.max(F.when(F.col("j") == F.col("i") + 1, tvd())).alias("tvd_next"),
        F.bool_and(q * F.col("num") <= p * F.col("den")).alias("within_band"),
    )


def commitment(curve: DataFrame, last: DataFrame, fallback: str = "null") -> DataFrame:
    """First boundary from which the curve is within the band, or ``fallback``: null, or the last boundary.

    ``last`` has trace_id and last_boundary of every trace.
    """
    if fallback not in ("null", "last"):
        raise ValueError(f"unknown fallback {fallback!r}")
    found = curve.groupBy("trace_id").agg(F.min(F.when(F.col("within_band"), F.col("boundary_index"))).alias("commit_boundary"))
    joined = last.join(found, "trace_id", "left")
    return joined.withColumn("commit_boundary", F.coalesce("commit_boundary", "last_boundary")) if fallback == "last" else joined


def base_share(samples: DataFrame, base: DataFrame) -> DataFrame:
    """Share of each boundary's samples that have the trace's base entity."""
    return samples.join(base, "trace_id").groupBy("trace_id", "boundary_index").agg(F.avg((F.col("entity") == F.col("base_entity")).cast("double")).alias("share"))


def convergence_index(curve: DataFrame, value: str, band: float = 0.2) -> DataFrame:
    """First boundary that no later value leaves by more than ``band``.

    The largest and least of the values from a boundary on are running windows
    from the end; their differences to the value are those a loop would compare.
    """
    ahead = Window.partitionBy("trace_id").orderBy("boundary_index").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    v = F.col(value)
    calm = (F.max(v).over(ahead) - v <= band) & (v - F.min(v).over(ahead) <= band)
    return curve.withColumn("calm", calm).groupBy("trace_id").agg(F.min(F.when(F.col("calm"), F.col("boundary_index"))).alias("convergence_boundary"))


def strict_convergence_index(curve: DataFrame, value: str, band: float = 0.2) -> DataFrame:
    """First boundary from which all values lie within one band of width ``band``."""
    ahead = Window.partitionBy("trace_id").orderBy("boundary_index").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    calm = F.max(value).over(ahead) - F.min(value).over(ahead) <= band
    return curve.withColumn("calm", calm).groupBy("trace_id").agg(F.min(F.when(F.col("calm"), F.col("boundary_index"))).alias("convergence_boundary"))


def drops(curve: DataFrame) -> DataFrame:
    """Fall of the curve at each sentence: from its boundary to the next. The last boundary of a curve has none."""
    following = F.lead("tvd_max_forward").over(Window.partitionBy("trace_id").orderBy("boundary_index"))
    rows = curve.withColumn("tvd_after", following).where("tvd_after is not null")
    return rows.select("trace_id", F.col("boundary_index").alias("sentence_index"), F.col("tvd_max_forward").alias("tvd_before"), "tvd_after", (F.col("tvd_max_forward") - F.col("tvd_after")).alias("tvd_drop"))


def drop_widths(curve: DataFrame, commits: DataFrame, depth: Column, fractions: Sequence[float] = DROP_FRACTIONS) -> DataFrame:
    """How far back from commitment each share of the decline reaches.

    The window ends at the commitment; it starts at the last boundary that is
    still so much of the decline above it. Traces that commit at once, never, or
    whose curve does not fall have no rows.
    """
    joined = curve.join(commits.where("commit_boundary > 0"), "trace_id").where("boundary_index <= commit_boundary").withColumn("depth", depth)
    whole = Window.partitionBy("trace_id")
    at = lambda c, k: F.max(F.when(F.col("boundary_index") == k, F.col(c))).over(whole)
    commit = F.col("commit_boundary")
    rows = joined.withColumns({"v0": at("tvd_max_forward", F.lit(0)), "vc": at("tvd_max_forward", commit), "d0": at("depth", F.lit(0)), "dc": at("depth", commit)}).where("v0 - vc > 0")
    reached = F.try_divide(F.col("tvd_max_forward") - F.col("vc"), F.col("v0") - F.col("vc"))
    asked = rows.withColumn("drop_fraction", F.explode(F.array(*map(F.lit, fractions)))).where(reached >= F.col("drop_fraction") - 1e-12)
    found = asked.groupBy("trace_id", "drop_fraction", "d0", "dc").agg(F.max(F.struct("boundary_index", "depth")).alias("a"))
    width, span = F.col("dc") - F.col("a.depth"), F.col("dc") - F.col("d0")
    return found.select("trace_id", "drop_fraction", width.alias("width"), F.when(span > 0, F.try_divide(width, span)).alias("width_of_descent"))


def interpolated(curve: DataFrame, x: str, y: str, steps: int = 40) -> DataFrame:
    """Each trace's curve on the grid 0, 1/steps, ..., 1, linear between its points and held at its ends."""
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: k / steps)).alias("g")
    points = curve.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).alias("points"))
    rows = points.select("trace_id", "points", grid)
    rows = rows.withColumns({"low": F.try_element_at(F.filter("points", lambda p: p["x"] <= F.col("g")), F.lit(-1)), "high": F.try_element_at(F.filter("points", lambda p: p["x"] >= F.col("g")), F.lit(1))})
    part = F.try_divide(F.col("g") - F.col("low.x"), F.col("high.x") - F.col("low.x"))
    value = (
        F.when(F.col("low").isNull(), F.col("high.y"))
        .when(F.col("high").isNull(), F.col("low.y"))
        .when(F.col("high.x") == F.col("low.x"), F.col("low.y"))
        .otherwise(F.col("low.y") + part * (F.col("high.y") - F.col("low.y")))
    )
    return rows.select("trace_id", "g", value.alias("value"))


def mean_curve(rows: DataFrame, by: Sequence[str], x: str, value: str, least: int = 5) -> DataFrame:
    """Mean, median and standard error of the values at each x that has ``least`` of them; the error of one is 0."""
    return (
        rows.groupBy(*by, x)
        .agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.coalesce(F.stddev_samp(value) / F.sqrt(F.count(value)), F.lit(0.0)).alias("se"))
        .where(F.col("n") >= least)
    )
