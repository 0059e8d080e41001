"""Histograms of categorical answers, and distances between them.

Distances use whole counts up to the last step, so that a distance that equals a
band is told exactly: TVD(p, q) = 1 - sum of min(c * m, d * n) / (n * m) for
counts c of n and d of m.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP = ("trace_id", "boundary_index")


def histogram(samples: DataFrame, by: Sequence[str] = GROUP, entity: str = "entity") -> DataFrame:
    """Count c of each entity in each group; null and empty entities are dropped."""
    return samples.where(F.coalesce(F.col(entity), F.lit("")) != "").groupBy(*by, F.col(entity).alias("entity")).agg(F.count(F.lit(1)).alias("c"))


def histogram_map(hist: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """Each group's histogram as one map, its keys in order."""
    return hist.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity", "c")))).alias("counts"))


def sizes(hist: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    return hist.groupBy(*by).agg(F.sum("c").alias("n"))


def forward_pairs(hist: DataFrame) -> DataFrame:
    """Exact distances of all boundary pairs i < j of a trace: trace_id, i, j, num, den.

    The histogram meets itself on trace and entity only. A boundary also carries
    one empty marker of count 0, so that pairs without a common entity are there
    as well. Work is pairs times common entities, whatever the vocabulary. Both
    sides are the same plan under two names, so that their exchange is made once.
    """
    boundaries = hist.groupBy("trace_id", "boundary_index").agg(F.sum("c").alias("n"), F.collect_list(F.struct("entity", "c")).alias("cells"))
    marker = F.array(F.struct(F.lit("").alias("entity"), F.lit(0).cast("long").alias("c")))
    cells = boundaries.select("trace_id", "boundary_index", "n", F.explode(F.concat("cells", marker)).alias("cell")).select("trace_id", "boundary_index", "n", "cell.entity", "cell.c")
    x, y = cells.alias("x"), cells.alias("y")
    met = x.join(y, (F.col("x.trace_id") == F.col("y.trace_id")) & (F.col("x.entity") == F.col("y.entity")) & (F.col("x.boundary_index") < F.col("y.boundary_index")))
    shared = met.groupBy(F.col("x.trace_id"), F.col("x.boundary_index").alias("i"), F.col("y.boundary_index").alias("j"), F.col("x.n").alias("ni"), F.col("y.n").alias("nj")).agg(
        F.sum(F.least(F.col("x.c") * F.col("y.n"), F.col("y.c") * F.col("x.n"))).alias("shared")
    )
    size = F.col("ni") * F.col("nj")
    return shared.select("trace_id", "i", "j", (size - F.col("shared")).alias("num"), size.alias("den"))


def tvd() -> Column:
    return F.col("num") / F.col("den")


def two_arms(samples: DataFrame, by: Sequence[str], arm: str, first: str, second: str) -> DataFrame:
    """Counts of both arms side by side on their union of entities: by, entity, p, q, and sizes n, m."""
    counts = histogram(samples, [*by, arm]).groupBy(*by, "entity").agg(
        F.coalesce(F.sum(F.when(F.col(arm) == first, F.col("c"))), F.lit(0)).alias("p"), F.coalesce(F.sum(F.when(F.col(arm) == second, F.col("c"))), F.lit(0)).alias("q")
    )
    group = Window.partitionBy(*by)
    return counts.where("p > 0 or q > 0").withColumns({"n": F.sum("p").over(group), "m": F.sum("q").over(group)})


def both_filled(value: Column) -> Column:
    """Null where an arm is empty."""
    return F.when((F.max("n") > 0) & (F.max("m") > 0), value)


def arm_tvd() -> Column:
    """Total variation distance of the arms of :func:`two_arms`, as an aggregate."""
    return both_filled(1 - F.try_divide(F.sum(F.least(F.col("p") * F.col("m"), F.col("q") * F.col("n"))), F.max("n") * F.max("m")))


def smoothed_kl(p: str, q: str, n: str, m: str, alpha: float = 0.5, support: Column | None = None) -> Column:
    """KL divergence in bits of the arms' counts, each with ``alpha`` added, as an aggregate.

    The support is the union of both arms, or a fixed vocabulary of size
    ``support`` that holds it: entities in neither arm then add to the masses alone.
    """
    k = F.count(F.lit(1)) if support is None else support
    mass_p, mass_q = F.max(n) + alpha * k, F.max(m) + alpha * k
    own = F.sum((F.col(p) + alpha) * F.log2((F.col(p) + alpha) / (F.col(q) + alpha))) / mass_p
    return both_filled(own + F.log2(mass_q / mass_p))


def jensen_shannon() -> Column:
    """Jensen-Shannon divergence in bits of the arms of :func:`two_arms`, unsmoothed, as an aggregate."""
    p, q = F.try_divide("p", "n"), F.try_divide("q", "m")
    half = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
    return both_filled((F.sum(half(p)) + F.sum(half(q))) / 2)


def effective_answers(c: str = "c", n: str = "n") -> Column:
    """2 to the entropy in bits of the counts ``c`` of ``n``, as an aggregate; null for none."""
    share = F.col(c) / F.col(n)
    return F.when(F.sum(c) > 0, F.pow(F.lit(2.0), -F.sum(F.when(F.col(c) > 0, share * F.log2(share)).otherwise(0.0))))


def concentration(hist: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """How concentrated each group is: distinct entities, largest and second share, their sum, entities of a tenth and more, effective number."""
    group = Window.partitionBy(*by)
    ranked = hist.withColumns({"n": F.sum("c").over(group), "turn": F.row_number().over(group.orderBy(F.desc("c"), "entity"))})
    share = F.col("c") / F.col("n")
    at = lambda k: F.coalesce(F.max(F.when(F.col("turn") == k, share)), F.lit(0.0))
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_distinct"), at(1).alias("top_share"), at(2).alias("second_share"), (F.sum(F.when(F.col("turn") <= 2, F.col("c"))) / F.max("n")).alias("top_two_share"),
        F.count_if(10 * F.col("c") >= F.col("n")).alias("n_over_tenth"), effective_answers().alias("effective_n"),
    )


def matched_arms(samples: DataFrame, by: Sequence[str], arm: str, n: int, key: Column) -> DataFrame:
    """``n`` rows of each arm of the groups where every arm has so many, by the least hash of ``key``."""
    group = Window.partitionBy(*by, arm)
    drawn = samples.withColumns({"_n": F.count(F.lit(1)).over(group), "_turn": F.row_number().over(group.orderBy(F.sha2(key, 256), key))})
    fits = F.min("_n").over(Window.partitionBy(*by)) >= n
    return drawn.withColumn("_fits", fits).where(F.col("_fits") & (F.col("_turn") <= n)).drop("_n", "_turn", "_fits")


def cosine(a: str, b: str) -> Column:
    """Cosine of two array columns; null where one is missing or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.try_divide(dot(a, b), norms)
