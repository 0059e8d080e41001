"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Fixed pattern: a word is a run of anything but ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Targets of sources from ``sizes`` (source, source_size).

    Sources in order of code points, null last, take ``weights`` in turn and
    share the sum of all sizes by weight. No target passes ``most`` times its
    source's size; what is over goes to the others by weight, until none is
    above. Sources that stop there are those of least ``size / weight``, up to
    the point where the level reached by the rest is below their own: sums
    from that order's start give it without repeated rounds. Past that point the
    level so computed falls, so the rest's is the largest.

    Returns source, source_size, target, rate (target over size; 0 for size 0).
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    full = (
        weighed.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("heavy", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("spare", F.col("total") - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("stops", most * F.col("source_size") * F.col("heavy") <= F.col("weight") * F.col("spare"))
    )
    level = full.withColumn("level", F.max(F.when(~F.col("stops"), F.col("spare") / F.col("heavy"))).over(everything))
    target = F.when(F.col("stops"), (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.col("level"))
    rate = F.when(F.col("source_size") == 0, 0.0).when(F.col("stops"), F.lit(float(most))).otherwise(F.col("target") / F.col("source_size"))
    return level.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


def copies(rate: Column, doc_id: Column, seed: str) -> Column:
    """floor(rate) and one more with the fraction's probability, by a hash of seed and id."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _with_copies(sizes: DataFrame, rows: DataFrame, weights: tuple[int, ...], most: int, seed: str) -> DataFrame:
    """``rows`` (doc_id, source and others) with their source's size, target, rate and the copies to take."""
    targets = source_targets(sizes, weights, most).withColumnRenamed("source", "of_source")
    joined = rows.join(targets, F.col("source").eqNullSafe(F.col("of_source")), "inner").drop("of_source")
    return joined.withColumn("copies", copies(F.col("rate"), F.col("doc_id"), seed))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """How often the mix takes each document.

    Returns, per row of ``docs``: doc_id, source, size (its words), source_size,
    target, rate, copies. :func:`emit` gives the rows themselves.

    Null texts have size 0; the null source is a source, last in order. Rows of
    one id share its draw, and null ids one draw. A source without words has
    target 0 and gives no copies. Other columns are left out. An empty table
    gives an empty one. Only the sum for each source is shuffled, and the few
    sources come back by a join that Spark may broadcast by their measured size;
    it splits a hot source otherwise. Texts are read once: ids, sources and sizes
    are kept in the shared folder.
    """
    rows = checkpointed(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return _with_copies(rows.groupBy("source").agg(F.sum("size").alias("source_size")), rows, weights, most, seed)


def emit(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as :func:`mixed` says."""
    rows = docs.select("doc_id", "source", F.struct(*docs.columns).alias("row"))
    sizes = docs.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"))
    taken = _with_copies(sizes, rows, weights, most, seed).where("copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("time")).select("row.*")
