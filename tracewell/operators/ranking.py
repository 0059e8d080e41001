"""Order statistics, ranks, and deterministic splits of ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordered(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    group = Window.partitionBy(*by)
    return df.where(F.col(value).isNotNull()).withColumns({"_n": F.count(F.lit(1)).over(group), "_turn": F.row_number().over(group.orderBy(value))})


def upper_median(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The value at n // 2 of n sorted ones, counted from 0: never between two."""
    return _ordered(df, by, value).where(F.col("_turn") == F.floor(F.col("_n") / 2) + 1).select(*by, F.col(value).alias("upper_median"))


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, share: float) -> DataFrame:
    """The value at min(n - 1, int(share * n)) of n sorted ones, counted from 0."""
    at = F.least(F.col("_n") - 1, F.floor(share * F.col("_n"))) + 1
    return _ordered(df, by, value).where(F.col("_turn") == at).select(*by, F.col(value).alias("nearest_rank"))


def average_rank(value: str, by: Sequence[str] = ()) -> Column:
    """Rank from 1, ties sharing their mean, as a window expression."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def _ranges(df: DataFrame, order: Sequence[str], sample: int = 8192) -> tuple[Column, int]:
    """A row's range of the order, and how many ranges there are: as many as shuffle partitions, of like size.

    The cuts come from the ``sample`` rows of least hash, so they are the same
    whenever the plan is run. Rows of equal order are in one range.
    """
    own = F.struct(*order)
    some = df.select(own.alias("_o")).orderBy(F.xxhash64("_o")).limit(sample)
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = some.schema["_o"].dataType
    found = [r._o for r in some.orderBy("_o").collect()]
    cuts = [found[i * len(found) // parts] for i in range(1, min(parts, len(found)))]

    def place(low: int, high: int) -> Column:  # a tree of comparisons
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        cut = F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(cuts[middle], kind.fields, strict=True)))
        return F.when(own < cut, place(low, middle)).otherwise(place(middle + 1, high))

    return place(0, len(cuts)), len(cuts) + 1


def numbered(df: DataFrame, order: Sequence[str], name: str, count: str | None = None) -> DataFrame:
    """``df`` with each row's number from 0 in a total order of the whole table, or the sum of column ``count`` before it.

    Ranges of the order are numbered apart and then moved by the rows of those
    before, so no task holds more than a range.
    """
    place, _ = _ranges(df, order)
    rows = df.withColumn("_range", place)
    size = F.count(F.lit(1)) if count is None else F.sum(count)
    sums = rows.groupBy("_range").agg(size.alias("_size"))  # a row for each shuffle partition at most
    before = sums.select("_range", F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*order)
    own = F.row_number().over(inside) - 1 if count is None else F.coalesce(F.sum(count).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with the rank of each value in the whole table, from 1, ties sharing their mean. Null values are left out."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_ties"))
    ranks = numbered(counts, [value], "_under", "_ties").select(value, (F.col("_under") + (F.col("_ties") + 1) / 2).alias(name))
    return df.join(ranks, value)


def adjust(df: DataFrame, p: str, by: Sequence[str] = (), name: str = "q") -> DataFrame:
    """``df`` with the Benjamini-Hochberg adjusted values of column ``p``; ties share theirs, null stays null.

    A value is the least of n p / rank over the values that are not smaller.
    Groups of ``by`` are families of tests and each in a task; without any, the
    whole table is ranked by ranges.
    """
    raw = lambda n, last: F.col(p) * n / last
    if by:
        group = Window.partitionBy(*by)
        last = F.count(p).over(group.orderBy(F.col(p).asc_nulls_last()))
        rows = df.withColumn("_raw", raw(F.count(p).over(group), last))
        low = F.min("_raw").over(group.orderBy(F.desc(p)))
        return rows.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), low))).drop("_raw")
    counts = df.where(F.col(p).isNotNull()).groupBy(p).agg(F.count(F.lit(1)).alias("_ties"))
    ranks = numbered(counts, [p], "_under", "_ties")
    whole = counts.agg(F.coalesce(F.sum("_ties"), F.lit(0)).alias("_n"))  # one row
    rows = ranks.join(F.broadcast(whole)).withColumn("_raw", raw(F.col("_n"), F.col("_under") + F.col("_ties")))
    place, _ = _ranges(counts, [p])
    rows = rows.withColumn("_range", place)
    later = rows.groupBy("_range").agg(F.min("_raw").alias("_low")).select("_range", F.min("_low").over(Window.orderBy("_range").rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    own = F.min("_raw").over(Window.partitionBy("_range").orderBy(F.desc(p)))
    found = rows.withColumn("_own", own).join(F.broadcast(later), "_range").select(F.col(p).alias("_p"), F.least(F.lit(1.0), "_own", "_later").alias(name))
    return df.join(found, F.col(p) == F.col("_p"), "left").drop("_p")


def keep_first(df: DataFrame, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_turn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_turn = 1").drop("_turn")


def strided_shard(df: DataFrame, order: Sequence[str], index: int, of: int) -> DataFrame:
    """Every ``of``-th row of a total order from the ``index``-th, counted from 1."""
    if not 1 <= index <= of:
        raise ValueError(f"shard {index} of {of}")
    return numbered(df, order, "_turn").where(F.col("_turn") % of == index - 1).drop("_turn")


def batch_number(by: Sequence[str], order: Sequence[str], size: int, strided: bool) -> Column:
    """Group of at most ``size`` rows in order: runs, or every so many-th row."""
    group = Window.partitionBy(*by)
    turn, n = F.row_number().over(group.orderBy(*order)) - 1, F.count(F.lit(1)).over(group)
    return (turn % F.ceil(n / size) if strided else F.floor(turn / size)).cast("int")


def spread_examples(sorted_others: Column, most: int = 3) -> Column:
    """Up to ``most`` entries evenly spaced over a sorted array, halves rounded to even."""
    n = F.size(sorted_others)
    at = lambda k: F.element_at(sorted_others, (F.bround(k * (n - 1) / F.lit(most - 1)) + 1).cast("int"))
    return F.when(n <= most, sorted_others).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), at))


def top_rows(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows of a total order."""
    return df.orderBy(*order).limit(n)
