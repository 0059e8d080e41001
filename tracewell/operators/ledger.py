"""What has been sampled, what is owed, and what must be there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def progress(samples: DataFrame) -> DataFrame:
    """Samples of each boundary, and the number that the next one gets."""
    return samples.groupBy("trace_id", "boundary_index").agg(F.count(F.lit(1)).alias("have"), (F.max("rollout_index") + 1).alias("next_index"))


def pending(traces: DataFrame, done: DataFrame, wanted: int) -> DataFrame:
    """Boundaries 0 to last_boundary that are short of ``wanted`` samples, and by how many."""
    spine = traces.select("trace_id", F.explode(F.sequence(F.lit(0), F.col("last_boundary"))).alias("boundary_index"))
    rows = spine.join(done, ["trace_id", "boundary_index"], "left")
    owed = wanted - F.coalesce("have", F.lit(0))
    return rows.where(owed > 0).select("trace_id", "boundary_index", owed.alias("owed"), F.coalesce("next_index", F.lit(0)).alias("first_index"))


def missing(wanted: DataFrame, there: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``wanted`` whose keys ``there`` does not have."""
    return wanted.join(there.select(*keys).distinct(), list(keys), "left_anti")


def require(wanted: DataFrame, there: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """``wanted``, if all its keys are there."""
    lacking = missing(wanted, there, keys)
    if n := lacking.count():
        raise ValueError(f"{n} rows lack {what}, such as {[tuple(r) for r in lacking.select(*keys).limit(3).collect()]}")
    return wanted


def in_order(records: DataFrame, wanted: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Records of the wanted keys (key, place), the first of each key, in the wanted order; all must be there."""
    first = records.withColumn("_turn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_turn = 1").drop("_turn")
    return require(wanted, first, [key], "a record").join(first, key).orderBy("place")


def oversized(traces: DataFrame, most_sentences: int) -> tuple[DataFrame, DataFrame]:
    """Traces within the cap, and a skip log of the others."""
    over = F.col("n_sentences") > most_sentences
    reason = F.concat(F.col("n_sentences").cast("string"), F.lit(f" sentences, more than {most_sentences}"))
    return traces.where(~over), traces.where(over).select("trace_id", reason.alias("reason"))


def fits_context(prefixes: DataFrame, context: int, headroom: int = 256) -> DataFrame:
    """Prefixes that leave room for an answer."""
    return prefixes.where(F.col("prefix_token_count") + headroom <= context)


def sample_rows(completions: DataFrame) -> DataFrame:
    """One row per completion of a request: its number goes on from first_index."""
    return completions.select("*", F.posexplode("completions").alias("at", "continuation")).withColumn("rollout_index", F.col("first_index") + F.col("at")).drop("completions", "at")
