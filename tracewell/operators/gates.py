"""Which traces an analysis keeps, and why it drops the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def thin_gate(sizes: DataFrame, last: DataFrame, more_than: int = 10) -> DataFrame:
    """Traces of which every boundary from 0 to last_boundary is there with more than so many samples."""
    rows = sizes.join(last, "trace_id").where("boundary_index between 0 and last_boundary")
    kept = rows.groupBy("trace_id", "last_boundary").agg(F.count_distinct("boundary_index").alias("present"), F.min("n").alias("least"))
    return kept.where((F.col("present") == F.col("last_boundary") + 1) & (F.col("least") > more_than)).select("trace_id")


def base_entity(traces: DataFrame, grades: DataFrame) -> DataFrame:
    """The traces with the entity of their own answer; those without answer or entity are dropped."""
    known = grades.where("coalesce(canonical, '') <> ''").select("case_id", F.col("raw_answer").alias("_answer"), F.col("canonical").alias("base_entity"))
    same = (traces["case_id"] == known["case_id"]) & (traces["raw_answer"] == known["_answer"])
    return traces.where("coalesce(raw_answer, '') <> ''").join(known, same).drop(known["case_id"]).drop("_answer")


def status(has_base: Column, thin: Column, commit: Column, falls: Column) -> Column:
    """The first reason that holds, in the gates' order."""
    return (
        F.when(~has_base, "no_base_entity").when(thin, "thin_boundary").when(commit.isNull(), "never_committed").when(commit == 0, "committed_at_zero").when(~falls, "no_descent").otherwise("retained")
    )


def tally(rows: DataFrame, reason: str, by: str | None = None) -> DataFrame:
    """Traces for each reason."""
    return rows.groupBy(*([by] if by else []), reason).agg(F.count(F.lit(1)).alias("traces"))


def banded(value: Column, edges: tuple[float, ...], right_open: bool = True) -> Column:
    """Index of the band of edges that holds the value; null outside."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(edges) - 1)):
        inside = (value >= edges[k]) & (value < edges[k + 1]) if right_open else (value > edges[k]) & (value <= edges[k + 1])
        out = F.when(inside, k).otherwise(out)
    return out


def depth_bin(depth: Column) -> Column:
    return F.when(depth < 0.25, "<.25").when(depth < 0.5, "<.5").when(depth < 0.75, "<.75").otherwise("else")


def stars(p: Column, none: str = "") -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise(none)


def sentence_kind(first: Column, repeat: Column, other: Column) -> Column:
    return F.when(first, "first").when(repeat, "repeat").when(other, "other").otherwise("none")
