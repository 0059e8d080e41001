"""From sources to cases, from cases to a pool, from screened samples to a selection."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import ranking


def cases(source: DataFrame, order: Sequence[str], content: str = "text", answer: str | None = None) -> DataFrame:
    """Cases of sources: blank texts dropped, the first of each text within a source kept, texts verbatim, answers stripped."""
    rows = source.where(~text.is_blank(F.col(content))).withColumn("case_id", text.letters_id(F.col(content)))
    first = ranking.keep_first(rows, ["source", "case_id"], order)
    return first.withColumn(answer, text.stripped(F.col(answer))) if answer else first


def together(parts: Sequence[DataFrame]) -> DataFrame:
    """Sources one after another, with their place in ``source_ord``; equal cases of different sources stay."""
    out = parts[0].withColumn("source_ord", F.lit(0))
    for n, part in enumerate(parts[1:], 1):
        out = out.unionByName(part.withColumn("source_ord", F.lit(n)))
    return out


def expect(df: DataFrame, counts: dict[str, int] | None = None, total: int | None = None) -> DataFrame:
    """``df``, if its sources have the expected numbers of rows."""
    found = {r["source"]: r["n"] for r in df.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    wrong = {s: (n, found.get(s, 0)) for s, n in (counts or {}).items() if found.get(s, 0) != n}
    if wrong or total is not None and sum(found.values()) != total:
        raise ValueError(f"expected and found counts differ: {wrong or (total, sum(found.values()))}")
    return df


def quotas(available: DataFrame, total: int) -> DataFrame:
    """Cases to take from each source (source, available), as even as sizes allow.

    By size, a source gives all it has while that is within an even share of
    what is left; the others share the rest, its remainder by name.
    """
    by_size = Window.orderBy("available", "source")
    before = by_size.rowsBetween(Window.unboundedPreceding, -1)
    rows = available.withColumns({"taken": F.coalesce(F.sum("available").over(before), F.lit(0)), "left": F.count(F.lit(1)).over(Window.partitionBy()) - F.row_number().over(by_size) + 1})
    rows = rows.withColumn("whole", F.col("available") <= F.floor((total - F.col("taken")) / F.col("left")))
    everything = Window.partitionBy("whole")
    rest = total - F.coalesce(F.sum(F.when(F.col("whole"), F.col("available"))).over(Window.partitionBy()), F.lit(0))
    n = F.count(F.lit(1)).over(everything)
    turn = F.row_number().over(everything.orderBy("source")) - 1
    share = F.floor(rest / n)
    quota = F.when(F.col("whole"), F.col("available")).otherwise(share + F.when(turn < rest - share * n, 1).otherwise(0))
    return rows.select("source", "available", quota.cast("long").alias("quota"))


def draw(cases: DataFrame, quota: DataFrame, seed: str) -> DataFrame:
    """So many cases of each source, those of least hash of seed and id."""
    order = Window.partitionBy("source").orderBy(F.sha2(F.concat_ws(":", F.lit(seed), "case_id"), 256), "case_id")
    return cases.withColumn("_turn", F.row_number().over(order)).join(quota.select("source", "quota"), "source").where(F.col("_turn") <= F.col("quota")).drop("_turn", "quota")


def id_digest(ids: DataFrame, name: str = "case_id", most: int = 1_000_000) -> DataFrame:
    """First 16 hex digits of the SHA-256 of all ids in order, comma-joined: one row.

    The digest reads the ids one after another, so it is for pools, which a quota
    bounds; more than ``most`` ids raise an error.
    """
    some = ids.select(name).limit(most + 1)
    whole = F.when(F.count(F.lit(1)) <= most, F.array_join(F.array_sort(F.collect_list(name)), ",")).otherwise(F.raise_error(F.lit(f"a pool has at most {most} ids")))
    return some.agg(F.substring(F.sha2(whole, 256), 1, 16).alias("digest"))


def seeded_draw(cases: DataFrame, quota: DataFrame, seed: int, most: int = 1_000_000) -> DataFrame:
    """The draw of Python's generator: one ``random.Random(seed)`` samples from each source's sorted ids, sources in order of name.

    For pools that the driver can hold, of ``most`` cases at most (ValueError
    beyond); :func:`draw` is the one for any size. Returns source, case_id.
    """
    rows = cases.select("source", "case_id").join(quota.select("source", "quota"), "source").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} cases; use draw")
    by_source: dict[str, tuple[int, list[str]]] = {}
    for r in rows:
        by_source.setdefault(r.source, (r.quota, []))[1].append(r.case_id)
    dice = random.Random(seed)
    taken = [(source, case) for source, (n, ids) in sorted(by_source.items()) for case in sorted(dice.sample(sorted(ids), n))]
    return cases.sparkSession.createDataFrame(taken, cases.select("source", "case_id").schema)


def outcomes(judged: DataFrame) -> DataFrame:
    """Each model's judged samples of a case: numbers right and wrong, and the first of either. Unjudged ones are left out."""
    right = F.col("is_correct")
    return judged.where(right.isNotNull()).groupBy("model", "case_id").agg(
        F.count_if(right).alias("n_correct"), F.count_if(~right).alias("n_wrong"), F.count(F.lit(1)).alias("n_graded"),
        F.min(F.when(right, F.col("rollout_index"))).alias("correct_index"), F.min(F.when(~right, F.col("rollout_index"))).alias("wrong_index"),
    )


def select(outcome: DataFrame, core_min: int = 6, floor: int = 40, min_each: int = 1, exclude: DataFrame | None = None) -> DataFrame:
    """Cases to sweep in each model.

    A case qualifies with ``min_each`` right and wrong samples; its depth is the
    number of models that it qualifies for. Those of depth ``core_min`` are taken
    in all of these; a model below ``floor`` takes its own deepest others up to it.
    """
    fits = outcome.where((F.col("n_correct") >= min_each) & (F.col("n_wrong") >= min_each))
    if exclude is not None:
        fits = fits.join(exclude.select("case_id").distinct(), "case_id", "left_anti")
    fits = fits.withColumn("depth", F.count(F.lit(1)).over(Window.partitionBy("case_id"))).withColumn("in_core", F.col("depth") >= core_min)
    model = Window.partitionBy("model")
    turn = F.row_number().over(Window.partitionBy("model", "in_core").orderBy(F.desc("depth"), "case_id"))
    rows = fits.withColumns({"turn": turn, "n_core": F.sum(F.col("in_core").cast("int")).over(model)})
    return rows.where(F.col("in_core") | (F.col("turn") <= floor - F.col("n_core"))).drop("turn", "n_core")


def modal_share(answers: DataFrame) -> DataFrame:
    """Share of the most frequent answer and number of answers of a case, averaged over models."""
    counts = answers.groupBy("model", "case_id", "entity").agg(F.count(F.lit(1)).alias("c"))
    each = counts.groupBy("model", "case_id").agg((F.max("c") / F.sum("c")).alias("share"), F.count(F.lit(1)).alias("n"))
    return each.groupBy("case_id").agg(F.avg("share").alias("modal_share"), F.avg("n").alias("n_entities"), F.count(F.lit(1)).alias("n_models"))


def entity_or_answer(entity: Column, answer: Column) -> Column:
    """The judged entity, or the answer as it stands where none was judged."""
    return F.coalesce(F.when(entity != "", entity), answer)


def capped(samples: DataFrame, cap: int) -> DataFrame:
    """Cases with a sample that ran into the token cap."""
    return samples.where((F.col("finish_reason") == "length") | (F.col("n_tokens") >= cap)).select("case_id").distinct()


def first_seen(answers: DataFrame, order: Sequence[str]) -> DataFrame:
    """Distinct stripped answers of each case with counts, in order of first sight."""
    rows = answers.withColumn("answer", text.stripped(F.col("answer"))).where("coalesce(answer, '') <> ''")
    found = rows.groupBy("case_id", "answer").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("_first"))
    return found.withColumn("seen", F.row_number().over(Window.partitionBy("case_id").orderBy("_first", "answer"))).drop("_first")


def exact_entities(answers: DataFrame) -> DataFrame:
    """Answers of :func:`first_seen` that agree without case and marks, under the one seen first."""
    key = text.loosely_normalised(F.col("answer"))
    return answers.withColumn("entity", F.first("answer").over(Window.partitionBy("case_id", key).orderBy("seen")))
