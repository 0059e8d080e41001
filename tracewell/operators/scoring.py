"""From samples to scores: what each answered, and how near its first sentence is to the one it replaces."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import answers, sentences, text

#: Fixed value: the opening of a sample that ran into the token cap is no sentence beyond so many characters.
LONGEST_OPENING = 8000

#: Columns of a score.
COLUMNS = ("case_id", "trace_id", "boundary_index", "rollout_index", "raw_answer", "bucket", "is_correct", "first_sentence", "similarity", "finish_reason", "valid")


def removed_sentence(sentence_texts: Column, boundary_index: Column) -> Column:
    """The sentence that sampling from a boundary leaves out; the last boundary leaves out none: ''."""
    return F.coalesce(F.get(sentence_texts, boundary_index), F.lit(""))


def is_withheld(finish_reason: Column, opening: Column) -> Column:
    """Whether a sample's opening is a loop that no encoder takes: it hit the cap and is longer than a sentence."""
    return (finish_reason == "length") & (F.length(opening) > LONGEST_OPENING)


def is_valid(bucket: Column, finish_reason: Column) -> Column:
    """A sample counts if it has an answer and ended by itself."""
    return F.coalesce(bucket.isNotNull() & (finish_reason == "stop"), F.lit(False))


def score_rollouts(
    rollouts: DataFrame, traces: DataFrame, similarity: Callable[[pd.Series, pd.Series], pd.Series], readers: Sequence[str] = (), rules: str = "clinical",
    bucket: Callable[[Column], Column] | None = None, is_correct: Callable[[DataFrame], Column] | None = None,
) -> DataFrame:
    """Scores of samples, in the columns of :data:`COLUMNS`.

    ``rollouts`` has case_id, trace_id, boundary_index, rollout_index, continuation
    and finish_reason; ``traces`` has trace_id and sentences (texts). The answer is
    read by :func:`.answers.read_answers`; ``bucket`` makes its name under which
    equal answers count (normalised by default), null for none. ``similarity``
    gets the removed and the first sentences of some rows and gives their
    similarity, NaN for none; pairs with an empty side, and those of openings that
    are withheld, don't reach it and have none. ``is_correct`` is a verdict on a
    row, null where there is none.

    A sample of a trace that isn't there is an error. Null and empty continuations
    have no answer, no first sentence and aren't valid.
    """
    known = traces.select("trace_id", "sentences", F.lit(True).alias("_known"))
    rows = rollouts.join(known, "trace_id", "left").withColumn("_known", F.coalesce("_known", F.raise_error(F.concat(F.lit("no trace "), F.coalesce("trace_id", F.lit("null"))))))
    body = F.coalesce("continuation", F.lit(""))
    rows = rows.where("_known").withColumns({"raw_answer": F.nullif(answers.read_answers(body, readers), F.lit("")), "first_sentence": F.nullif(sentences.first_sentence_column(body, rules), F.lit("")), "_removed": removed_sentence(F.col("sentences"), F.col("boundary_index"))})
    name = bucket(F.col("raw_answer")) if bucket else F.nullif(text.normalised_answer(F.col("raw_answer")), F.lit(""))
    asked = (F.col("_removed") != "") & F.col("first_sentence").isNotNull() & ~F.coalesce(is_withheld(F.col("finish_reason"), F.col("first_sentence")), F.lit(False))

    @F.pandas_udf(DoubleType())
    def near(removed: pd.Series, first: pd.Series, use: pd.Series) -> pd.Series:
        out = pd.Series(float("nan"), index=removed.index)
        if use.any():
            out[use] = similarity(removed[use].reset_index(drop=True), first[use].reset_index(drop=True)).to_numpy()
        return out

    found = near("_removed", F.coalesce("first_sentence", F.lit("")), asked)
    rows = rows.withColumns({"bucket": name, "similarity": F.when(~F.isnan(found), found).cast("float")})
    verdict = is_correct(rows) if is_correct else F.lit(None).cast("boolean")
    return rows.withColumns({"is_correct": verdict, "valid": is_valid(F.col("bucket"), F.col("finish_reason"))}).select(*COLUMNS)


def withheld(scores: DataFrame) -> DataFrame:
    """The samples whose similarity was withheld, with the length of their opening."""
    return scores.where(is_withheld(F.col("finish_reason"), F.col("first_sentence"))).select("case_id", "trace_id", "boundary_index", "rollout_index", F.length("first_sentence").alias("chars"))
