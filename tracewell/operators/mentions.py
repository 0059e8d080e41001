"""Which sentences of a trace name its final answer, or another one of its case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


#: A word is looked up by so many of its first characters.
GRAM = 3
#: So many of a case's shortest entities are tried on each sentence first, and so many of all cases.
SHORT, ALL_SHORT = 64, 20_000


def case_words(entities: DataFrame) -> DataFrame:
    """The word lists of the entities of each case (case_id, entity), and how many entities reduce to each; empty ones are left out."""
    rows = entities.where("coalesce(entity, '') <> ''").select("case_id", "entity").distinct()
    return rows.select("case_id", text.content_words(F.col("entity")).alias("words")).where(F.size("words") > 0).groupBy("case_id", "words").agg(F.count(F.lit(1)).alias("times"))


def _shortest(words: DataFrame, short: int) -> DataFrame:
    """The word lists of the shortest entities of each case as one array, ALL_SHORT lists in all at most: case_id, shortest."""
    length = F.aggregate("words", F.lit(0), lambda n, w: n + F.length(w))
    order = Window.partitionBy("case_id").orderBy("_length", "words")
    ranked = words.select("case_id", "words", length.alias("_length")).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= short)
    some = ranked.orderBy("_rank", "case_id").limit(ALL_SHORT)
    return some.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("_rank", "words")))["words"].alias("shortest"))


def _indexed(sentences: DataFrame, words: DataFrame) -> DataFrame:
    """Which sentences (case_id, trace_id, sentence_index, flat) name an entity of their case: trace_id, sentence_index.

    An entity stands under that of its words which the fewest entities of its case
    have, so a word that many share doesn't bring all of them to all its
    sentences; words that stand inside many others, as the shortest do, come last.
    That word stands under its first characters, and a token's substrings of that
    many are looked up.
    """
    each = words.select("case_id", "words", F.explode("words").alias("word"))
    shared = each.groupBy("case_id", "word").agg(F.count(F.lit(1)).alias("entities"))
    rarest = F.min(F.struct(F.length("word") < GRAM, "entities", -F.length("word"), "word"))["word"]
    index = each.join(shared, ["case_id", "word"]).groupBy("case_id", "words").agg(rarest.alias("word")).withColumn("gram", F.substring("word", 1, GRAM))
    tokens = sentences.select("case_id", "trace_id", "sentence_index", F.explode(F.array_distinct(F.split("flat", " "))).alias("token")).where("token <> ''")
    size = F.length("token")
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda at: F.substring("token", at, n))))
    distinct = tokens.select("case_id", "token").distinct().select("case_id", "token", F.explode(F.array_distinct(pieces)).alias("gram"))
    holds = distinct.join(index.select("case_id", "gram", "word").distinct(), ["case_id", "gram"]).where(F.contains("token", "word")).select("case_id", "token", "word")
    likely = tokens.join(holds, ["case_id", "token"]).select("case_id", "trace_id", "sentence_index", "word").distinct().join(index.select("case_id", "word", "words"), ["case_id", "word"])
    named = likely.join(sentences.select("trace_id", "sentence_index", "flat"), ["trace_id", "sentence_index"]).where(text.names(F.col("flat"), F.col("words")))
    return named.select("trace_id", "sentence_index").distinct()


def mentions(traces: DataFrame, words: DataFrame, short: int = SHORT) -> DataFrame:
    """One row per sentence: whether it names the final answer, or else one of the case's others.

    ``traces`` has case_id, trace_id (unique), raw_answer, sentences (an array of
    text); ``words`` is that of :func:`case_words`. Others are entities whose words
    are not the final answer's in order; two that reduce to the same words count
    twice.

    What a sentence without the final answer names is another entity, so the first
    one that is found settles it. The ``short`` shortest entities of a case are
    tried on all of its sentences where these are read; an index finds the
    entities of sentences that name none of them (:func:`_indexed`). So neither a
    sentence nor a task holds a case's entities, and only sentences that are left
    are exchanged.
    """
    rows = traces.withColumn("final", text.content_words(F.col("raw_answer"))).join(F.broadcast(_shortest(words, short)), "case_id", "left")
    flats = F.transform("sentences", text.flat)
    named = lambda f: F.coalesce(F.exists("shortest", lambda w: text.names(f, w)), F.lit(False))
    marked = F.transform(flats, lambda f, at: F.struct(at.alias("sentence_index"), f.alias("flat"), F.when(text.names(f, F.col("final")), 2).when(named(f), 1).otherwise(0).alias("mark")))
    rows = rows.select("case_id", "trace_id", "final", marked.alias("marked"))
    left = rows.select("case_id", "trace_id", F.explode(F.filter("marked", lambda m: m["mark"] == 0)).alias("m")).select("case_id", "trace_id", "m.sentence_index", "m.flat")
    found = _indexed(left, words).withColumn("_other", F.lit(1))

    known = words.groupBy("case_id").agg(F.sum("times").alias("_all"))
    same = words.select(F.col("case_id").alias("_case"), F.col("words").alias("_words"), F.col("times").alias("_same"))
    about = rows.select("case_id", "trace_id", "final", F.col("marked")["mark"].alias("marks")).join(known, "case_id", "left").join(same, (F.col("case_id") == F.col("_case")) & (F.col("final") == F.col("_words")), "left")
    n_others = (F.coalesce("_all", F.lit(0)) - F.coalesce("_same", F.lit(0))).cast("int")
    every = F.filter("marks", lambda m: m.isNotNull())  # all; of a plain column Spark infers a filter, which makes the marks once more
    each = about.select("case_id", "trace_id", F.array_join("final", " ").alias("final_words"), n_others.alias("n_other_entities"), F.size("marks").alias("n_sentences"), F.posexplode(every).alias("sentence_index", "mark"))
    other = F.when(F.col("mark") == 0, F.coalesce("_other", F.lit(0))).otherwise((F.col("mark") == 1).cast("int"))
    return each.join(found, ["trace_id", "sentence_index"], "left").select(
        "case_id", "trace_id", "sentence_index", "n_sentences", (F.col("mark") == 2).cast("int").alias("mentions_final"), other.alias("mentions_other"), "final_words", "n_other_entities"
    )


def first_mentions(rows: DataFrame) -> DataFrame:
    """Adds first_index of the final answer's mentions, is_first, is_repeat."""
    first = F.min(F.when(F.col("mentions_final") == 1, F.col("sentence_index"))).over(Window.partitionBy("trace_id"))
    rows = rows.withColumn("first_index", first)
    is_first = F.coalesce(F.col("sentence_index") == F.col("first_index"), F.lit(False))
    return rows.withColumns({"is_first": is_first, "is_repeat": (F.col("mentions_final") == 1) & ~is_first})


def rate_before_after(rows: DataFrame, commit: Column, flag: Column, least: int = 5) -> DataFrame:
    """Share of flagged sentences before and after commitment, of traces with ``least`` on either side."""
    after = F.col("sentence_index") >= commit
    return (
        rows.groupBy("trace_id")
        .agg(F.avg(F.when(~after, flag.cast("double"))).alias("before"), F.avg(F.when(after, flag.cast("double"))).alias("after"), F.count_if(~after).alias("n_before"), F.count_if(after).alias("n_after"))
        .where((F.col("n_before") >= least) & (F.col("n_after") >= least))
    )
