"""Queries through sinks and sources: rows are written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import shared_dir
from ..sources import readers, schemas, sinks
from .fixtures import registry, table

QUERIES, SQL, query = registry()


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tracewell-sources-{uuid.uuid4().hex}"


@query("select c_custkey, 'a \"' || c_name || '\", b' || chr(10) || c_mktsegment as note from customer")
def csv_read_back(spark, d):
    """Quotes, commas and line breaks in a field."""
    path = _folder(spark)
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit('a "'), "c_name", F.lit('", b\n'), "c_mktsegment").alias("note"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return readers.csv(spark, path).select(F.col("c_custkey").cast("long").alias("c_custkey"), "note")


@query("select n_nationkey::varchar as case_id, 'r' || n_regionkey as source, n_name || ' ä' as \"case\", n_name as answer from nation")
def cohort_read_back(spark, d):
    """A cohort's JSON array, written by the driver."""
    path = _folder(spark) + "/cohort.json"
    sinks.small_json([{"case_id": str(r.n_nationkey), "source": f"r{r.n_regionkey}", "case": f"{r.n_name} ä", "answer": r.n_name} for r in table(spark, d, "nation").collect()], path)
    return readers.cohort(spark, path).select("case_id", "source", "case", "answer")


@query("select r_name, r_name as train, r_regionkey from region")
def dataset_splits(spark, d):
    path = _folder(spark)
    region = table(spark, d, "region")
    region.write.parquet(f"{path}/data/train-00000")
    region.withColumn("r_name", F.lit("other")).write.parquet(f"{path}/data/test-00000")
    return readers.dataset(spark, path).select("r_name", F.col("r_name").alias("train"), "r_regionkey")


def _traces(spark, d) -> DataFrame:
    """As a stand-in of traces: a customer's orders are its sentences, one token each of every 7 before; every fifth customer's have an empty span."""
    place = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(place) - 1).cast("int").alias("i"))
    start, bad = 7 + 2 * F.col("i"), (F.col("o_custkey") % 5 == 0) & (F.col("i") == 1)
    end = start + F.when(bad, 0).otherwise(2)
    span = F.struct(F.col("i").alias("sentence_index"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("text"), (3 * F.col("i")).alias("char_start"), (3 * F.col("i") + 2).alias("char_end"), start.alias("token_start"), end.alias("token_end"))
    each = rows.groupBy("o_custkey").agg(F.array_sort(F.collect_list(span)).alias("sentences"))
    name = F.col("o_custkey").cast("string")
    return each.select(
        F.lit("m").alias("model"), F.concat(F.lit("c"), (F.col("o_custkey") % 9).cast("string")).alias("case_id"), F.concat(F.lit("t"), name).alias("trace_id"), F.lit("x").alias("full_response"), F.lit(7).alias("prompt_token_count"),
        F.sequence(F.lit(0), 6 + 2 * F.size("sentences")).alias("input_ids"), "sentences", F.concat(F.lit(" A"), name, F.lit(" ")).alias("raw_answer"), (F.col("o_custkey") % 2 == 0).alias("is_correct"),
    )


@query("select 't' || o_custkey as trace_id, 'c' || (o_custkey % 9) as case_id, 'A' || o_custkey as raw_answer, o_custkey % 2 = 0 as is_correct, count(*)::int as n_sentences, list_aggregate(list('s' || o_orderkey order by o_orderkey), 'string_agg', ' ') as sentences, (7 + 2 * count(*))::int as last_token from orders group by o_custkey having not (o_custkey % 5 = 0 and count(*) > 1)")
def trace_lines(spark, d):
    """Traces as JSON lines, those with bad spans left out, as summaries."""
    path = _folder(spark)
    sinks.append_lines(_traces(spark, d), path)
    rows = readers.traces(spark, path)
    good = rows.join(readers.bad_spans(rows), "trace_id", "left_anti")
    return readers.trace_summaries(good).select("trace_id", "case_id", "raw_answer", "is_correct", "n_sentences", F.array_join("sentences", " ").alias("sentences"), F.element_at("boundary_tokens", -1).alias("last_token"))


@query("select 't' || o_custkey as trace_id, 'empty span' as reason from orders group by o_custkey having o_custkey % 5 = 0 and count(*) > 1")
def trace_faults(spark, d):
    path = _folder(spark)
    sinks.append_lines(_traces(spark, d), path)
    return readers.bad_spans(readers.traces(spark, path))


@query("select event_type as case_id, user_id::varchar as trace_id, count(*) as n, max(event_id % 50)::int as last_index from events where event_type = 'click' group by all")
def rollout_parts(spark, d):
    """Samples of one case, from a table that was added to twice."""
    path = _folder(spark)
    rows = table(spark, d, "events").select(
        F.col("event_type").alias("case_id"), F.col("user_id").cast("string").alias("trace_id"), F.lit(0).alias("boundary_index"), (F.col("event_id") % 50).cast("int").alias("rollout_index"), F.lit(3).alias("prefix_token_count"),
        F.lit("h").alias("prefix_sha256"), F.array(F.lit(1)).alias("output_token_ids"), F.lit("text").alias("continuation"), F.lit("stop").alias("finish_reason"), F.lit(7).cast("long").alias("seed"),
    )
    sinks.append_rollouts(rows.where("rollout_index < 20"), path)
    sinks.append_rollouts(rows.where("rollout_index >= 20"), path)
    return readers.rollouts(spark, path, "click", ["case_id", "trace_id", "rollout_index"]).groupBy("case_id", "trace_id").agg(F.count(F.lit(1)).alias("n"), F.max("rollout_index").alias("last_index"))


@query("select count(*) as rows, 0::bigint as damaged from customer")
def parts_checked(spark, d):
    path = _folder(spark)
    table(spark, d, "customer").repartition(5).write.parquet(path)
    return readers.damaged_parts(spark, path).agg(F.sum("rows").alias("rows"), F.count("error").alias("damaged"))


@query("select 'c' || c_nationkey as case_id, c_custkey::varchar as trace_id, c_acctbal > 0 as valid from customer")
def scores_replaced(spark, d):
    """A table of scores written anew over another one."""
    path = _folder(spark)
    rows = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("case_id"), F.col("c_custkey").cast("string").alias("trace_id"), (F.col("c_acctbal") > 0).alias("valid"))
    whole = rows.select(*(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.SCORES.fields))
    sinks.replace_table(whole.withColumn("valid", F.lit(None).cast("boolean")), path)
    sinks.replace_table(whole, path)
    return readers.scores(spark, path).select("case_id", "trace_id", "valid")


@query("select distinct 'c' || c_nationkey as case_id from customer where c_mktsegment = 'BUILDING'")
def cases_assigned(spark, d):
    path = _folder(spark)
    sinks.result_csv(table(spark, d, "customer").select(F.col("c_mktsegment").alias("model"), F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("case_id")).distinct(), path)
    return readers.assigned_cases(spark, path, "BUILDING")


@query("select true as again, 'b, c' as changed")
def manifest_once(spark, d):
    """The same manifest again is fine; of another one the settings that differ are named."""
    path = _folder(spark) + "/run/manifest.json"
    sinks.manifest({"a": 1, "b": [2], "c": None}, path)
    sinks.manifest({"c": None, "b": [2], "a": 1}, path)
    try:
        sinks.manifest({"a": 1, "b": [3]}, path)
        changed = ""
    except ValueError as e:
        changed = ", ".join(k for k in "abc" if f"'{k}'" in str(e))
    return spark.createDataFrame([(True, changed)], "again boolean, changed string")
