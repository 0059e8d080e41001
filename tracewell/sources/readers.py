"""Sources: tables of cases, responses, traces, samples and grades.

All go through Spark's readers, so any store that Spark knows will do. A path
that isn't there is an empty relation where a first run has none yet.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text
from . import schemas


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; fields may be long, quoted and of several lines."""
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("maxCharsPerColumn", -1).csv(path)


def dataset(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A local dataset of Parquet files for each split under data/; the train split by default."""
    return spark.read.parquet(f"{path.rstrip('/')}/data/{split or 'train'}-*")


def json_array(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True) if exists(spark, path) else spark.createDataFrame([], schema)


def responses(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, schemas.RESPONSES)


def cohort(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, schemas.CASES)


def traces(spark: SparkSession, path: str) -> DataFrame:
    """Traces of a JSON lines file, those with bad spans included; :func:`bad_spans` tells them."""
    return spark.read.schema(schemas.TRACES).json(path)


def bad_spans(rows: DataFrame) -> DataFrame:
    """Traces whose sentences break a rule: empty spans, tokens out of range or order, indices that skip."""
    s = F.col("sentences")
    empty = F.exists(s, lambda x: (x["char_end"] <= x["char_start"]) | (x["token_end"] <= x["token_start"]))
    skips = ~F.forall(F.transform(s, lambda x, i: x["sentence_index"] == i), lambda ok: ok)
    starts = F.transform(s, lambda x: x["token_start"])
    order = F.exists(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda i: F.coalesce(F.get(starts, i) <= F.get(starts, i - 1), F.lit(False)))
    beyond = F.element_at(F.transform(s, lambda x: x["token_end"]), -1) > F.size("input_ids")
    reason = F.when(F.coalesce(F.size(s), F.lit(0)) <= 0, "no sentences").when(empty, "empty span").when(skips, "indices").when(order, "order").when(beyond, "range")
    return rows.select("trace_id", reason.alias("reason")).where("reason is not null")


def trace_summaries(rows: DataFrame) -> DataFrame:
    """The few columns that curves need; the scan reads no more than these."""
    starts = F.transform("sentences", lambda x: x["token_start"])
    return rows.select(
        "model", "case_id", "trace_id", text.stripped(F.coalesce("raw_answer", F.lit(""))).alias("raw_answer"), "is_correct", "prompt_token_count",
        F.size("sentences").alias("n_sentences"), F.concat(starts, F.array(F.element_at("sentences", -1)["token_end"])).alias("boundary_tokens"), F.transform("sentences", lambda x: x["text"]).alias("sentences"),
    )


def depth(boundary_tokens: Column, prompt_tokens: Column, boundary: Column) -> Column:
    """Share of a trace's tokens before a boundary, counted from the prompt's end."""
    last = F.element_at(boundary_tokens, -1)
    return F.try_divide(F.get(boundary_tokens, boundary) - prompt_tokens, last - prompt_tokens)


def rollouts(spark: SparkSession, path: str, case_id: str | None = None, columns: Iterable[str] | None = None) -> DataFrame:
    """Samples of a table partitioned by case; a case is read from its own folder alone."""
    rows = spark.read.schema(schemas.ROLLOUTS).parquet(path)
    rows = rows.where(F.col("case_id") == case_id) if case_id is not None else rows
    return rows.select(*columns) if columns else rows


def scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SCORES).parquet(path)


def graded(score: DataFrame, grades: DataFrame, known_traces: DataFrame) -> DataFrame:
    """Valid scores with the entity of their answer; those without entity or trace drop out."""
    rows = score.where(F.col("valid") & (F.coalesce("raw_answer", F.lit("")) != "")).withColumn("raw_answer", text.stripped(F.col("raw_answer")))
    return rows.join(entities(grades), ["case_id", "raw_answer"]).join(known_traces.select("trace_id").distinct(), "trace_id")


def entities(grades: DataFrame) -> DataFrame:
    """Entity of each answer of a case, those without a name left out."""
    return grades.where("coalesce(canonical, '') <> ''").select("case_id", "raw_answer", F.col("canonical").alias("entity"))


def assigned_cases(spark: SparkSession, path: str, model: str) -> DataFrame:
    return csv(spark, path).where(F.col("model") == model).select("case_id").distinct()


def damaged_parts(spark: SparkSession, path: str) -> DataFrame:
    """Rows of every Parquet part under a path, and the error of those whose footer can't be read.

    Spark counts the rows of all files by their footers, no column is read. Only
    files that give none, which are empty or damaged, are read apart.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)
    files = listed.select("path", "length")  # the listing alone
    counted = spark.read.format("parquet").schema("_none int").option("ignoreCorruptFiles", True).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)
    good = counted.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"))
    sure = files.join(good, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, errors = [], []
            for content in batch.column(1):
                try:
                    rows.append(pq.ParquetFile(pa.BufferReader(content.as_py())).metadata.num_rows)
                    errors.append(None)
                except (pa.ArrowInvalid, OSError) as e:
                    rows.append(None)
                    errors.append(str(e)[:200])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.int64()), pa.array(errors, pa.string())], ["path", "rows", "error"])

    doubtful = [r.path for r in files.join(good, "path", "left_anti").collect()]
    found = sure.select("path", "rows", F.lit(None).cast("string").alias("error"))
    if not doubtful:
        return found
    suspects = spark.read.format("binaryFile").load(doubtful)
    return found.unionByName(suspects.select("path", "content").mapInArrow(run, "path string, rows long, error string"))
