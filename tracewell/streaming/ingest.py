"""Samples as they arrive. An extension: the studies themselves read finished tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import schemas

KEY = ["trace_id", "boundary_index", "rollout_index"]


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the parts that are appended under a path."""
    return spark.readStream.schema(schemas.ROLLOUTS).parquet(path)


def keep_histogram(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keep counts of finish reasons for each boundary in a table of deltas, one folder for each batch.

    A sample counts once, however often and in whichever batches it comes: the
    stream's state holds the keys of all samples, so it grows with them and
    belongs in a state store on disk. A batch that is run again writes its folder
    again.
    """

    def put(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("trace_id", "boundary_index", "finish_reason").agg(F.count(F.lit(1)).alias("c"))
        counts.write.mode("overwrite").parquet(f"{table}/batch={number}")

    once = stream.dropDuplicates(KEY)
    return once.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def histogram_so_far(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(table).groupBy("trace_id", "boundary_index", "finish_reason").agg(F.sum("c").alias("c"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events of each type in windows of time, with late ones up to a bound."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
