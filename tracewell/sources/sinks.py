"""Sinks: partitioned samples, tables, logs and small files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import exists

SAFE_NAME = r"^[A-Za-z0-9._-]+\z"


def append_rollouts(rows: DataFrame, path: str) -> None:
    """Add samples to the table partitioned by case; ids must do as folder names."""
    bad = rows.where(~F.coalesce(F.col("case_id").rlike(SAFE_NAME), F.lit(False))).select("case_id").limit(3).collect()
    if bad:
        raise ValueError(f"case ids that can't name a folder: {[r.case_id for r in bad]}")
    rows.repartition("case_id").write.mode("append").partitionBy("case_id").option("compression", "zstd").parquet(path)


def replace_table(rows: DataFrame, path: str) -> None:
    """Write scores, grades or figures anew; the commit protocol shows all of it or nothing."""
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def append_lines(rows: DataFrame, path: str) -> None:
    """Add rows to a folder of JSON lines."""
    rows.write.mode("append").json(path)


def result_csv(rows: DataFrame, path: str) -> bool:
    """Write a result that fits one file as CSV with a header; nothing if it has no rows."""
    if rows.isEmpty():
        return False
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return True


def _files(path: str):
    """Hadoop's view of a path in any store: JVM, path, its file system."""
    spark = SparkSession.active()
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def small_json(payload: object, path: str) -> None:
    """Write a selection, pool or cohort of the driver, to any store; readers never see half of it."""
    jvm, target, store = _files(path)
    part = jvm.org.apache.hadoop.fs.Path(path + ".part")
    out = store.create(part, True)
    out.write(bytearray(json.dumps(payload, indent=1).encode()))
    out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = SparkSession.active().sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    where = store.makeQualified(target)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), store.getConf()).rename(store.makeQualified(part), where, options)


def manifest(payload: dict, path: str) -> None:
    """Write a run's manifest once; the same again is fine, another is an error."""
    jvm, target, store = _files(path)
    if store.exists(target):
        stream = store.open(target)
        there = json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        stream.close()
        if there != payload:
            changed = sorted(k for k in there.keys() | payload.keys() if k not in there or k not in payload or there[k] != payload[k])
            raise ValueError(f"the run was begun with other settings: {changed}")
        return
    small_json(payload, path)


def with_key_json(counts: str = "counts"):
    """A histogram map as JSON text with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(counts))))


__all__ = ["append_lines", "append_rollouts", "exists", "manifest", "replace_table", "result_csv", "small_json", "with_key_json"]
