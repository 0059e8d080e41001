"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir

#: Written tables of this process, for :func:`forget_tables`. They are the caller's to delete, by it or by :func:`scratch`.
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a zstd Parquet table in the shared folder; readers prune columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tracewell-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget_tables(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the tables of :func:`written` from the ``since``-th on; no DataFrame over them is usable after.

    The files of ``keep``, a table of :func:`written`, stay.
    """
    jvm = spark.sparkContext._jvm
    stay = [p for p in _written[since:] if keep is not None and any(f"/{p.rsplit('/', 1)[1]}/" in f for f in keep.inputFiles())]
    for path in set(_written[since:]) - set(stay):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written[since:] = stay


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables that operators write inside are deleted at the end, whatever happens.

    An operator's result reads them, so it is to be used inside. A table of
    :func:`written` that is put into the list stays, and is the caller's.
    """
    since, keep = len(_written), []
    try:
        yield keep
    finally:
        forget_tables(spark, since, keep[0] if keep else None)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_of_id(doc_id: Column) -> Column:
    """CRC-32 of the id written as text; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0).cast("long"))


def utf8(text: Column) -> Column:
    """The text's UTF-8 bytes; a null text is empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


__all__ = [
    "checkpointed",
    "crc32_of_id",
    "forget_tables",
    "partitions",
    "scratch",
    "shared_dir",
    "table",
    "unused",
    "utf8",
    "written",
]
