"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session where it is set, and else the context's checkpoint folder.

    If neither is set, a temporary folder of this machine under a local master;
    RuntimeError under any other, whose executors do not see such a folder.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tracewell-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where
