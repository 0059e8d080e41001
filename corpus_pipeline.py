"""The corpus pipeline: each stage works on all rows that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import exact_dedup, mixing, packing, simhash, toxicity
from tracewell.llm.common import scratch, table, written
from tracewell.llm.queries import VOCABULARY


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of largest id stays."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints within 4 bits the one of least id stays."""
    return simhash.one_of_each_group(docs, radius=4)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are left out or repeated so that sources come near their targets."""
    return mixing.emit(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens, with their ids."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash", drop_near_copies), ("mixing", mix), ("packing", pack)]

#: SQL can express neither the scores nor the fingerprints nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, over the whole table of documents; each is written and reread as the next one's docs.

    What stages write for themselves is deleted when their result stands, and the
    results before the last at the end.
    """
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as last:
        for _, stage in STAGES:
            with scratch(spark) as result:
                result.append(written(stage(spark, docs, sf_dir)))
            docs = result[0]
        last.append(docs)
    return docs
