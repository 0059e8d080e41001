"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality, toxicity
from .common import crc32_of_id, table
from .embedding_dedup import embedding_groups
from .exact_dedup import exact_groups
from .lm_scores import language_scores
from .mixing import mixed
from .packing import pack
from .repeats import without_repeats
from .simhash import simhash_groups
from .token_counts import token_prefix_tables

VOCABULARY = "byte_bpe_50k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = token_prefix_tables(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), budget=512)
    return tables.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), "budget_chars")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), window=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), folds=5))
    return scored.select(
        "doc_id",
        (crc32_of_id(F.col("doc_id")) % 5 == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        F.get(F.col("evidence.doc_id"), F.lit(0)).alias("nearest_example"),
    )


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"), folds=10)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.graded(docs, quality.fit(docs, table(spark, sf_dir, "labels"), folds=5), at_least=1.0)
    return scored.select(
        "doc_id",
        (crc32_of_id(F.col("doc_id")) % 5 == 0).alias("held_out"),
        "expected_grade",
        "tail_probability",
        (F.col("tail_probability") >= 0.5).alias("kept"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"), radius=4)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = without_repeats(table(spark, sf_dir, "documents"), length=50)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixed(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP2_SQL = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95
), reach(a, b) as (
  select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on r.b = l.a
), n as (select a, count(*) as n from links group by a)
select r.a as vec_id, coalesce(max(n), 0)::bigint as n_links, min(r.b) as component_id, r.a = min(r.b) as kept
from reach r left join n on n.a = r.a group by r.a
"""

OP9_SQL = """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
  count(*) over (partition by coalesce(text, '')) as group_size,
  doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
  sha256(coalesce(text, '')) as text_sha256
from documents
"""

OP10_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), sources as (
  select source, sum(size)::bigint as source_size,
         ((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1)::double as weight
  from sized group by source
), sums as (
  select *, sum(source_size) over ()::double as total,
    sum(weight) over () - coalesce(sum(weight) over (order by source_size / weight, source is null, encode(source)
      rows between unbounded preceding and 1 preceding), 0) as heavy,
    3 * coalesce(sum(source_size) over (order by source_size / weight, source is null, encode(source)
      rows between unbounded preceding and 1 preceding), 0)::double as used
  from sources
), stops as (
  select *, total - used as spare, 3 * source_size * heavy <= weight * (total - used) as stops from sums
), targets as (
  select source, source_size,
    case when stops then (3 * source_size)::double
         else weight * max(case when not stops then spare / heavy end) over () end as target, stops
  from stops
), rates as (
  select *, case when source_size = 0 then 0.0::double when stops then 3.0::double else target / source_size end as rate from targets
)
select d.doc_id, d.size, r.source_size, r.target,
  d.size * (floor(r.rate) + case when
    ('0x' || substr(md5('mix:' || coalesce(d.doc_id::varchar, 'null')), 1, 12))::bigint / 281474976710656.0
      < r.rate - floor(r.rate) then 1 else 0 end)::bigint as taken
from sized d join rates r on d.source is not distinct from r.source
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_lm_scores": op5_lm_scores,
    "op6_quality": op6_quality,
    "op7_simhash": op7_simhash,
    "op8_repeats": op8_repeats,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_mixing": op10_mixing,
}

SQL: dict[str, str] = {"op2_embedding_dedup": OP2_SQL, "op9_exact_dedup": OP9_SQL, "op10_mixing": OP10_SQL}
