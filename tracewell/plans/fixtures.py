"""Relations of the engine's shape, read from the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def registry() -> tuple[dict, dict, Callable]:
    """Queries by name, their SQL, and what registers a function under its name with its SQL."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    sql_of: dict[str, str] = {}

    def query(sql: str | None = None):
        def put(f):
            queries[f.__name__] = f
            if sql:
                sql_of[f.__name__] = sql
            return f

        return put

    return queries, sql_of, query


def r9(c: str, name: str | None = None):
    return F.round(c, 9).alias(name or c)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    """``lineitem`` as graded samples: a supplier is a trace, a month a boundary, flag and status an entity."""
    entity = F.col("l_returnflag") if coarse else F.concat("l_returnflag", "l_linestatus")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 8).alias("model"),
        F.col("l_suppkey").alias("trace_id"),
        (F.month("l_shipdate") - 1).cast("int").alias("boundary_index"),
        entity.alias("entity"),
        (F.col("l_suppkey") % 2 == 0).alias("base_is_correct"),
        (F.col("l_discount") * 10).cast("float").alias("similarity"),
        (F.col("l_quantity") > 5).alias("valid"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate",
    )


def numbered_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples with their rollout_index, by a key that is unique within a trace."""
    order = Window.partitionBy("trace_id", "boundary_index").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    return samples(spark, sf_dir).withColumn("rollout_index", F.row_number().over(order) - 1)


def short_traces(spark: SparkSession, sf_dir: str, cuts: int = 4) -> DataFrame:
    """``events`` as samples: a user is a trace, cut into ``cuts`` boundaries by time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("trace_id"), (F.ntile(cuts).over(order) - 1).alias("boundary_index"), F.col("event_type").alias("entity")
    )


#: The same relations for DuckDB, as common table expressions.
F1 = """f1 as (
  select l_suppkey % 8 as model, l_suppkey as trace_id, (month(l_shipdate) - 1)::int as boundary_index,
    l_returnflag || l_linestatus as entity, l_suppkey % 2 = 0 as base_is_correct,
    (l_discount * 10)::float as similarity, l_quantity > 5 as valid,
    row_number() over (partition by l_suppkey, month(l_shipdate) order by l_orderkey, l_linenumber, l_partkey,
      l_quantity, l_extendedprice, l_discount, l_shipdate) - 1 as rollout_index
  from lineitem)"""
F1B = F1.replace("l_returnflag || l_linestatus as entity", "l_returnflag as entity")
F2 = """f1 as (
  select user_id as trace_id, (ntile({cuts}) over (partition by user_id order by ts, event_id) - 1)::int as boundary_index,
    event_type as entity from events)"""
#: Histogram, sizes and exact distances over f1.
HIST = """h as (select trace_id, boundary_index, entity, count(*) as c from f1 group by all),
s as (select trace_id, boundary_index, sum(c)::bigint as n from h group by all)"""
PAIRS = """p as (
  select a.trace_id, a.boundary_index as i, b.boundary_index as j, a.n * b.n as den,
    a.n * b.n - coalesce((select sum(least(x.c * b.n, y.c * a.n)) from h x join h y
      on x.trace_id = y.trace_id and x.entity = y.entity
      where x.trace_id = a.trace_id and x.boundary_index = a.boundary_index and y.boundary_index = b.boundary_index), 0)::bigint as num
  from s a join s b on a.trace_id = b.trace_id and a.boundary_index < b.boundary_index)"""
CURVE = """c as (
  select trace_id, i as boundary_index, count(*) as n_forward, max(num / den) as tvd_max_forward,
    median(num / den) as tvd_median_forward, max(case when j = i + 1 then num / den end) as tvd_next,
    bool_and(5 * num <= den) as within_band
  from p group by all)"""
COMMIT = """k as (
  select trace_id, max(boundary_index) as last_boundary from s group by all), m as (
  select k.trace_id, k.last_boundary, min(case when within_band then c.boundary_index end) as commit_boundary
  from k left join c using (trace_id) group by all)"""


def with_(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


def upto(*names: str) -> str:
    """The expressions from f1 to the named last one."""
    chain = {"h": HIST, "p": PAIRS, "c": CURVE, "m": COMMIT}
    return with_(*names, *list(chain.values()))
