"""Queries over sampled traces: distances, curves, gates and order statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import curves, distributions, gates, ranking
from .fixtures import COMMIT, CURVE, F1, F1B, F2, HIST, PAIRS, numbered_samples, r9, registry, samples, short_traces, with_

QUERIES, SQL, query = registry()


def _hist(spark, d, coarse=False) -> DataFrame:
    return distributions.histogram(samples(spark, d, coarse))


def _curve(spark, d, coarse=False, band=(1, 5)) -> DataFrame:
    return curves.forward_curve(distributions.forward_pairs(_hist(spark, d, coarse)), band)


def _last(rows: DataFrame) -> DataFrame:
    return rows.groupBy("trace_id").agg(F.max("boundary_index").alias("last_boundary"))


@query(with_(F1, HIST) + "select trace_id, boundary_index, entity, c from h")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return _hist(spark, d)


@query(with_(F1, HIST, PAIRS) + "select trace_id, i, j, num, den, round(num / den, 9) as tvd from p")
def tvd_pairs(spark, d):
    return distributions.forward_pairs(_hist(spark, d)).withColumn("tvd", F.round(distributions.tvd(), 9))


@query(with_(F1, HIST, PAIRS, CURVE) + "select trace_id, boundary_index, n_forward, round(tvd_max_forward, 9) as tvd_max_forward, within_band from c")
def tvd_curve(spark, d):
    return _curve(spark, d).select("trace_id", "boundary_index", "n_forward", r9("tvd_max_forward"), "within_band")


@query(with_(F1, HIST, PAIRS, CURVE) + "select trace_id, boundary_index, round(tvd_median_forward, 9) as tvd_median_forward from c")
def tvd_median_forward(spark, d):
    return _curve(spark, d).select("trace_id", "boundary_index", r9("tvd_median_forward"))


@query(with_(F1, HIST, PAIRS, CURVE) + "select trace_id, boundary_index, round(tvd_next, 9) as tvd_next from c")
def tvd_next(spark, d):
    return _curve(spark, d).select("trace_id", "boundary_index", r9("tvd_next"))


@query(with_(F1, HIST, PAIRS, CURVE, COMMIT) + "select trace_id, last_boundary, commit_boundary from m")
def tvd_commit(spark, d):
    hist = _hist(spark, d)
    return curves.commitment(curves.forward_curve(distributions.forward_pairs(hist)), _last(hist))


@query(with_(F1B, HIST, PAIRS, CURVE, COMMIT) + "select trace_id, last_boundary, coalesce(commit_boundary, last_boundary) as commit_boundary from m")
def tvd_commit_or_last(spark, d):
    hist = _hist(spark, d, coarse=True)
    return curves.commitment(curves.forward_curve(distributions.forward_pairs(hist)), _last(hist), fallback="last")


@query(with_(F2.format(cuts=4), HIST, PAIRS, CURVE, COMMIT) + "select trace_id, last_boundary, commit_boundary from m")
def tvd_commit_events(spark, d):
    hist = distributions.histogram(short_traces(spark, d))
    return curves.commitment(curves.forward_curve(distributions.forward_pairs(hist)), _last(hist))


BASE = """b as (select trace_id, arg_max(entity, (c, entity)) as base_entity from (
  select trace_id, entity, count(*) as c from f1 where boundary_index = 11 group by all) group by trace_id),
share as (select trace_id, boundary_index, avg((entity = base_entity)::int::double) as share from f1 join b using (trace_id) group by all)"""


def _base(rows: DataFrame) -> DataFrame:
    """As a stand-in of a trace's own answer: its most frequent entity at the last boundary."""
    counts = rows.where("boundary_index = 11").groupBy("trace_id", "entity").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("trace_id").agg(F.max(F.struct("c", "entity"))["entity"].alias("base_entity"))


def _share(spark, d) -> DataFrame:
    rows = samples(spark, d).select("trace_id", "boundary_index", "entity")
    return curves.base_share(rows, _base(rows))


@query(with_(F1, BASE) + "select trace_id, boundary_index, round(share, 9) as share from share")
def base_share_curve(spark, d):
    return _share(spark, d).select("trace_id", "boundary_index", r9("share"))


_AHEAD = "over (partition by trace_id order by boundary_index rows between current row and unbounded following)"


@query(with_(F1, BASE) + f"""select trace_id, min(case when calm then boundary_index end) as convergence_boundary from (
  select trace_id, boundary_index, max(share) {_AHEAD} - share <= 0.2::double and share - min(share) {_AHEAD} <= 0.2::double as calm from share) group by trace_id""")
def convergence_index(spark, d):
    return curves.convergence_index(_share(spark, d), "share")


@query(with_(F1, BASE) + f"""select trace_id, min(case when calm then boundary_index end) as convergence_boundary from (
  select trace_id, boundary_index, max(share) {_AHEAD} - min(share) {_AHEAD} <= 0.2::double as calm from share) group by trace_id""")
def convergence_strict(spark, d):
    return curves.strict_convergence_index(_share(spark, d), "share")


_DELTAS = [(1, 20), (1, 10), (3, 20), (1, 5), (1, 4), (3, 10), (7, 20), (2, 5), (9, 20), (1, 2)]


@query(with_(F1, HIST, PAIRS) + "select trace_id, delta, min(case when ok then i end) as commit_boundary from (select trace_id, i, num100 / 100.0::double as delta, bool_and(100 * num <= num100 * den) as ok from p, (select unnest([5, 10, 15, 20, 25, 30, 35, 40, 45, 50])::bigint as num100) group by all) group by all")
def delta_sweep(spark, d):
    hundredths = F.explode(F.array(*[F.lit(100 * p // q).cast("long") for p, q in _DELTAS])).alias("hundredths")
    rows = distributions.forward_pairs(_hist(spark, d)).select("*", hundredths)
    calm = rows.groupBy("trace_id", "i", "hundredths").agg(F.bool_and(100 * F.col("num") <= F.col("hundredths") * F.col("den")).alias("calm"))
    return calm.groupBy("trace_id", (F.col("hundredths") / 100.0).alias("delta")).agg(F.min(F.when(F.col("calm"), F.col("i"))).alias("commit_boundary"))


@query(with_(F1, HIST) + """select trace_id, boundary_index, count(*) as n_distinct, round(max(case when turn = 1 then c / n else 0 end), 9) as top_share,
  round(max(case when turn = 2 then c / n else 0 end), 9) as second_share, round(sum(case when turn <= 2 then c else 0 end) / max(n), 9) as top_two_share,
  count(case when 10 * c >= n then 1 end) as n_over_tenth, round(pow(2, -sum(c / n * log2(c / n))), 6) as effective_n
  from (select h.*, n, row_number() over (partition by trace_id, boundary_index order by c desc, entity) as turn from h join s using (trace_id, boundary_index)) group by all""")
def concentration(spark, d):
    found = distributions.concentration(_hist(spark, d))
    return found.select("trace_id", "boundary_index", "n_distinct", r9("top_share"), r9("second_share"), r9("top_two_share"), "n_over_tenth", F.round("effective_n", 6).alias("effective_n"))


@query(with_(F1, HIST) + "select trace_id, boundary_index, round(pow(2, -sum(c / n * log2(c / n))), 6) as effective_answers from h join s using (trace_id, boundary_index) group by all")
def effective_answers(spark, d):
    hist = _hist(spark, d).withColumn("n", F.sum("c").over(Window.partitionBy("trace_id", "boundary_index")))
    return hist.groupBy("trace_id", "boundary_index").agg(F.round(distributions.effective_answers(), 6).alias("effective_answers"))


_WIDTHS = """, q as (select unnest(range(1, 21)) as k), ats as (
  select c.trace_id, c.boundary_index, c.tvd_max_forward as v, c.boundary_index / m.last_boundary as depth, m.commit_boundary as kc,
    max(case when c.boundary_index = 0 then c.tvd_max_forward end) over w as v0, max(case when c.boundary_index = m.commit_boundary then c.tvd_max_forward end) over w as vc,
    max(case when c.boundary_index = m.commit_boundary then c.boundary_index / m.last_boundary end) over w as dc
  from c join m using (trace_id) where m.commit_boundary > 0 and c.boundary_index <= m.commit_boundary window w as (partition by c.trace_id)),
a as (select trace_id, round(0.05::double * k, 2) as drop_fraction, max(depth) as da, max(dc) as dc from ats, q
  where v0 - vc > 0 and (v - vc) / (v0 - vc) >= round(0.05::double * k, 2) - 1e-12 group by all)
select trace_id, drop_fraction, round(dc - da, 9) as width, round((dc - da) / dc, 9) as width_of_descent from a"""


@query(with_(F1, HIST, PAIRS, CURVE, COMMIT).rstrip() + _WIDTHS)
def drop_width(spark, d):
    hist = _hist(spark, d)
    curve = curves.forward_curve(distributions.forward_pairs(hist))
    commits = curves.commitment(curve, _last(hist))
    widths = curves.drop_widths(curve, commits, F.col("boundary_index") / F.col("last_boundary"))
    return widths.select("trace_id", "drop_fraction", r9("width"), r9("width_of_descent"))


@query(with_(F1, HIST, PAIRS, CURVE) + """select trace_id, boundary_index as sentence_index, round(tvd_max_forward, 9) as tvd_before, round(nxt, 9) as tvd_after, round(tvd_max_forward - nxt, 9) as tvd_drop
  from (select *, lead(tvd_max_forward) over (partition by trace_id order by boundary_index) as nxt from c) where nxt is not null""")
def tvd_drop(spark, d):
    return curves.drops(_curve(spark, d)).select("trace_id", "sentence_index", r9("tvd_before"), r9("tvd_after"), r9("tvd_drop"))


_STATUS = """, t as (select m.trace_id, m.trace_id % 7 <> 0 as has_base, g.ok is null as thin, m.commit_boundary, x.v0 > x.vc as falls from m
  left join (select trace_id, true as ok from s join m using (trace_id) group by trace_id, last_boundary having count(*) = last_boundary + 1 and min(n) > {least}) g using (trace_id)
  left join (select trace_id, max(case when c.boundary_index = 0 then tvd_max_forward end) as v0, max(case when c.boundary_index = commit_boundary then tvd_max_forward end) as vc from c join m using (trace_id) group by all) x using (trace_id)),
st as (select *, case when not has_base then 'no_base_entity' when thin then 'thin_boundary' when commit_boundary is null then 'never_committed' when commit_boundary = 0 then 'committed_at_zero'
  when not falls then 'no_descent' else 'retained' end as status from t)
"""


def _status(spark, d, least: int) -> DataFrame:
    """As a stand-in for traces without a base entity, every seventh."""
    hist = _hist(spark, d)
    curve, last = curves.forward_curve(distributions.forward_pairs(hist)), _last(hist)
    commits = curves.commitment(curve, last)
    kept = gates.thin_gate(distributions.sizes(hist), last, least).withColumn("kept", F.lit(True))
    at = lambda k: F.max(F.when(F.col("boundary_index") == k, F.col("tvd_max_forward")))
    falls = curve.join(commits, "trace_id").groupBy("trace_id").agg((at(0) > at(F.col("commit_boundary"))).alias("falls"))
    rows = commits.join(kept, "trace_id", "left").join(falls, "trace_id", "left")
    return rows.withColumn("status", gates.status(F.col("trace_id") % 7 != 0, F.col("kept").isNull(), F.col("commit_boundary"), F.col("falls")))


@query(with_(F1, HIST, PAIRS, CURVE, COMMIT).rstrip() + _STATUS.format(least=30) + "select status, count(*) as traces from st group by status")
def exclusion_tally(spark, d):
    return gates.tally(_status(spark, d, 30), "status")


@query(with_(F1, HIST, PAIRS, CURVE, COMMIT).rstrip() + _STATUS.format(least=10) + "select trace_id, status from st")
def trace_status(spark, d):
    return _status(spark, d, 10).select("trace_id", "status")


@query(with_(F2.format(cuts=8), HIST) + "select s.trace_id from s join (select trace_id, max(boundary_index) as m from s group by all) k using (trace_id) group by s.trace_id, m having count(*) = m + 1 and min(n) > 7")
def thin_gate(spark, d):
    hist = distributions.histogram(short_traces(spark, d, 8))
    return gates.thin_gate(distributions.sizes(hist), _last(hist), 7)


@query(with_(F1, HIST, PAIRS, CURVE, COMMIT) + "select case when x < .25 then '<.25' when x < .5 then '<.5' when x < .75 then '<.75' else 'else' end as bin, count(*) as traces from (select commit_boundary / last_boundary as x from m where commit_boundary is not null) group by bin")
def depth_bins(spark, d):
    hist = _hist(spark, d)
    commits = curves.commitment(curves.forward_curve(distributions.forward_pairs(hist)), _last(hist)).where("commit_boundary is not null")
    return commits.groupBy(gates.depth_bin(F.col("commit_boundary") / F.col("last_boundary")).alias("bin")).agg(F.count(F.lit(1)).alias("traces"))


@query(with_(F1, HIST) + "select trace_id, case when x >= 0 and x < .25 then 0 when x >= .25 and x < .5 then 1 when x >= .5 and x < .75 then 2 when x >= .75 and x < 1.01 then 3 end as band, count(*) as n from (select trace_id, boundary_index / 10.0::double as x from s) group by all")
def depth_bands(spark, d):
    rows = distributions.sizes(_hist(spark, d))
    return rows.groupBy("trace_id", gates.banded(F.col("boundary_index") / 10.0, (0, 0.25, 0.5, 0.75, 1.01)).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(with_(F1, HIST, PAIRS, CURVE) + """, pts as (select trace_id, boundary_index / 11.0::double as x, tvd_max_forward as y from c), g as (select unnest(range(0, 41)) / 40.0::double as g),
  br as (select trace_id, g, max(case when x <= g then x end) as lx, min(case when x >= g then x end) as hx from pts, g group by all)
select br.trace_id, g, round(case when lx is null then h.y when hx is null then l.y when lx = hx then l.y else l.y + (g - lx) / (hx - lx) * (h.y - l.y) end, 9) as value
from br left join pts l on l.trace_id = br.trace_id and l.x = lx left join pts h on h.trace_id = br.trace_id and h.x = hx""".replace("\n, pts", ", pts"))
def interp_curve(spark, d):
    rows = _curve(spark, d).withColumn("x", F.col("boundary_index") / 11.0)
    return curves.interpolated(rows, "x", "tvd_max_forward").select("trace_id", "g", r9("value"))


@query(with_(F1, HIST, PAIRS, CURVE) + "select trace_id % 8 as model, boundary_index, count(*) as n, round(avg(tvd_max_forward), 9) as mean, round(median(tvd_max_forward), 9) as median, round(coalesce(stddev_samp(tvd_max_forward) / sqrt(count(*)), 0), 9) as se from c group by all having count(*) >= 5")
def mean_curve(spark, d):
    rows = _curve(spark, d).withColumn("model", F.col("trace_id") % 8)
    return curves.mean_curve(rows, ["model"], "boundary_index", "tvd_max_forward").select("model", "boundary_index", "n", r9("mean"), r9("median"), r9("se"))


@query("select l_returnflag, x as upper_median from (select l_returnflag, l_extendedprice as x, row_number() over (partition by l_returnflag order by l_extendedprice) as t, count(*) over (partition by l_returnflag) as n from lineitem) where t = n // 2 + 1")
def upper_median(spark, d):
    return ranking.upper_median(spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice")


@query("select o_orderpriority, x as nearest_rank from (select o_orderpriority, o_totalprice as x, row_number() over (partition by o_orderpriority order by o_totalprice) as t, count(*) over (partition by o_orderpriority) as n from orders) where t = least(n - 1, floor(0.9::double * n)) + 1")
def nearest_rank(spark, d):
    return ranking.nearest_rank(spark.read.parquet(f"{d}/orders.parquet").select("o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice", 0.9)


@query("select c_mktsegment, count(*) as n, round(quantile_cont(c_acctbal, 0.25), 6) as q25, round(quantile_cont(c_acctbal, 0.5), 6) as q50, round(quantile_cont(c_acctbal, 0.75), 6) as q75 from customer group by all")
def linear_quantiles(spark, d):
    q = F.percentile("c_acctbal", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = spark.read.parquet(f"{d}/customer.parquet").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), q.alias("q"))
    return rows.select("c_mktsegment", "n", *[F.round(F.col("q")[i], 6).alias(f"q{p}") for i, p in enumerate((25, 50, 75))])


@query("select o_orderkey, (rank() over (order by o_orderdate) + (count(*) over (partition by o_orderdate) - 1) / 2)::double as rank from orders")
def avg_ranks(spark, d):
    return ranking.average_ranks(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderdate"), "o_orderdate", "rank").select("o_orderkey", F.col("rank").cast("double").alias("rank"))


@query("""select s_suppkey, round(least(1, min(raw) over (order by p desc)), 9) as q from (
  select s_suppkey, p, p * count(*) over () / row_number() over (order by p) as raw from (select s_suppkey, (s_suppkey * 7919 % 1000) / 1000.0::double as p from supplier))""")
def bh_adjust(spark, d):
    rows = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", (F.col("s_suppkey") * 7919 % 1000 / 1000.0).alias("p"))
    return ranking.adjust(rows, "p").select("s_suppkey", r9("q"))


@query("select p_partkey from (select p_partkey, row_number() over (order by p_partkey) - 1 as t from part) where t % 5 = 1")
def shard_stride(spark, d):
    return ranking.strided_shard(spark.read.parquet(f"{d}/part.parquet").select("p_partkey"), ["p_partkey"], 2, 5)


@query("""select c_custkey, (t // 64)::int as run, (t % ceil(n / 64))::int as stride from (
  select c_custkey, row_number() over (partition by c_nationkey order by c_name, c_custkey) - 1 as t, count(*) over (partition by c_nationkey) as n from customer)""")
def batch_partition(spark, d):
    rows, by, order = spark.read.parquet(f"{d}/customer.parquet"), ["c_nationkey"], ["c_name", "c_custkey"]
    return rows.select("c_custkey", ranking.batch_number(by, order, 64, False).alias("run"), ranking.batch_number(by, order, 64, True).alias("stride"))


@query("""select p_brand, array_to_string(case when len(o) <= 3 then o else [o[1], o[1 + round_even((len(o) - 1) / 2, 0)::int], o[len(o)]] end, '|') as examples
  from (select p_brand, list_sort(list(distinct p_type)) as o from part group by p_brand)""")
def spread_examples(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("o"))
    return rows.select("p_brand", F.array_join(ranking.spread_examples(F.col("o")), "|").alias("examples"))


@query(with_(F1, HIST, PAIRS, CURVE) + "select trace_id, boundary_index as sentence_index, round(tvd_max_forward - nxt, 9) as tvd_drop from (select *, lead(tvd_max_forward) over (partition by trace_id order by boundary_index) as nxt from c) where nxt is not null order by round(tvd_max_forward - nxt, 9) desc, trace_id, sentence_index limit 300")
def top_drops(spark, d):
    rows = curves.drops(_curve(spark, d)).select("trace_id", "sentence_index", r9("tvd_drop"))
    return ranking.top_rows(rows, [F.desc("tvd_drop"), "trace_id", "sentence_index"], 300)


@query("select vec_id, other, round(cosine, 6) as cosine from (select a.vec_id, b.vec_id as other, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)")
def cosine_pairs(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("embedding_b"))
    return rows.join(other, "vec_id").select("vec_id", "other", F.round(distributions.cosine("embedding", "embedding_b"), 6).alias("cosine"))


@query(with_(F1) + "select trace_id, boundary_index, rollout_index, entity, case when similarity::double < 0.5::double then 'counterfactual' else 'similar' end as arm from f1 where valid")
def arm_split(spark, d):
    from ..operators.importance import arm_of

    return numbered_samples(spark, d).where("valid").select("trace_id", "boundary_index", "rollout_index", "entity", arm_of(F.col("similarity"), F.lit(0.5)).alias("arm"))
