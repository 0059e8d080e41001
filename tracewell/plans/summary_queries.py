"""Summaries of studies: what their tables and figures show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import curves, distributions, gates, ledger, mentions, stats, summaries
from .fixtures import COMMIT, CURVE, F1, HIST, PAIRS, r9, registry, samples, table, with_
from .study_queries import _MENTIONS, _mentions

QUERIES, SQL, query = registry()


_ALL = with_(F1, HIST, PAIRS, CURVE, COMMIT).rstrip()


def _commits(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    hist = distributions.histogram(samples(spark, d))
    curve = curves.forward_curve(distributions.forward_pairs(hist))
    last = hist.groupBy("trace_id").agg(F.max("boundary_index").alias("last_boundary"))
    return hist, curve, curves.commitment(curve, last)


@query(_ALL + " select cut, count(case when x < cut then 1 end) as below, round(100 * count(case when x < cut then 1 end) / count(*), 6) as percent from (select commit_boundary / last_boundary as x from m where commit_boundary is not null), (select unnest([0.25, 0.5, 0.75])::double as cut) group by cut")
def cumulative_share(spark, d):
    x = _commits(spark, d)[2].where("commit_boundary is not null").select((F.col("commit_boundary") / F.col("last_boundary")).alias("x"))
    return summaries.cumulative_share(x, "x", (0.25, 0.5, 0.75)).select("cut", "below", F.round("percent", 6).alias("percent"))


@query(_ALL + " select b.bin, count(case when trace_id % 2 = 0 then 1 end) as even, count(case when trace_id % 2 = 1 then 1 end) as odd, count(trace_id) as total from (select unnest(['<.25', '<.5', '<.75', 'else']) as bin) b left join (select trace_id, case when x < .25 then '<.25' when x < .5 then '<.5' when x < .75 then '<.75' else 'else' end as bin from (select trace_id, commit_boundary / last_boundary as x from m where commit_boundary is not null)) c using (bin) group by b.bin")
def composition(spark, d):
    rows = _commits(spark, d)[2].where("commit_boundary is not null").select("trace_id", gates.depth_bin(F.col("commit_boundary") / F.col("last_boundary")).alias("bin"))
    found = summaries.composition(rows.withColumn("parity", F.col("trace_id") % 2), "bin", ("<.25", "<.5", "<.75", "else"), "parity", (0, 1), "p")
    return found.select("bin", F.col("p0").alias("even"), F.col("p1").alias("odd"), "total")


@query(_ALL + """, st as (select m.trace_id, max(h.c / s.n) as top, max(c.tvd_max_forward) as attained from m join h on h.trace_id = m.trace_id and h.boundary_index = commit_boundary join s on s.trace_id = m.trace_id and s.boundary_index = commit_boundary
  join c on c.trace_id = m.trace_id and c.boundary_index = commit_boundary group by m.trace_id)
select count(*) as n, round(quantile_cont(top, .25), 9) as top_q25, round(quantile_cont(top, .5), 9) as top_q50, round(quantile_cont(top, .9), 9) as top_q90, round(quantile_cont(attained, .5), 9) as attained_q50, round(avg((top > .5)::int), 9) as majority, round(avg((top < .6)::int), 9) as below_six_tenths from st""")
def state_at_commitment(spark, d):
    hist, curve, commits = _commits(spark, d)
    at = commits.where("commit_boundary is not null").select("trace_id", F.col("commit_boundary").alias("boundary_index"))
    top = distributions.concentration(hist).join(at, ["trace_id", "boundary_index"]).select("trace_id", "top_share")
    rows = top.join(curve.join(at, ["trace_id", "boundary_index"]).select("trace_id", "tvd_max_forward"), "trace_id")
    q = lambda c, p: F.round(F.percentile(c, F.lit(p)), 9)
    return rows.agg(
        F.count(F.lit(1)).alias("n"), q("top_share", 0.25).alias("top_q25"), q("top_share", 0.5).alias("top_q50"), q("top_share", 0.9).alias("top_q90"), q("tvd_max_forward", 0.5).alias("attained_q50"),
        F.round(F.avg((F.col("top_share") > 0.5).cast("int")), 9).alias("majority"), F.round(F.avg((F.col("top_share") < 0.6).cast("int")), 9).alias("below_six_tenths"),
    )


@query(_ALL + ", dr as (select c.trace_id, c.boundary_index, c.tvd_max_forward - lead(c.tvd_max_forward) over (partition by c.trace_id order by c.boundary_index) as x, commit_boundary from c join m using (trace_id)) select round(avg(x), 9) as mean_drop, round(avg(case when boundary_index < commit_boundary then x end), 9) as mean_before_commitment, round(100 * avg((x > 0)::int), 6) as percent_positive from dr where x is not null")
def drop_summary(spark, d):
    _, curve, commits = _commits(spark, d)
    rows = curves.drops(curve).join(commits, "trace_id")
    return rows.agg(r9_avg("tvd_drop").alias("mean_drop"), F.round(F.avg(F.when(F.col("sentence_index") < F.col("commit_boundary"), F.col("tvd_drop"))), 9).alias("mean_before_commitment"), F.round(100 * F.avg((F.col("tvd_drop") > 0).cast("int")), 6).alias("percent_positive"))


def r9_avg(c: str):
    return F.round(F.avg(c), 9)


@query("select top_segment, count(*) as nations from (select n_name, arg_max(c_mktsegment, (md, neg)) as top_segment from (select n_name, c_mktsegment, median(c_acctbal) as md, -ascii(c_mktsegment) as neg from customer join nation on c_nationkey = n_nationkey group by all) group by n_name) group by top_segment")
def direction_count(spark, d):
    each = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", F.col("c_mktsegment").alias("top_segment")).agg(F.percentile("c_acctbal", F.lit(0.5)).alias("md"))
    return summaries.direction_count(each, "n_name", "top_segment", "md", ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")).withColumnRenamed("units", "nations")


@query("select case_id, round(avg(w / g), 9) as difficulty from (select l_linenumber as model, l_orderkey % 100 as case_id, count(case when l_returnflag = 'A' then 1 end) as w, count(case when l_returnflag <> 'N' then 1 end) as g from lineitem group by all having g > 0) group by case_id")
def case_difficulty(spark, d):
    each = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("model"), (F.col("l_orderkey") % 100).alias("case_id")).agg(F.count_if(F.col("l_returnflag") == "A").alias("n_wrong"), F.count_if(F.col("l_returnflag") != "N").alias("n_graded"))
    return summaries.case_difficulty(each.where("n_graded > 0")).select("case_id", r9("case_wrong_frac", "difficulty"))


_KINDS = with_(_MENTIONS).rstrip() + """, ki as (select trace_id, sentence_index, case when sentence_index = first_index then 'first' when mentions_final = 1 then 'repeat' when mentions_other = 1 then 'other' else 'none' end as kind
  from (select *, min(case when mentions_final = 1 then sentence_index end) over (partition by trace_id) as first_index from me))
"""


def _kinds(spark, d) -> DataFrame:
    rows = mentions.first_mentions(_mentions(spark, d))
    return rows.select("trace_id", "sentence_index", gates.sentence_kind(F.col("is_first"), F.col("is_repeat"), F.col("mentions_other") == 1).alias("kind"))


@query(_KINDS + "select kind, count(*) as n, round(avg(sentence_index), 6) as mean, round(median(sentence_index), 6) as median, round(stddev_samp(sentence_index), 6) as std from ki group by kind")
def kind_summary(spark, d):
    found = summaries.describe(_kinds(spark, d), "sentence_index", ["kind"])
    return found.select("kind", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "std")))


@query(with_(_MENTIONS).rstrip() + " select case_id, round(avg(mentions_final), 9) as final_rate, round(avg(mentions_other), 9) as other_rate, count(distinct trace_id) as traces from me group by case_id")
def mention_rates(spark, d):
    return _mentions(spark, d).groupBy("case_id").agg(r9_avg("mentions_final").alias("final_rate"), r9_avg("mentions_other").alias("other_rate"), F.count_distinct("trace_id").alias("traces"))


@query("select s_suppkey, case when p < .001 then '***' when p < .01 then '**' when p < .05 then '*' else 'ns' end as stars from (select s_suppkey, (s_suppkey * 7919 % 1000) / 10000.0::double as p from supplier)")
def significance_stars(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", gates.stars(F.col("s_suppkey") * 7919 % 1000 / 10000.0, "ns").alias("stars"))


@query("select doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) as key from documents")
def embedding_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", text.embedding_key(F.coalesce("text", F.lit(""))).alias("key"))


@query("select conv_id, first_index + pos as rollout_index, continuation from (select conv_id, conv_id % 7 as first_index, unnest(range(0, len(l))) as pos, unnest(l) as continuation from (select conv_id, list(md5(text) order by turn) as l from conversations group by conv_id))")
def completion_rows(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.md5(F.col("text").cast("binary")).alias("m"))))["m"].alias("completions"))
    return ledger.sample_rows(rows.withColumn("first_index", F.col("conv_id") % 7)).select("conv_id", "rollout_index", "continuation")


@query("select doc_id, len(sentences)::int as n_sentences from (select doc_id, string_split(coalesce(text, ''), chr(10)) as sentences from documents) where len(sentences) > 12")
def over_length(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("trace_id"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n_sentences"))
    skipped = ledger.oversized(rows, 12)[1]
    return rows.join(skipped.select("trace_id"), "trace_id", "left_semi").select(F.col("trace_id").alias("doc_id"), "n_sentences")


@query("select p_partkey from part where p_size * 40 + 256 <= 1500")
def fits_context(spark, d):
    return ledger.fits_context(table(spark, d, "part").select("p_partkey", (F.col("p_size") * 40).alias("prefix_token_count")), 1500).select("p_partkey")


_DELTA_MODEL = """dm as (select trace_id % 8 as model, num100, i, trace_id, bool_and(100 * num <= num100 * den) as ok from p, (select unnest([10, 15, 20, 25])::bigint as num100) group by all),
  md as (select model, num100, median(x) as x from (select model, num100, trace_id, min(case when ok then i end) as x from dm group by all) where x is not null group by all),
  pr as (select a.num100, rank() over (partition by a.num100 order by a.x) + (count(*) over (partition by a.num100, a.x) - 1) / 2 as ra, rank() over (partition by a.num100 order by b.x) + (count(*) over (partition by a.num100, b.x) - 1) / 2 as rb from md a join md b on a.model = b.model and b.num100 = 20)"""


@query(with_(F1, HIST, PAIRS, _DELTA_MODEL) + "select num100 / 100.0::double as delta, count(*) as n, round(corr(ra, rb), 9) as rho from pr group by num100")
def ordering_drift(spark, d):
    pairs = distributions.forward_pairs(distributions.histogram(samples(spark, d)))
    calm = pairs.withColumn("hundredths", F.explode(F.array(*[F.lit(v).cast("long") for v in (10, 15, 20, 25)]))).groupBy("trace_id", "i", "hundredths").agg(F.bool_and(100 * F.col("num") <= F.col("hundredths") * F.col("den")).alias("calm"))
    each = calm.groupBy("trace_id", "hundredths").agg(F.min(F.when(F.col("calm"), F.col("i"))).alias("x")).where("x is not null")
    medians = each.groupBy((F.col("trace_id") % 8).alias("model"), "hundredths").agg(F.percentile("x", F.lit(0.5)).alias("x"))
    base = medians.where("hundredths = 20").select("model", F.col("x").alias("base"))
    rho = stats.spearman(medians.join(base, "model"), "x", "base", ["hundredths"])
    return rho.select((F.col("hundredths") / 100.0).alias("delta"), "n", r9("rho"))


@query("select l_suppkey as trace_id, round(100 * avg((l_discount > 0.05)::int), 6) as percent, printf('%.1f [%.1f, %.1f]', round(median(l_quantity), 1), round(quantile_cont(l_quantity, .25), 1), round(quantile_cont(l_quantity, .75), 1)) as spread from lineitem group by all")
def sensitivity_text(spark, d):
    q = lambda p: F.round(F.percentile("l_quantity", F.lit(p)), 1)
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("trace_id"))
    return rows.agg(F.round(100 * F.avg((F.col("l_discount") > 0.05).cast("int")), 6).alias("percent"), F.format_string("%.1f [%.1f, %.1f]", q(0.5), q(0.25), q(0.75)).alias("spread"))


@query("select user_id, event_type, n, round(n / sum(n) over (partition by user_id), 9) as share from (select user_id, event_type, count(*) as n from events group by all)")
def shares_by_user(spark, d):
    return summaries.shares(table(spark, d, "events"), ["user_id"], "event_type").select("user_id", "event_type", "n", r9("share"))
