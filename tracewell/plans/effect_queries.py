"""Queries over what sentences do: contrasts within traces, paired arms, and the reports over bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import curves, distributions, effects, selection, stats, summaries
from .fixtures import COMMIT, CURVE, F1, HIST, PAIRS, r9, registry, samples, table, with_
from .study_queries import _SCREEN, _screened

QUERIES, SQL, query = registry()

_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")

#: As a stand-in of sentences with their drops: a supplier's lines in order. Its returns name the final answer, its accepted ones another.
_EF = f"""e0 as (select l_suppkey % 8 as model, l_suppkey as trace_id, row_number() over (partition by l_suppkey order by {', '.join(_ORDER)}) - 1 as sentence_index,
  l_discount * 10 + l_tax as tvd_drop, l_linestatus = 'F' or l_quantity > 20 as pre_commit, l_quantity / 50 as token_position, (l_returnflag = 'R')::int as mentions_final, (l_returnflag = 'A' and l_quantity > 25)::int as mentions_other from lineitem),
ef as (select *, coalesce(sentence_index = first_index, false) as is_first, mentions_final = 1 and not coalesce(sentence_index = first_index, false) as is_repeat
  from (select *, min(case when mentions_final = 1 then sentence_index end) over (partition by trace_id) as first_index from e0))"""
_SETS = "(select unnest(['all', 'repeats', 'others']) as spec)"
_IN = "(spec = 'all' or is_first or (spec = 'repeats' and is_repeat) or (spec = 'others' and mentions_other = 1))"


def _within(keys: str, source: str) -> str:
    """Slopes of y on x within traces, with clustered errors, in each group of ``keys``."""
    return f"""u as (select *, x - avg(x) over w as dx, y - avg(y) over w as dy from ({source}) window w as (partition by {keys}, trace_id)),
g as (select {keys}, trace_id, count(*) as n, sum(x) as xs, sum(dx * dx) as xx, sum(dx * dy) as xy from u group by all),
b as (select *, sum(xy) over (partition by {keys}) / nullif(sum(xx) over (partition by {keys}), 0) as beta from g),
fit as (select {keys}, max(beta) as beta, sum(n)::bigint as n, count(*) as units, sum(xs)::bigint as treated, sum((xy - beta * xx) * (xy - beta * xx)) as meat, sum(xx) as bread from b group by all),
sl as (select *, sqrt(meat * (units / nullif(units - 1, 0) * (n - 1) / nullif(n - 1 - units, 0))) / nullif(bread, 0) as se from fit)"""


def _sentences(spark, d) -> DataFrame:
    order = Window.partitionBy("l_suppkey").orderBy(*_ORDER)
    rows = table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 8).alias("model"), F.col("l_suppkey").alias("trace_id"), (F.row_number().over(order) - 1).alias("sentence_index"), (F.col("l_discount") * 10 + F.col("l_tax")).alias("tvd_drop"),
        ((F.col("l_linestatus") == "F") | (F.col("l_quantity") > 20)).alias("pre_commit"), (F.col("l_quantity") / 50).alias("token_position"), (F.col("l_returnflag") == "R").cast("int").alias("mentions_final"),
        ((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 25)).cast("int").alias("mentions_other"),
    )
    from ..operators.mentions import first_mentions

    return first_mentions(rows)


@query(with_(_EF, _within("spec", f"select ef.*, spec, is_first::int as x, tvd_drop as y from ef, {_SETS} where {_IN}")) + "select spec, round(beta, 9) as coef, round(se, 9) as se, n, units as traces, treated as n_first from sl where treated >= 1")
def contrast_effects(spark, d):
    return effects.first_mention_effects(_sentences(spark, d)).select("spec", r9("coef"), r9("se"), "n", "traces", "n_first")


@query(with_(_EF, _within("spec, model", f"select ef.*, spec, is_first::int as x, tvd_drop as y from ef, {_SETS} where {_IN}")) + "select spec, model, round(beta, 9) as coef, round(se, 9) as se, n, units as traces, treated as n_first from sl where treated >= 1")
def contrast_effects_by_model(spark, d):
    return effects.first_mention_effects(_sentences(spark, d), ["model"]).select("spec", "model", r9("coef"), r9("se"), "n", "traces", "n_first")


@query(with_(_EF, _within("model", "select *, is_first::int as x, tvd_drop as y from ef")) + """select model, m as median_sentences, round(beta, 9) as coef, round(dm, 9) as mean_drop, round(beta / dm, 9) as in_sentence_units from sl
  join (select model, median(n)::double as m from (select model, trace_id, count(*) as n from ef group by all) group by model) using (model) join (select model, avg(tvd_drop) as dm from ef group by model) using (model)""")
def effects_in_sentences(spark, d):
    return effects.effects_in_sentences(_sentences(spark, d)).select("model", "median_sentences", r9("coef"), r9("mean_drop"), r9("in_sentence_units"))


_FOUR = "(select unnest([{'regressor': 'first_mention', 'comparison': 'all'}, {'regressor': 'mentions_final', 'comparison': 'all'}, {'regressor': 'first_mention', 'comparison': 'others'}, {'regressor': 'mentions_final', 'comparison': 'others'}], recursive := true))"


@query(with_(_EF, "st as (select ef.*, regressor, comparison, case regressor when 'first_mention' then is_first::int else mentions_final end as x, tvd_drop as y from ef, " + _FOUR + ")", _within("regressor, comparison", "select * from st where comparison = 'all' or x = 1 or mentions_other = 1"))
  + "select regressor, comparison, n, treated, round(beta, 9) as coef, round(se, 9) as se, round(beta / se, 6) as z from sl")
def mention_effects(spark, d):
    return effects.mention_effects(_sentences(spark, d)).select("regressor", "comparison", "n", "treated", r9("coef"), r9("se"), F.round("z", 6).alias("z"))


@query(with_(_EF, f"""v as (select spec, is_first::int - avg(is_first::int) over w as a, token_position - avg(token_position) over w as b, tvd_drop - avg(tvd_drop) over w as y from ef, {_SETS} where {_IN} window w as (partition by spec, trace_id))""")
  + """select spec, round(sum(a * y) / sum(a * a), 8) as coef, round((sum(a * y) * sum(b * b) - sum(b * y) * sum(a * b)) / (sum(a * a) * sum(b * b) - sum(a * b) * sum(a * b)), 8) as coef_with_depth,
  round((sum(b * y) * sum(a * a) - sum(a * y) * sum(a * b)) / (sum(a * a) * sum(b * b) - sum(a * b) * sum(a * b)), 8) as coef_of_depth from v group by spec""")  # fmt: skip
def effects_with_depth(spark, d):
    return effects.effects_with_depth(_sentences(spark, d)).select("spec", *(F.round(c, 8).alias(c) for c in ("coef", "coef_with_depth", "coef_of_depth")))


@query(with_(_EF) + "select trace_id, round(f, 9) as first, round(r, 9) as repeats, round(f - r, 9) as difference from (select trace_id, avg(case when is_first then tvd_drop end) as f, avg(case when is_repeat then tvd_drop end) as r from ef group by all) where f is not null and r is not null")
def paired_first_repeat(spark, d):
    return effects.first_and_repeats(_sentences(spark, d)).select("trace_id", r9("first"), r9("repeats"), r9("difference"))


@query(with_(_EF, _within("model", "select *, is_first::int as x, tvd_drop as y from ef"), """rk as (select model, is_first, rank() over (partition by model order by tvd_drop) + (count(*) over (partition by model, tvd_drop) - 1) / 2 as r, count(*) over (partition by model, tvd_drop) as ties from ef),
mw as (select model, count(case when is_first then 1 end)::double as a, count(case when not is_first then 1 end)::double as c, sum(case when is_first then r end) as ra, sum((ties * ties - 1)::double) as t from rk group by model),
zz as (select model, greatest(abs(ra - a * (a + 1) / 2 - a * c / 2) - 0.5, 0) / sqrt(a * c / 12 * ((a + c + 1) - t / ((a + c) * (a + c - 1)))) as z from mw)""")
  + "select model, round(beta, 9) as coef, round(rd, 9) as raw_diff, sign(beta) = sign(rd) as same_sign, round(z, 6) as z_marginal from sl join zz using (model) join (select model, avg(case when is_first then tvd_drop end) - avg(case when not is_first then tvd_drop end) as rd from ef group by model) using (model)")
def effect_agreement(spark, d):
    rows = _sentences(spark, d)
    found = effects.agreement(rows)
    z = stats.mann_whitney(rows.withColumn("_k", F.when(F.col("is_first"), "a").otherwise("b")), "_k", "tvd_drop", ["model"])
    return found.join(z.select("model", "z"), "model").select("model", r9("coef"), r9("raw_diff"), (F.signum("coef") == F.signum("raw_diff")).alias("same_sign"), F.round("z", 6).alias("z_marginal"))


@query(with_(_EF) + "select rank, trace_id, sentence_index, round(tvd_drop, 9) as tvd_drop, case when is_first then 'first' when is_repeat then 'repeat' when mentions_other = 1 then 'other' else 'none' end as kind, coalesce(ss[sentence_index + 1], '') as sentence from (select *, row_number() over (order by tvd_drop desc, trace_id, sentence_index) as rank from ef) left join (select s_suppkey as trace_id, string_split(s_name, '#') as ss from supplier) using (trace_id) where rank <= 300")
def top_drops_with_text(spark, d):
    texts = table(spark, d, "supplier").select(F.col("s_suppkey").alias("trace_id"), F.split("s_name", "#").alias("sentences"))
    return effects.largest_drops(_sentences(spark, d), texts).select("rank", "trace_id", "sentence_index", r9("tvd_drop"), "kind", "sentence")


_RIVAL = """ra as (select model, trace_id, avg(case when sentence_index < c then mentions_other end) as before, avg(case when sentence_index >= c then mentions_other end) as after, count(case when sentence_index < c then 1 end) as n_before, count(case when sentence_index >= c then 1 end) as n_after
  from (select *, 20 + trace_id % 30 as c from ef) group by all having n_before >= 5 and n_after >= 5)"""


def _rates(spark, d) -> DataFrame:
    rows = _sentences(spark, d)
    return effects.rival_rates(rows, rows.select("trace_id", (20 + F.col("trace_id") % 30).alias("commit_boundary")).distinct())


@query(with_(_EF, _RIVAL, """dd as (select model, round(after - before, 9) as v from ra), rk as (select *, rank() over (partition by model order by abs(v)) + (count(*) over (partition by model, abs(v)) - 1) / 2 as rk from dd where v <> 0),
w as (select model, sum(case when v > 0 then rk else 0 end) as wp, sum(case when v < 0 then rk else 0 end) as wm from rk group by model)""") + "select model, traces, round(bm, 6) as before_median, round(am, 6) as after_median, round(dm, 6) as delta_median, round(wp, 3) as w_plus, round(wm, 3) as w_minus from (select model, count(*) as traces, median(before) as bm, median(after) as am, median(round(after, 9) - round(before, 9)) as dm from ra group by model) left join w using (model)")
def rival_tests(spark, d):
    rates = _rates(spark, d)
    # differences at 9 digits, so that equal ones tie whatever the order of sums
    tidy = rates.withColumns({"after": F.round(F.round(F.col("after") - F.col("before"), 9) + F.round("before", 9), 9), "before": F.round("before", 9)})
    found = effects.rival_tests(tidy)
    return found.select("model", "traces", *(F.round(c, 6).alias(c) for c in ("before_median", "after_median", "delta_median")), F.round("w_plus", 3).alias("w_plus"), F.round("w_minus", 3).alias("w_minus"))


@query("with p as (select l_suppkey % 8 as model, l_partkey % 50 as case_id, avg(case when l_returnflag = 'R' then l_discount * 10 + l_tax end) as c, avg(case when l_returnflag <> 'R' then l_discount * 10 + l_tax end) as w from lineitem group by all) select model, case_id, round(c, 9) as correct, round(w, 9) as wrong from p where c is not null and w is not null")
def paired_arms(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 8).alias("model"), (F.col("l_partkey") % 50).alias("case_id"), (F.col("l_returnflag") == "R").alias("base_is_correct"), (F.col("l_discount") * 10 + F.col("l_tax")).alias("d"))
    return summaries.paired_arms(rows, ["model", "case_id"], "base_is_correct", "d").select("model", "case_id", r9("correct"), r9("wrong"))


@query(with_(_SCREEN) + """select o.model, o.case_id, source, round(n_wrong / n_graded, 9) as wrong_frac, round(case_wrong_frac, 9) as case_wrong_frac from (select distinct l_linenumber as model, 'c' || (l_orderkey % 250) as case_id from lineitem) o join oc using (model, case_id)
  join (select case_id, avg(n_wrong / n_graded) as case_wrong_frac from oc group by case_id) using (case_id) left join (select 'c' || i as case_id, 's' || (i % 3) as source from range(0, 150) t(i)) using (case_id)""")
def analysis_frame(spark, d):
    traces = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("model"), F.concat(F.lit("c"), (F.col("l_orderkey") % 250).cast("string")).alias("case_id")).distinct()
    sources = spark.range(150).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("case_id"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"))
    found = summaries.analysis_frame(traces, selection.outcomes(_screened(spark, d)), sources)
    return found.select("model", "case_id", "source", r9("wrong_frac"), r9("case_wrong_frac"))


_ALL = with_(F1, HIST, PAIRS, CURVE, COMMIT).rstrip()
_SWEEP = """, sw as (select trace_id, num100, min(case when ok then i end) as cb from (select trace_id, i, num100, bool_and(100 * num <= num100 * den) as ok from p, (select unnest([10, 20, 30])::bigint as num100) group by all) group by all),
sh as (select trace_id, boundary_index, max(case when turn = 1 then c / n end) as top, coalesce(max(case when turn = 2 then c / n end), 0) as second from (select h.*, n, row_number() over (partition by h.trace_id, h.boundary_index order by c desc, entity) as turn from h join s using (trace_id, boundary_index)) group by all),
st as (select num100 / 100.0::double as delta, cb is not null as commits, cb / 11.0::double as depth, top, second from sw left join sh on sh.trace_id = sw.trace_id and sh.boundary_index = cb)
"""


def _sweep(spark, d) -> DataFrame:
    hist = distributions.histogram(samples(spark, d))
    pairs = distributions.forward_pairs(hist).withColumn("hundredths", F.explode(F.array(*(F.lit(v).cast("long") for v in (10, 20, 30)))))
    calm = pairs.groupBy("trace_id", "i", "hundredths").agg(F.bool_and(100 * F.col("num") <= F.col("hundredths") * F.col("den")).alias("calm"))
    commits = calm.groupBy("trace_id", (F.col("hundredths") / 100.0).alias("delta")).agg(F.min(F.when(F.col("calm"), F.col("i"))).alias("boundary_index"))
    shares = distributions.concentration(hist).select("trace_id", "boundary_index", "top_share", "second_share")
    rows = commits.join(shares, ["trace_id", "boundary_index"], "left")
    return rows.select("trace_id", "delta", F.col("boundary_index").isNotNull().alias("commits"), (F.col("boundary_index") / 11.0).alias("depth"), "top_share", "second_share")


def _iqr(value: str, digits: int) -> str:
    q = lambda p: f"round(quantile_cont(case when commits then {value} end, {p}), {digits})"
    return f"printf('%.{digits}f [%.{digits}f, %.{digits}f]', {q(0.5)}, {q(0.25)}, {q(0.75)})"


@query(_ALL + _SWEEP + f"""select delta, printf('%.1f%%', round(100 * avg(commits::int), 1)) as committing, {_iqr('depth', 3)} as depth_median_iqr, printf('%.1f%%', round(100 * avg(case when commits then (depth < 0.5)::int end), 1)) as before_mid_trace,
  {_iqr('top', 2)} as top_answer_share, {_iqr('second', 2)} as second_answer_share from st group by delta""")
def sensitivity_table(spark, d):
    return summaries.sensitivity_table(_sweep(spark, d))


@query(_ALL + _SWEEP + "select delta, round(100 * avg(commits::int), 6) as committing, round(list_sort(list(depth) filter (where commits))[1 + count(case when commits then 1 end) // 2], 9) as median_depth, round(list_sort(list(top) filter (where commits))[1 + count(case when commits then 1 end) // 2], 9) as top_share from st group by delta")
def delta_console(spark, d):
    return summaries.delta_summary(_sweep(spark, d)).select("delta", F.round("committing", 6).alias("committing"), r9("median_depth"), r9("top_share"))


_DROPS = """, dr as (select c.trace_id, c.boundary_index as sentence_index, c.tvd_max_forward as tvd_before, c.tvd_max_forward - lead(c.tvd_max_forward) over (partition by c.trace_id order by c.boundary_index) as tvd_drop, commit_boundary from c join m using (trace_id)),
dp as (select *, sentence_index < commit_boundary as pre from dr where tvd_drop is not null and commit_boundary is not null)
"""


def _dropped(spark, d) -> DataFrame:
    hist = distributions.histogram(samples(spark, d))
    curve = curves.forward_curve(distributions.forward_pairs(hist))
    commits = curves.commitment(curve, hist.groupBy("trace_id").agg(F.max("boundary_index").alias("last_boundary"))).where("commit_boundary is not null")
    return curves.drops(curve).join(commits, "trace_id").withColumn("pre_commit", F.col("sentence_index") < F.col("commit_boundary"))


@query(_ALL + _DROPS + """select count(*) as sentences, count(case when not pre then 1 end) as after, round(100 * avg((not pre)::int), 6) as percent_after, round(max(case when not pre then tvd_before end), 9) as highest_curve_after, round(max(case when not pre then tvd_drop end), 9) as highest_drop_after,
  round(max(case when pre then tvd_drop end), 9) as highest_drop_before, round(avg(case when not pre then tvd_drop end), 9) as mean_drop_after, round(avg(case when pre then tvd_drop end), 9) as mean_drop_before from dp""")
def restriction_summary(spark, d):
    found = summaries.restriction_summary(_dropped(spark, d))
    return found.select("sentences", "after", F.round("percent_after", 6).alias("percent_after"), *(r9(c) for c in ("highest_curve_after", "highest_drop_after", "highest_drop_before", "mean_drop_after", "mean_drop_before")))


@query(with_(_EF) + "select kind, count(*) as sentences, round(100 * avg(pre_commit::int), 6) as percent_before from (select 'first' as kind, * from ef where is_first union all select 'repeat', * from ef where is_repeat union all select 'other', * from ef where mentions_other = 1) group by kind")
def kinds_before_commitment(spark, d):
    return summaries.kinds_before_commitment(_sentences(spark, d)).select("kind", "sentences", F.round("percent_before", 6).alias("percent_before"))


_TOKENS = """, ats as (select c.trace_id, c.boundary_index, c.tvd_max_forward as v, c.boundary_index / m.last_boundary as depth, max(case when c.boundary_index = 0 then c.tvd_max_forward end) over w as v0,
    max(case when c.boundary_index = m.commit_boundary then c.tvd_max_forward end) over w as vc, max(case when c.boundary_index = m.commit_boundary then c.boundary_index / m.last_boundary end) over w as dc
  from c join m using (trace_id) where m.commit_boundary > 0 and c.boundary_index <= m.commit_boundary window w as (partition by c.trace_id)),
wi as (select trace_id, f, max(dc) - max(depth) as width from ats, (select unnest([0.8, 1.0])::double as f) where v0 - vc > 0 and (v - vc) / (v0 - vc) >= f - 1e-12 group by all),
tk as (select trace_id, trace_id % 8 as model, 500 + 100 * trace_id as r, max(case when f = 0.8 then width end) * (500 + 100 * trace_id) as t80, max(case when f = 1 then width end) * (500 + 100 * trace_id) as t100 from wi group by trace_id)
"""


def _cells(name: str, c: str) -> str:
    return f"round(avg({c}), 6) as {name}_mean, " + ", ".join(f"round(quantile_cont({c}, {p}), 6) as {name}_{n}" for p, n in ((0.5, "median"), (0.25, "q25"), (0.75, "q75")))


@query(_ALL + _TOKENS + f"select model, count(*) as n, round(median(r), 6) as reasoning_median, {_cells('tok80', 't80')}, {_cells('tok100', 't100')} from tk group by model")
def token_widths(spark, d):
    hist = distributions.histogram(samples(spark, d))
    curve = curves.forward_curve(distributions.forward_pairs(hist))
    commits = curves.commitment(curve, hist.groupBy("trace_id").agg(F.max("boundary_index").alias("last_boundary")))
    tokens = commits.select("trace_id", (F.col("trace_id") % 8).alias("model"), (500 + 100 * F.col("trace_id")).alias("reasoning_tokens"))
    found = summaries.token_widths(curves.drop_widths(curve, commits, F.col("boundary_index") / F.col("last_boundary")), tokens, ["model"])
    return found.select("model", "n", *(F.round(c, 6).alias(c) for c in found.columns if c not in ("model", "n")))


@query(with_(F1) + "select trace_id, boundary_index, count(case when similarity < 0.2::float then 1 end) as missing, count(*) as n from f1 group by all having missing > 0 order by missing desc, trace_id, boundary_index limit 10")
def missing_similarity(spark, d):
    rows = samples(spark, d).withColumn("similarity", F.when(F.col("similarity") >= F.lit(0.2).cast("float"), F.col("similarity")))
    return summaries.missing_similarity(rows).select("trace_id", "boundary_index", "missing", "n")
