"""Queries over cases, selections, ledgers, mentions, tests and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import distributions, importance, ledger, mentions, ranking, selection, stats, summaries
from .fixtures import F1, numbered_samples, r9, registry, samples, table, with_

QUERIES, SQL, query = registry()


@query("select doc_id, md5(regexp_replace(coalesce(text, ''), '[^a-zA-Z]', '', 'g')) as case_id from documents")
def case_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.letters_id(F.coalesce("text", F.lit(""))).alias("case_id"))


@query("select source, doc_id, case_id from (select *, row_number() over (partition by source, case_id order by doc_id) as t from (select source, doc_id, md5(regexp_replace(text, '[^a-zA-Z]', '', 'g')) as case_id from documents where not regexp_full_match(coalesce(text, ''), '\\s*'))) where t = 1")
def cohort_dedup(spark, d):
    return selection.cases(table(spark, d, "documents"), ["doc_id"]).select("source", "doc_id", "case_id")


@query("select 0 as source_ord, conv_id as id, text from conversations where turn = 0 union all select 1, item_id, text from benchmark")
def source_union(spark, d):
    first = table(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("id"), "text")
    return selection.together([first, table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")]).select("source_ord", "id", "text")


def _quotas(available: str, total: str) -> str:
    return f"""av as ({available}), o as (select *, coalesce(sum(available) over (order by available, source rows between unbounded preceding and 1 preceding), 0) as taken,
  count(*) over () - row_number() over (order by available, source) + 1 as lft from av), w as (select *, available <= floor(({total} - taken) / lft) as whole from o),
x as (select *, {total} - coalesce(sum(case when whole then available end) over (), 0) as rest, count(*) over (partition by whole) as n, row_number() over (partition by whole order by source) - 1 as t from w),
quota as (select source, available, case when whole then available else rest // n + case when t < rest - (rest // n) * n then 1 else 0 end end::bigint as quota from x)"""


#: Sources of uneven sizes: five nations by themselves, the others by region and segment.
_SOURCE = "case when n_nationkey < 5 then n_name else 'region ' || n_regionkey || ' ' || c_mktsegment end"
_CUSTOMERS = f"select {_SOURCE} as source, count(*) as available from customer join nation on c_nationkey = n_nationkey group by all"


def _pool(spark, d) -> DataFrame:
    rows = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    source = F.when(F.col("n_nationkey") < 5, F.col("n_name")).otherwise(F.concat(F.lit("region "), F.col("n_regionkey").cast("string"), F.lit(" "), "c_mktsegment"))
    return rows.select(source.alias("source"), F.col("c_name").alias("case_id"))


def _quota(spark, d) -> DataFrame:
    return selection.quotas(_pool(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("available")), 180)


@query(with_(_quotas(_CUSTOMERS, "180")) + "select source, available, quota from quota")
def source_quotas(spark, d):
    return _quota(spark, d)


_DRAW = f""", dr as (select source, case_id from (select source, case_id, row_number() over (partition by source order by sha256('2026:' || case_id), case_id) as t
  from (select {_SOURCE} as source, c_name as case_id from customer join nation on c_nationkey = n_nationkey)) join quota using (source) where t <= quota)
"""


@query(with_(_quotas(_CUSTOMERS, "180")).rstrip() + _DRAW + "select source, case_id from dr")
def pool_hash_draw(spark, d):
    return selection.draw(_pool(spark, d), _quota(spark, d), "2026").select("source", "case_id")


@query(with_(_quotas(_CUSTOMERS, "180")).rstrip() + _DRAW + "select substr(sha256(string_agg(case_id, ',' order by case_id)), 1, 16) as digest from dr")
def pool_digest(spark, d):
    return selection.id_digest(selection.draw(_pool(spark, d), _quota(spark, d), "2026"))


_SCREEN = """sc as (select model, case_id, t as rollout_index, case l_returnflag when 'R' then true when 'A' then false end as is_correct from (
  select l_linenumber as model, 'c' || (l_orderkey % 200) as case_id, l_returnflag, row_number() over (partition by l_linenumber, l_orderkey % 200
    order by l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as t from lineitem)),
oc as (select model, case_id, count(case when is_correct then 1 end) as n_correct, count(case when not is_correct then 1 end) as n_wrong, count(*) as n_graded,
  min(case when is_correct then rollout_index end) as correct_index, min(case when not is_correct then rollout_index end) as wrong_index from sc where is_correct is not null group by all)"""


def _screened(spark, d) -> DataFrame:
    key = Window.partitionBy("model", "case_id").orderBy("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = table(spark, d, "lineitem").select(
        F.col("l_linenumber").alias("model"), F.concat(F.lit("c"), (F.col("l_orderkey") % 200).cast("string")).alias("case_id"), F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False).alias("is_correct"),
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    )
    return rows.withColumn("rollout_index", F.row_number().over(key) - 1)


@query(with_(_SCREEN) + "select * from oc")
def outcomes(spark, d):
    return selection.outcomes(_screened(spark, d))


_SELECT = """, ft as (select *, count(*) over (partition by case_id) as depth from oc where n_correct >= 1 and n_wrong >= 1),
ch as (select *, depth >= {core} as in_core, row_number() over (partition by model, depth >= {core} order by depth desc, case_id) as t,
  sum((depth >= {core})::int) over (partition by model) as n_core from ft)
select model, case_id, n_correct, n_wrong, n_graded, correct_index, wrong_index, depth, in_core from ch where in_core or t <= {floor} - n_core"""


@query(with_(_SCREEN).rstrip() + _SELECT.format(core=7, floor=0))
def select_core(spark, d):
    return selection.select(selection.outcomes(_screened(spark, d)), core_min=7, floor=0).select("model", "case_id", "n_correct", "n_wrong", "n_graded", "correct_index", "wrong_index", "depth", "in_core")


@query(with_(_SCREEN).rstrip() + _SELECT.format(core=7, floor=150))
def select_topup(spark, d):
    return selection.select(selection.outcomes(_screened(spark, d)), core_min=7, floor=150).select("model", "case_id", "n_correct", "n_wrong", "n_graded", "correct_index", "wrong_index", "depth", "in_core")


@query("select case_id, round(avg(share), 9) as modal_share, round(avg(n), 9) as n_entities, count(*) as n_models from (select model, case_id, max(c) / sum(c) as share, count(*) as n from (select l_suppkey % 8 as model, l_partkey % 50 as case_id, l_returnflag || l_linestatus as entity, count(*) as c from lineitem group by all) group by all) group by case_id")
def modal_share(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 8).alias("model"), (F.col("l_partkey") % 50).alias("case_id"), F.concat("l_returnflag", "l_linestatus").alias("entity"))
    return selection.modal_share(rows).select("case_id", r9("modal_share"), r9("n_entities"), "n_models")


@query("select distinct source || '/' || lang as case_id from documents where n_chars >= 9000 or doc_id % 97 = 0")
def capped(spark, d):
    rows = table(spark, d, "documents").select(F.concat_ws("/", "source", "lang").alias("case_id"), F.when(F.col("doc_id") % 97 == 0, "length").otherwise("stop").alias("finish_reason"), F.col("n_chars").alias("n_tokens"))
    return selection.capped(rows, 9000)


@query(with_(F1) + "select trace_id, boundary_index, count(*) as have, max(rollout_index) + 1 as next_index from f1 group by all")
def progress(spark, d):
    return ledger.progress(numbered_samples(spark, d))


@query(with_(F1) + """, pr as (select trace_id, boundary_index, count(*) as have, max(rollout_index) + 1 as nxt from f1 where boundary_index <> trace_id % 12 group by all)
select trace_id, boundary_index, 60 - coalesce(have, 0) as owed, coalesce(nxt, 0) as first_index from (select * from (select distinct trace_id from f1), (select unnest(range(0, 12))::int as boundary_index)) left join pr using (trace_id, boundary_index) where 60 - coalesce(have, 0) > 0""".replace("\n, pr", ", pr").replace(")\nselect", ")\nselect"))
def pending(spark, d):
    rows = numbered_samples(spark, d)
    traces = rows.groupBy("trace_id").agg(F.max("boundary_index").alias("last_boundary"))
    return ledger.pending(traces, ledger.progress(rows.where(F.col("boundary_index") != F.col("trace_id") % 12)), 60)


@query("select l_orderkey, l_linenumber, l_partkey, l_returnflag || l_linestatus as entity from lineitem where l_quantity > 5 and l_returnflag || l_linestatus not in ('AF', 'NO', 'RF', 'NF')")
def require_graded(spark, d):
    rows = table(spark, d, "lineitem").where("l_quantity > 5").select("l_orderkey", "l_linenumber", "l_partkey", F.concat("l_returnflag", "l_linestatus").alias("entity"))
    return ledger.missing(rows, spark.createDataFrame([("AF",), ("NO",), ("RF",), ("NF",)], "entity string"), ["entity"])


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def left_anti_resume(spark, d):
    return ledger.missing(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("select w.conv_id, w.place, c.text from (select distinct conv_id, (conv_id * 7) % 100 as place from conversations) w join (select conv_id, arg_min(text, turn) as text from conversations group by conv_id) c using (conv_id)")
def ordered_select(spark, d):
    rows = table(spark, d, "conversations")
    wanted = rows.select("conv_id", ((F.col("conv_id") * 7) % 100).alias("place")).distinct()
    return ledger.in_order(rows.select("conv_id", "turn", "text"), wanted, "conv_id", ["turn"]).select("conv_id", "place", "text")


@query("select case_id, answer, n, row_number() over (partition by case_id order by first, answer) as seen from (select source as case_id, trim(lang) as answer, count(*) as n, min(doc_id) as first from documents where coalesce(trim(lang), '') <> '' group by all)")
def first_seen(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("case_id"), F.col("lang").alias("answer"), "doc_id")
    return selection.first_seen(rows, ["doc_id"])


_NORMAL = r"trim(regexp_replace(regexp_replace(lower({}), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("select case_id, answer, first_value(answer) over (partition by case_id, " + _NORMAL.format("answer") + " order by seen) as entity from (select 'p' as case_id, p_name as answer, row_number() over (order by min(p_partkey), p_name) as seen from (select p_partkey, case when p_partkey % 3 = 0 then upper(p_name) else p_name end as p_name from part) group by p_name)")
def exact_entities(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    rows = table(spark, d, "part").select(F.lit("p").alias("case_id"), name.alias("answer"), "p_partkey")
    return selection.exact_entities(selection.first_seen(rows, ["p_partkey"])).select("case_id", "answer", "entity")


_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^a-z0-9]+'), lambda t: t <> '')"
_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"


def _words(c: str) -> str:
    kept = f"list_filter({_TOKENS.format(c)}, lambda t: not list_contains({_STOP}, t))"
    return f"list_filter({kept}, lambda t, i: list_position({kept}, t) = i)"


@query(f"select item_id, array_to_string({_words('text')}, ' ') as words from benchmark")
def content_words(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(text.content_words(F.col("text")), " ").alias("words"))


#: As a stand-in of answers: the third to fifth word of a document; its lines are the sentences.
_ANSWER = "array_to_string(string_split(coalesce(text, ''), ' ')[3:5], ' ')"
_MENTIONS = f"""tr as materialized (select doc_id as trace_id, source as case_id, {_ANSWER} as raw_answer, string_split(coalesce(text, ''), chr(10)) as sentences from documents),
ew as materialized (select case_id, list(w order by entity) as words from (select case_id, entity, {_words('entity')} as w from (select distinct case_id, raw_answer as entity from tr where raw_answer <> '')) where len(w) > 0 group by case_id),
fi as materialized (select trace_id, case_id, sentences, {_words('raw_answer')} as final from tr),
ot as materialized (select fi.*, list_filter(coalesce(words, []), lambda w: w <> final) as others from fi left join ew using (case_id)),
se as materialized (select trace_id, case_id, final, others, len(sentences) as n_sentences, unnest(range(0, len(sentences)))::int as sentence_index, array_to_string({_TOKENS.format('unnest(sentences)')}, ' ') as flat from ot),
fl as materialized (select *, len(final) > 0 and len(list_filter(final, lambda w: not contains(flat, w))) = 0 as f from se),
me as (select case_id, trace_id, sentence_index, n_sentences::int as n_sentences, f::int as mentions_final,
  (not f and len(list_filter(others, lambda w: len(list_filter(w, lambda x: not contains(flat, x))) = 0)) > 0)::int as mentions_other, array_to_string(final, ' ') as final_words, len(others)::int as n_other_entities from fl)"""


def _mentions(spark, d) -> DataFrame:
    parts = F.split(F.coalesce("text", F.lit("")), " ", 6)  # five words and the rest
    rows = table(spark, d, "documents").select(
        F.col("doc_id").alias("trace_id"), F.col("source").alias("case_id"), F.array_join(F.slice(parts, 3, 3), " ").alias("raw_answer"), F.split(F.coalesce("text", F.lit("")), "\n").alias("sentences")
    )
    words = mentions.case_words(rows.select("case_id", F.col("raw_answer").alias("entity")))
    return mentions.mentions(rows, words)


@query(with_(_MENTIONS) + "select * from me")
def mention_flags(spark, d):
    return _mentions(spark, d)


@query(with_(_MENTIONS) + "select trace_id, sentence_index, first_index, coalesce(sentence_index = first_index, false) as is_first, mentions_final = 1 and not coalesce(sentence_index = first_index, false) as is_repeat from (select *, min(case when mentions_final = 1 then sentence_index end) over (partition by trace_id) as first_index from me)")
def first_mention(spark, d):
    return mentions.first_mentions(_mentions(spark, d)).select("trace_id", "sentence_index", "first_index", "is_first", "is_repeat")


@query("""select trace_id, round(avg(case when not post then f end), 9) as before, round(avg(case when post then f end), 9) as after, count(case when not post then 1 end) as n_before, count(case when post then 1 end) as n_after from (
  select user_id as trace_id, (event_type = 'click')::int::double as f, row_number() over (partition by user_id order by ts, event_id) - 1 >= 20 + user_id % 30 as post from events) group by all having n_before >= 5 and n_after >= 5""")
def rival_rate(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select(F.col("user_id").alias("trace_id"), (F.row_number().over(order) - 1).alias("sentence_index"), "event_type")
    found = mentions.rate_before_after(rows, 20 + F.col("trace_id") % 30, F.col("event_type") == "click")
    return found.select("trace_id", r9("before"), r9("after"), "n_before", "n_after")


@query("""with u as (select *, x - avg(x) over (partition by model, unit) as dx, y - avg(y) over (partition by model, unit) as dy from (select l_suppkey % 8 as model, l_suppkey as unit, (l_returnflag = 'R')::int::double as x, l_discount * 10 + l_tax as y from lineitem)),
g as (select model, unit, count(*) as n, sum(dx * dx) as xx, sum(dx * dy) as xy from u group by all), b as (select *, sum(xy) over (partition by model) / sum(xx) over (partition by model) as beta from g),
s as (select model, max(beta) as beta, sum(n)::bigint as n, count(*) as units, sum((xy - beta * xx) * (xy - beta * xx)) as meat, sum(xx) as bread from b group by model)
select model, round(beta, 9) as beta, round(sqrt(meat * (units / nullif(units - 1, 0) * (n - 1) / nullif(n - 1 - units, 0))) / bread, 9) as se, n, units from s""")
def within_ols(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 8).alias("model"), F.col("l_suppkey").alias("unit"), (F.col("l_returnflag") == "R").cast("double").alias("x"), (F.col("l_discount") * 10 + F.col("l_tax")).alias("y"))
    return stats.within(rows, "unit", "x", "y", ["model"]).select("model", r9("beta"), r9("se"), "n", "units")


@query("""with u as (select x1 - avg(x1) over w as a, x2 - avg(x2) over w as b, y - avg(y) over w as y from (select l_suppkey as unit, (l_returnflag = 'R')::int::double as x1, l_quantity / 50 as x2, l_discount * 10 + l_tax as y from lineitem) window w as (partition by unit))
select round((sum(a * y) * sum(b * b) - sum(b * y) * sum(a * b)) / (sum(a * a) * sum(b * b) - sum(a * b) * sum(a * b)), 8) as beta_1, round((sum(b * y) * sum(a * a) - sum(a * y) * sum(a * b)) / (sum(a * a) * sum(b * b) - sum(a * b) * sum(a * b)), 8) as beta_2, count(*) as n from u""")
def within_ols_depth(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("unit"), (F.col("l_returnflag") == "R").cast("double").alias("x1"), (F.col("l_quantity") / 50).alias("x2"), (F.col("l_discount") * 10 + F.col("l_tax")).alias("y"))
    return stats.within_two(rows, "unit", "x1", "x2", "y").select(F.round("beta_1", 8).alias("beta_1"), F.round("beta_2", 8).alias("beta_2"), "n")


@query("""with g as (select c_mktsegment as k, count(*) as n, avg(c_acctbal) as m, var_samp(c_acctbal) as v from customer group by all)
select a.k as a, b.k as b, a.n as n_a, b.n as n_b, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 9) as t,
  round((a.v / a.n + b.v / b.n) * (a.v / a.n + b.v / b.n) / ((a.v / a.n) * (a.v / a.n) / (a.n - 1) + (b.v / b.n) * (b.v / b.n) / (b.n - 1)), 6) as df from g a join g b on a.k < b.k""")
def welch_stats(spark, d):
    return stats.welch(table(spark, d, "customer"), "c_mktsegment", "c_acctbal").select("a", "b", "n_a", "n_b", r9("t"), F.round("df", 6).alias("df"))


@query("""with v as (select o_orderpriority as k, (o_totalprice / 500)::int as x from orders), r as (select a.k as a, b.k as b, x, v.k as k from (select distinct k from v) a join (select distinct k from v) b on a.k < b.k join v on v.k in (a.k, b.k)),
q as (select *, rank() over (partition by a, b order by x) + (count(*) over (partition by a, b, x) - 1) / 2 as rk from r)
select a, b, count(case when k = a then 1 end) as n_a, count(case when k = b then 1 end) as n_b, round(sum(case when k = a then rk end) - count(case when k = a then 1 end) * (count(case when k = a then 1 end) + 1) / 2, 6) as u from q group by a, b""")
def mwu_u(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", F.floor(F.col("o_totalprice") / 500 + 0.5).cast("int").alias("x"))
    return stats.mann_whitney(rows, "o_orderpriority", "x").select("a", "b", "n_a", "n_b", F.round("u", 6).alias("u"))


@query("""with r as (select k, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2 as rk, count(*) over (partition by x) as ties, count(*) over () as n from (select o_orderpriority as k, (o_totalprice / 500)::int as x from orders)),
g as (select k, count(*) as c, sum(rk) as s, max(n) as n, sum((ties * ties - 1)::double) as t from r group by k)
select round((12.0::double / (max(n) * (max(n) + 1)) * sum(s * s / c) - 3 * (max(n) + 1)) / (1 - sum(t) / (max(n)::double * max(n) * max(n) - max(n))), 6) as h, count(*) - 1 as df from g""")
def kruskal_h(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", F.floor(F.col("o_totalprice") / 500 + 0.5).cast("int").alias("x"))
    return stats.kruskal(rows, "o_orderpriority", "x").select(F.round("h", 6).alias("h"), "df")


@query("""with r as (select k, rank() over (partition by k order by x) + (count(*) over (partition by k, x) - 1) / 2 as rx, rank() over (partition by k order by y) + (count(*) over (partition by k, y) - 1) / 2 as ry from (select p_brand as k, p_size as x, floor(p_retailprice) as y from part))
select k as p_brand, count(*) as n, round(corr(rx, ry), 9) as rho from r group by k""")
def spearman_rho(spark, d):
    rows = table(spark, d, "part").select("p_brand", "p_size", F.floor("p_retailprice").alias("y"))
    return stats.spearman(rows, "p_size", "y", ["p_brand"]).select("p_brand", "n", r9("rho"))


@query("""with r as (select *, rank() over (partition by l_returnflag order by abs(v)) + (count(*) over (partition by l_returnflag, abs(v)) - 1) / 2 as rk from (select l_returnflag, round(l_discount * 100)::int - round(l_tax * 100)::int as v from lineitem) where v <> 0)
select l_returnflag, count(*) as n, round(sum(case when v > 0 then rk else 0 end), 3) as w_plus, round(sum(case when v < 0 then rk else 0 end), 3) as w_minus from r group by all""")
def wilcoxon_w(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", (F.round(F.col("l_discount") * 100).cast("int") - F.round(F.col("l_tax") * 100).cast("int")).alias("v"))
    return stats.wilcoxon(rows, F.col("v"), ["l_returnflag"]).select("l_returnflag", "n", F.round("w_plus", 3).alias("w_plus"), F.round("w_minus", 3).alias("w_minus"))


@query("select l_returnflag, count(*) as n, round(avg(v), 9) as mean, round(avg(v) / (stddev_samp(v) / sqrt(count(*))), 6) as t from (select l_returnflag, l_discount - l_tax as v from lineitem) group by all")
def one_sample_t(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_discount", "l_tax")
    return stats.one_sample(rows, F.col("l_discount") - F.col("l_tax"), ["l_returnflag"]).select("l_returnflag", "n", r9("mean"), F.round("t", 6).alias("t"))


@query("select kind, count(*) as traces, round(avg(total), 6) as mean_total, round(avg(size), 6) as mean_mentions from (select l_suppkey as unit, l_returnflag as kind, sum(l_discount) as total, count(*) as size from lineitem group by all) group by kind")
def total_drop_by_kind(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("trace_id"), F.col("l_returnflag").alias("kind"), "l_discount")
    return summaries.total_by_kind(rows, "l_discount", "kind").select("kind", "traces", F.round("mean_total", 6).alias("mean_total"), F.round("mean_mentions", 6).alias("mean_mentions"))


@query(r"select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\s]', ' ', 'g'), '\b(the|a|an|likely|most|diagnosis|of|is|with|due|to)\b', ' ', 'g'), '\s+', ' ', 'g')) as answer from documents")
def normalise_answer(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalised_answer(F.coalesce("text", F.lit(""))).alias("answer"))


_RESPONSE = "case doc_id % 5 when 0 then '<think>' || coalesce(text, '') || '</think><answer>' || source || '</answer>' when 1 then coalesce(text, '') || '</think>' || substr(coalesce(text, ''), 1, 60) || '. Next' when 2 then '<think>a</think>**' || source || '** x' when 3 then 'x</answer> ' || source || ' </answer>' else '<answer>' || lang || '</answer> then <answer>...the name of the disease/entity...</answer>' end"


def _responses(spark, d) -> DataFrame:
    body, five = F.coalesce("text", F.lit("")), F.col("doc_id") % 5
    made = (
        F.when(five == 0, F.concat(F.lit("<think>"), body, F.lit("</think><answer>"), "source", F.lit("</answer>")))
        .when(five == 1, F.concat(body, F.lit("</think>"), F.substring(body, 1, 60), F.lit(". Next")))
        .when(five == 2, F.concat(F.lit("<think>a</think>**"), "source", F.lit("** x")))
        .when(five == 3, F.concat(F.lit("x</answer> "), "source", F.lit(" </answer>")))
        .otherwise(F.concat(F.lit("<answer>"), "lang", F.lit("</answer> then <answer>...the name of the disease/entity...</answer>")))
    )
    return table(spark, d, "documents").select("doc_id", made.alias("response"))


@query(f"with r as (select doc_id, {_RESPONSE} as response from documents), b as (select doc_id, list_filter(list_transform(regexp_extract_all(response, '(?s)<answer>\\s*(.*?)\\s*</answer>', 1), lambda x: trim(replace(x, '...the name of the disease/entity...', ''))), lambda x: x <> '') as bl from r) select doc_id, coalesce(bl[len(bl)], '') as answer from b")
def answers_tagged(spark, d):
    return _responses(spark, d).select("doc_id", text.tagged(F.col("response")).alias("answer"))


@query(f"with r as (select doc_id, {_RESPONSE} as response from documents), b as (select doc_id, regexp_extract_all(response, '(?s)</answer>\\s*(.*?)\\s*</answer>', 1) as bl from r) select doc_id, coalesce(trim(bl[len(bl)]), '') as answer from b")
def sandwiched(spark, d):
    return _responses(spark, d).select("doc_id", text.sandwiched(F.col("response")).alias("answer"))


_AFTER = "case when contains(response, '</think>') then regexp_replace(regexp_replace(string_split(response, '</think>')[len(string_split(response, '</think>'))], '^\\s+', ''), '\\s+$', '') else '' end"


@query(f"with r as (select doc_id, {_RESPONSE} as response from documents), a as (select doc_id, {_AFTER} as after from r), f as (select doc_id, after, regexp_extract(after, '(?s)^(.+?[.!?])(?:\\s|$)', 1) as s from a) select doc_id, case when s <> '' then trim(s) else after end as answer from f")
def prose_after_think(spark, d):
    return _responses(spark, d).select("doc_id", text.prose_after_think(F.col("response")).alias("answer"))


@query(f"with r as (select doc_id, {_RESPONSE} as response from documents), a as (select doc_id, regexp_extract_all({_AFTER}, '(?s)\\*\\*(.+?)\\*\\*', 1) as b from r) select doc_id, coalesce(case when len(b) <= 3 and length(trim(b[1])) <= 160 then trim(b[1]) end, '') as answer from a")
def bold_after_think(spark, d):
    return _responses(spark, d).select("doc_id", F.coalesce(text.bold_after_think(F.col("response")), F.lit("")).alias("answer"))


@query("with b as (select page_id, list_transform(regexp_extract_all(replace(replace(coalesce(html, ''), '<p>', '<think>'), '</p>', '</think>'), '(?si)<think>(.*?)</think>', 1), lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')) as bl from pages) select page_id, len(bl)::int as n_blocks, list_max(list_transform(bl, lambda x: length(x)))::int as longest from b")
def think_blocks(spark, d):
    html = F.replace(F.replace(F.coalesce("html", F.lit("")), F.lit("<p>"), F.lit("<think>")), F.lit("</p>"), F.lit("</think>"))
    rows = table(spark, d, "pages").select("page_id", text.think_blocks(html).alias("b"))
    return rows.select("page_id", F.size("b").alias("n_blocks"), F.length(text.longest(F.col("b"))).alias("longest"))


_RULE = "-" * 40


@query(f"select doc_id, md5(trim(regexp_extract(q, '(?s)-{{40}}\\nCASE PRESENTATION\\n-{{40}}\\n(.*?)\\n-{{40}}\\nOUTPUT TEMPLATE\\n-{{40}}', 1))) as digest from (select doc_id, 'x' || chr(10) || '{_RULE}' || chr(10) || 'CASE PRESENTATION' || chr(10) || '{_RULE}' || chr(10) || source || ' ' || lang || chr(10) || doc_id || chr(10) || '{_RULE}' || chr(10) || 'OUTPUT TEMPLATE' || chr(10) || '{_RULE}' as q from documents)")
def prompt_case_text(spark, d):
    body = F.concat(F.lit(f"x\n{_RULE}\nCASE PRESENTATION\n{_RULE}\n"), "source", F.lit(" "), "lang", F.lit("\n"), F.col("doc_id").cast("string"), F.lit(f"\n{_RULE}\nOUTPUT TEMPLATE\n{_RULE}"))
    return table(spark, d, "documents").select("doc_id", F.md5(text.prompt_case(body).cast("binary")).alias("digest"))


@query("select o_custkey, sha256(array_to_string(list(o_orderkey order by o_orderkey), ',')) as prefix_sha256 from orders group by o_custkey")
def prefix_hash(spark, d):
    ids = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    return ids.select("o_custkey", text.prefix_digest(F.col("ids")).alias("prefix_sha256"))


@query("select p_partkey, (2026 + ('0x' || substr(sha256(p_name), 1, 8))::bigint + 1000003 * (p_size % 12) + p_partkey % 5) % 2147483647 as seed from part")
def rollout_seed(spark, d):
    return table(spark, d, "part").select("p_partkey", text.sample_seed(2026, F.sha2("p_name", 256), F.col("p_size") % 12, F.col("p_partkey") % 5).alias("seed"))


def _kl(p: str, q: str, n: str, m: str, k: str) -> str:
    mp, mq = f"(max({n}) + 0.5::double * {k})", f"(max({m}) + 0.5::double * {k})"
    return f"round(sum(({p} + 0.5::double) * log2(({p} + 0.5::double) / ({q} + 0.5::double))) / {mp} + log2({mq} / {mp}), 9)"


_ARMS = F1 + """,
pl as (select trace_id, boundary_index as sentence_index, 'remove' as arm, entity, valid, similarity from f1 where boundary_index <= 10
  union all select trace_id, boundary_index - 1, 'keep', entity, valid, similarity from f1 where boundary_index >= 1
  union all select trace_id, boundary_index, case when similarity::double < 0.5::double then 'counterfactual' else 'similar' end, entity, valid, similarity from f1 where boundary_index <= 10),
vo as (select trace_id, count(distinct entity) as k from f1 where valid group by trace_id)"""


def _two(first: str, second: str) -> str:
    return f""", cn as (select trace_id, sentence_index, entity, sum((arm = '{first}')::int)::bigint as p, sum((arm = '{second}')::int)::bigint as q from pl where valid and arm in ('{first}', '{second}') group by all),
ar as (select cn.*, sum(p) over w as n, sum(q) over w as m from cn window w as (partition by trace_id, sentence_index))
"""


def _placed(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = samples(spark, d).select("trace_id", "boundary_index", "entity", "valid", "similarity", F.substring("entity", 1, 1).alias("flag"))
    last = rows.groupBy("trace_id").agg(F.max("boundary_index").alias("last_boundary"))
    return rows, importance.sentence_samples(rows, last, F.lit(0.5))


@query(with_(_ARMS).rstrip() + _two("similar", "counterfactual") + "select trace_id, sentence_index, round(1 - sum(least(p * m, q * n)) / (max(n) * max(m)), 9) as tvd from ar group by all")
def importance_tvd(spark, d):
    return importance.divergences(_placed(spark, d)[1], "similar", "counterfactual").select("trace_id", "sentence_index", r9("tvd"))


@query(with_(_ARMS).rstrip() + _two("keep", "remove") + f"select trace_id, sentence_index, {_kl('p', 'q', 'n', 'm', 'count(*)')} as kl, {_kl('q', 'p', 'm', 'n', 'count(*)')} as kl_back from ar group by all")
def importance_kl(spark, d):
    return importance.divergences(_placed(spark, d)[1], "keep", "remove").select("trace_id", "sentence_index", r9("kl"), r9("kl_back"))


@query(with_(_ARMS).rstrip() + _two("keep", "counterfactual") + f"select trace_id, sentence_index, {_kl('p', 'q', 'n', 'm', 'max(k)')} as kl_fixed, {_kl('q', 'p', 'm', 'n', 'max(k)')} as kl_back_fixed from ar join vo using (trace_id) group by all")
def importance_kl_fixed(spark, d):
    rows, placed = _placed(spark, d)
    return importance.divergences(placed, "keep", "counterfactual", importance.vocabulary(rows)).select("trace_id", "sentence_index", r9("kl_fixed"), r9("kl_back_fixed"))


@query(with_(_ARMS).rstrip() + _two("keep", "remove") + "select trace_id, sentence_index, round((sum(case when p > 0 then p / n * log2(2 * (p / n) / (p / n + q / m)) else 0 end) + sum(case when q > 0 then q / m * log2(2 * (q / m) / (p / n + q / m)) else 0 end)) / 2, 9) as jsd from ar group by all")
def importance_jsd(spark, d):
    return importance.divergences(_placed(spark, d)[1], "keep", "remove").select("trace_id", "sentence_index", r9("jsd"))


@query(with_(_ARMS) + """select trace_id, sentence_index, count(case when arm = 'remove' then 1 end) as remove_n, count(case when arm = 'keep' then 1 end) as keep_n, count(case when arm = 'counterfactual' then 1 end) as counterfactual_n, count(case when arm = 'similar' then 1 end) as similar_n,
  count(case when arm = 'remove' and not valid then 1 end) as remove_invalid, count(case when arm = 'keep' and not valid then 1 end) as keep_invalid from pl group by all""")
def arm_counts(spark, d):
    return importance.arm_counts(_placed(spark, d)[1]).drop("alternative_trajectory_fraction", "mean_replacement_similarity")


@query(with_(_ARMS) + """select trace_id, sentence_index, round(count(case when arm = 'counterfactual' then 1 end) / count(case when arm in ('counterfactual', 'similar') then 1 end), 9) as alternative_trajectory_fraction,
  round(avg(case when arm in ('counterfactual', 'similar') then similarity::double end), 6) as mean_replacement_similarity from pl group by all""")
def replacement_stats(spark, d):
    rows = importance.arm_counts(_placed(spark, d)[1])
    return rows.select("trace_id", "sentence_index", r9("alternative_trajectory_fraction"), F.round("mean_replacement_similarity", 6).alias("mean_replacement_similarity"))


@query(with_(_ARMS) + """, ac as (select trace_id, sentence_index, avg(case when arm = 'remove' and valid then (entity[1] = 'R')::int end) as r, avg(case when arm = 'keep' and valid then (entity[1] = 'R')::int end) as k, avg(case when arm = 'counterfactual' and valid then (entity[1] = 'R')::int end) as c from pl group by all)
select trace_id, sentence_index, round(k - r, 9) as resampling_accuracy_delta, round(k - c, 9) as counterfactual_accuracy_delta from ac""".replace("\n, ac", ", ac"))
def accuracy_delta(spark, d):
    placed = _placed(spark, d)[1].withColumn("is_correct", F.col("flag") == "R")
    return importance.accuracies(placed).select("trace_id", "sentence_index", r9("resampling_accuracy_delta"), r9("counterfactual_accuracy_delta"))


_PLACED = F1.replace("as rollout_index", "as rollout_index, l_partkey") + """,
pl as (select trace_id, boundary_index as sentence_index, 'remove' as arm, rollout_index, l_partkey, entity, valid, similarity from f1 where boundary_index <= 10
  union all select trace_id, boundary_index - 1, 'keep', rollout_index, l_partkey, entity, valid, similarity from f1 where boundary_index >= 1
  union all select trace_id, boundary_index, case when similarity::double < 0.5::double then 'counterfactual' else 'similar' end, rollout_index, l_partkey, entity, valid, similarity from f1 where boundary_index <= 10),
vo as (select trace_id, count(distinct entity) as k from f1 where valid group by trace_id)"""


def _both(tag: str, first: str, second: str, cells: str) -> str:
    return f"""c{tag} as (select trace_id, sentence_index, entity, sum((arm = '{first}')::int)::bigint as p, sum((arm = '{second}')::int)::bigint as q from pl where valid and arm in ('{first}', '{second}') group by all),
a{tag} as (select c{tag}.*, sum(p) over w as n, sum(q) over w as m from c{tag} window w as (partition by trace_id, sentence_index)),
d{tag} as (select trace_id, sentence_index, {cells} from a{tag} join vo using (trace_id) group by all having max(n) > 0 and max(m) > 0)"""


_JSD = "round((sum(case when p > 0 then p / n * log2(2 * (p / n) / (p / n + q / m)) else 0 end) + sum(case when q > 0 then q / m * log2(2 * (q / m) / (p / n + q / m)) else 0 end)) / 2, 9)"


def _drawn(n: int, suffix: str = "") -> str:
    of = "round(pow(2, -sum(case when {0} > 0 then {0} / %d * log2({0} / %d) else 0 end)), 9)" % (n, n)
    return f"""t{n} as (select *, row_number() over (partition by trace_id, sentence_index, arm order by sha256(key), key) as t, count(*) over (partition by trace_id, sentence_index, arm) as own
    from (select *, concat_ws(':', trace_id, sentence_index, arm, rollout_index) as key from pl where valid and entity <> '' and arm in ('keep', 'counterfactual'))),
u{n} as (select *, min(own) over w as least, min(arm) over w <> max(arm) over w as two from t{n} window w as (partition by trace_id, sentence_index)),
v{n} as (select trace_id, sentence_index, entity, sum((arm = 'counterfactual')::int)::bigint as p, sum((arm = 'keep')::int)::bigint as q, {n} as n, {n} as m from u{n} where two and least >= {n} and t <= {n} group by all),
x{n} as (select trace_id, sentence_index, {of.format('q')} as ek, {of.format('p')} as ec, {_kl('p', 'q', 'n', 'm', 'count(*)')} as kl, {_kl('p', 'q', 'n', 'm', 'max(k)')} as klf from v{n} join vo using (trace_id) group by all),
m{n} as (select trace_id, sentence_index, {n}::int as matched_n{suffix}, ek as matched_effective_keep{suffix}, ec as matched_effective_counterfactual{suffix}, kl as matched_kl_cf_keep{suffix}, klf as matched_kl_cf_keep_fixed{suffix},
  round(ec / ek, 6) as matched_collapse_ratio{suffix}, ek <= 3 and round(ec / ek, 6) >= 2 as matched_is_anchor{suffix} from x{n})"""


_COUNTS = ", ".join(f"coalesce(max(case when arm = '{a}' then js end), '{{}}') as {a}_counts" for a in ("keep", "remove", "counterfactual", "similar"))
_TABLE = with_(
    _PLACED,
    "se as (select trace_id, max(boundary_index) as n_sentences, unnest(range(0, max(boundary_index)))::int as sentence_index from f1 group by trace_id)",
    """co as (select trace_id, sentence_index, count(case when arm = 'remove' then 1 end) as remove_n, count(case when arm = 'keep' then 1 end) as keep_n, count(case when arm = 'counterfactual' then 1 end) as counterfactual_n, count(case when arm = 'similar' then 1 end) as similar_n,
  count(case when arm = 'remove' and not valid then 1 end) as remove_invalid, count(case when arm = 'keep' and not valid then 1 end) as keep_invalid, round(count(case when arm = 'counterfactual' then 1 end) / count(case when arm in ('counterfactual', 'similar') then 1 end), 9) as alternative_trajectory_fraction,
  round(avg(case when arm in ('counterfactual', 'similar') then similarity::double end), 6) as mean_replacement_similarity, round(count(distinct case when arm in ('counterfactual', 'similar') then l_partkey end) / count(case when arm in ('counterfactual', 'similar') then 1 end), 9) as unique_replacement_fraction,
  avg(case when arm = 'remove' and valid then (entity[1] = 'R')::int end) as ra, avg(case when arm = 'keep' and valid then (entity[1] = 'R')::int end) as ka, avg(case when arm = 'counterfactual' and valid then (entity[1] = 'R')::int end) as ca from pl group by all)""",
    f"jc as (select trace_id, sentence_index, {_COUNTS} from (select trace_id, sentence_index, arm, to_json(map_from_entries(list((entity, c) order by entity)))::varchar as js from (select trace_id, sentence_index, arm, entity, count(*) as c from pl where valid group by all) group by all) group by all)",
    _both("_r", "keep", "remove", f"{_kl('p', 'q', 'n', 'm', 'count(*)')} as resampling_kl_keep_remove, {_kl('q', 'p', 'm', 'n', 'count(*)')} as resampling_kl_remove_keep, {_kl('q', 'p', 'm', 'n', 'max(k)')} as resampling_kl_remove_keep_fixed, {_JSD} as resampling_jsd"),
    _both("_k", "keep", "counterfactual", f"{_kl('p', 'q', 'n', 'm', 'count(*)')} as counterfactual_kl_keep_cf, {_kl('q', 'p', 'm', 'n', 'count(*)')} as counterfactual_kl_cf_keep, {_kl('p', 'q', 'n', 'm', 'max(k)')} as counterfactual_kl_keep_cf_fixed, {_kl('q', 'p', 'm', 'n', 'max(k)')} as counterfactual_kl_cf_keep_fixed, {_JSD} as counterfactual_jsd"),
    _both("_s", "similar", "counterfactual", "round(1 - sum(least(p * m, q * n)) / (max(n) * max(m)), 9) as counterfactual_tvd"),
    _drawn(16),
    _drawn(10, "10"),
) + """select se.*, round(se.sentence_index / se.n_sentences, 9) as position, k as case_vocab_size, co.* exclude (trace_id, sentence_index, ra, ka, ca), round(ra, 9) as remove_accuracy, round(ka, 9) as keep_accuracy, round(ca, 9) as counterfactual_accuracy,
  round(ka - ra, 9) as resampling_accuracy_delta, round(ka - ca, 9) as counterfactual_accuracy_delta, jc.* exclude (trace_id, sentence_index), d_r.* exclude (trace_id, sentence_index), d_k.* exclude (trace_id, sentence_index), d_s.* exclude (trace_id, sentence_index),
  m16.* exclude (trace_id, sentence_index), m10.* exclude (trace_id, sentence_index), 0.5::double as threshold
from se left join vo using (trace_id) left join co using (trace_id, sentence_index) left join jc using (trace_id, sentence_index) left join d_r using (trace_id, sentence_index) left join d_k using (trace_id, sentence_index)
  left join d_s using (trace_id, sentence_index) left join m16 using (trace_id, sentence_index) left join m10 using (trace_id, sentence_index)"""


def _rounded(df: DataFrame) -> DataFrame:
    """Floating figures at 9 digits, means of single-precision ones and ratios of rounded ones at 6; maps as JSON."""
    coarse = ("mean_replacement_similarity", "matched_collapse_ratio", "matched_collapse_ratio10")
    cells = {n: F.round(n, 6 if n in coarse else 9) for n, t in df.dtypes if t == "double" and n != "threshold"}
    return df.withColumns(cells | {n: F.to_json(n) for n, t in df.dtypes if t.startswith("map")})


@query(_TABLE)
def importance_table(spark, d):
    rows = numbered_samples(spark, d).select("trace_id", "boundary_index", "rollout_index", "entity", "valid", "similarity", F.substring("entity", 1, 1).alias("flag"), F.concat_ws(" ", F.lit("part"), "l_partkey").alias("first_sentence"))
    last = rows.groupBy("trace_id").agg(F.max("boundary_index").alias("last_boundary"))
    return _rounded(importance.importance_table(rows.withColumn("is_correct", F.col("flag") == "R"), last, 0.5))


@query(with_(_PLACED, _drawn(16)) + "select * from m16")
def matched_arms(spark, d):
    rows = numbered_samples(spark, d)
    last = rows.groupBy("trace_id").agg(F.max("boundary_index").alias("last_boundary"))
    placed = importance.sentence_samples(rows.select("trace_id", "boundary_index", "rollout_index", "entity", "valid", "similarity"), last, F.lit(0.5))
    key = F.concat_ws(":", F.col("trace_id").cast("string"), F.col("sentence_index").cast("string"), "arm", F.col("rollout_index").cast("string"))
    return _rounded(importance.matched(placed, 16, key, vocabulary=importance.vocabulary(rows)))


@query("select c_mktsegment, " + ", ".join(f"max(case when n_regionkey = {i} then m end) as r{i}" for i in range(5)) + " from (select c_mktsegment, n_regionkey, round(median(c_acctbal), 6) as m from customer join nation on c_nationkey = n_nationkey group by all) group by all")
def pivot_median(spark, d):
    rows = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return summaries.cross_table(rows, ["c_mktsegment"], "n_regionkey", range(5), F.round(F.percentile("c_acctbal", F.lit(0.5)), 6), "r")


@query("select r_name, count(*) as n, round(avg(m), 6) as mean_of_means, round(stddev_samp(m) / sqrt(count(*)), 6) as se from (select r_name, n_name, avg(c_acctbal) as m from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all) group by r_name")
def mean_of_means(spark, d):
    nations = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    return summaries.mean_of_means(rows, "c_acctbal", ["n_name"], ["r_name"]).select("r_name", "n", F.round("mean", 6).alias("mean_of_means"), F.round("se", 6).alias("se"))


@query(with_(F1) + "select trace_id, boundary_index, to_json(map_from_entries(list((entity, c) order by entity)))::varchar as counts from (select trace_id, boundary_index, entity, count(*) as c from f1 group by all) group by all")
def histogram_json(spark, d):
    hist = distributions.histogram(samples(spark, d))
    return distributions.histogram_map(hist).select("trace_id", "boundary_index", F.to_json("counts").alias("counts"))


@query("select source, count(*) as n_cases, count(case when quality = 1 then 1 end) as n_good, count(case when doc_id is not null and quality is null then 1 end) as unjudged from (select d.doc_id, source, quality from documents d left join labels l using (doc_id)) group by source")
def judged_by_source(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_cases"), F.count_if(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("n_good"), F.count_if(F.col("quality").isNull()).alias("unjudged"))
