"""Queries over readers, envelopes, sentences, scores and judges: texts are made so that what is in them is known."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import answers, reasoning, sentences, text
from ..operators import gates, grouping, preparing, scoring, stats
from ..sources import readers
from .fixtures import registry, table

QUERIES, SQL, query = registry()

_SLOT = "<answer>...the name of the disease/entity...</answer>"


def _items(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("body"))


def _one_of(choices: list[Column], of: Column) -> Column:
    out = choices[-1]
    for i, c in reversed(list(enumerate(choices[:-1]))):
        out = F.when(of % len(choices) == i, c).otherwise(out)
    return out


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _read(reader) -> Column:
    """A Python function of one text as a column."""

    @F.pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: reader(v or ""))

    return run("response")


def _id() -> Column:
    return F.col("item_id")


def _body() -> Column:
    return F.col("body")


@query("select item_id, case item_id % 4 when 0 then item_id || ' tail' when 1 then 'x' || item_id when 2 then 'y' || item_id else '' end as answer from benchmark")
def reader_last_opener(spark, d):
    made = [_text("a <answer>", _body(), "</answer> b <answer> ", _id(), " tail "), _text("<answer>x", _id(), "</answer> then ", _body(), _SLOT), _text("<answer>z</answer><answer>y", _id(), "</answer> more"), _text(_body())]
    return _items(spark, d).select("item_id", _one_of(made, _id()).alias("response")).select("item_id", _read(answers.last_opener).alias("answer"))


@query("select item_id, case item_id % 4 when 0 then 'gout ' || item_id when 1 then 'b' || item_id when 2 then 'open ' || item_id else '' end as answer from benchmark")
def reader_tool_call(spark, d):
    made = [_text("x<tool_call>answer>gout ", _id(), "</answer> y"), _text("<tool_call>a</answer> <TOOL_CALL>\ndiagnosis>b", _id(), "</Diagnosis>"), _text("<tool_call> open ", _id(), " "), _text(_body())]
    return _items(spark, d).select("item_id", _one_of(made, _id()).alias("response")).select("item_id", _read(answers.tool_call_answer).alias("answer"))


@query("select item_id, case item_id % 5 when 0 then 'gout no ' || item_id when 1 then 'sepsis ' || item_id when 2 then 'lupus ' || item_id else '' end as answer from benchmark")
def reader_stated(spark, d):
    made = [
        _text("Thus the most likely diagnosis is gout no ", _id(), " given the knee. End"), _text("x\nDiagnosis: sepsis ", _id(), ", which is rare.\n"), _text("lupus ", _id(), " remains the best diagnosis"),
        _text("Final diagnosis: often unclear ", _id()), _text("nothing of the kind ", _id()),
    ]
    return _items(spark, d).select("item_id", _one_of(made, _id()).alias("response")).select("item_id", _read(answers.stated_diagnosis).alias("answer"))


@query("select item_id, case item_id % 4 when 0 then 'b' || item_id when 1 then 'first ' || item_id when 2 then 'gout ' || item_id else 's' || item_id || '.' end as answer from benchmark")
def readers_in_order(spark, d):
    """An overriding reader wins over the tagged answer; the others are asked in order where none was found."""
    made = [_text("<answer>a</answer><answer>b", _id(), " "), _text("<answer>first ", _id(), "</answer>"), _text("Final diagnosis: gout ", _id(), ". "), _text("<think>t</think> s", _id(), ". More")]
    rows = _items(spark, d).select("item_id", _one_of(made, _id()).alias("response"))
    return rows.select("item_id", answers.read_answers(F.col("response"), ["last_opener", "stated_diagnosis", "prose_after_think"]).alias("answer"))


@query(r"select item_id, regexp_replace(coalesce(text, ''), '\s+\z', '') as answer from benchmark")
def special_tokens_stripped(spark, d):
    rows = _items(spark, d).select("item_id", _text(_body(), " <|im_end|>\n<|eot_id|> ").alias("response"))
    return rows.select("item_id", _read(lambda r: reasoning.TRAILING_SPECIAL.sub("", r)).alias("answer"))


@query(r"select item_id, case item_id % 3 when 2 then coalesce(text, '') else regexp_replace(coalesce(text, ''), '\s+\z', '') end as answer from benchmark")
def answers_peeled(spark, d):
    """Blocks at the end go whole; a closer without its own opener goes with the bare answer before it."""
    made = [_text(_body(), " <answer>a</answer>\n<answer>b</answer> "), _text(_body(), " <answer>a</answer>bare</answer>"), _text(_body())]
    rows = _items(spark, d).select("item_id", _one_of(made, _id()).alias("response"))
    return rows.select("item_id", _read(reasoning.peeled).alias("answer"))


@query(r"select item_id, 'Because ' || item_id || ' of it' as answer from benchmark")
def scaffolding_cleaned(spark, d):
    made = [_text("assistant <think>Because ", _id(), " of it</think><|im_end|>"), _text("<|start_header_id|>assistant<|end_header_id|>\n\nBecause ", _id(), " of it\n## Final Response\n"), _text("## Thinking\n\nBecause ", _id(), " of it")]
    rows = _items(spark, d).select("item_id", _one_of(made, _id()).alias("response"))
    return rows.select("item_id", _read(reasoning.cleaned).alias("answer"))


_WHY = "'why ' || item_id || repeat(' and so on', 12)"
_LABELS = ["harmony", "harmony", "answer_anchored", "think_block", "outside_tags", "thinking_section", "fallback", "empty", "harmony"]


@query(f"select item_id, case item_id % 9 when 7 then '' else {_WHY} end as found, [{', '.join(map(repr, _LABELS))}][1 + item_id % 9] as label from benchmark")
def reasoning_envelopes(spark, d):
    why = _text("why ", _id(), " and so on" * 12)
    made = [
        _text("<|channel|>analysis<|message|>", why, "<|end|>final"), _text("assistantanalysis", why, "assistantfinalX"), _text(_SLOT, "\n\n<think>\n", why, "\n<answer>Gout</answer>"), _text("x<think>short</think><think>", why, "</think><answer>g</answer>"),
        _text("OUTPUT TEMPLATE <answer></answer>\n", why, "\n<think>"), _text("## Thinking\n", why, "\n## Next"), _text(why, " <answer>G</answer><|im_end|>"), F.lit(""), _text("assistantanalysis", why),
    ]
    rows = _items(spark, d).select("item_id", _one_of(made, _id()).alias("response"))
    return rows.select("item_id", reasoning.extract_column(F.col("response")).alias("x")).select("item_id", F.col("x.text").alias("found"), F.col("x.label").alias("label"))


@query(f"select item_id, {_WHY} as found, ['bracket_think', 'gemma_thought', 'think_longest', 'think_block'][1 + item_id % 4] as label from benchmark")
def reasoning_formats(spark, d):
    why = _text("why ", _id(), " and so on" * 12)
    formats = {
        "bracket_think": _text("[INST]<think>p[/INST][THINK]", why, "[/THINK]rest"), "gemma_thought": _text("<|channel>thought\n", why, " <channel|>x"),
        "think_longest": _text("<think>a</think>t</answer> <x assistant><think>\n", why, "</think>"), "think_block": _text("<think>...</think><think>", why, "</think> end"),
    }
    rows, parts = _items(spark, d), []
    for i, (name, response) in enumerate(formats.items()):
        some = rows.where(_id() % 4 == i).select("item_id", response.alias("response"))
        parts.append(some.select("item_id", reasoning.extract_column(F.col("response"), named=name).alias("x")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("item_id", F.col("x.text").alias("found"), F.col("x.label").alias("label"))


@query("select item_id, 'a' || item_id || ' ' || case item_id % 2 when 0 then '' else '<answer>' || repeat('x', 600) || '</answer>' end || 'b' as kept from benchmark")
def short_answers_removed(spark, d):
    block = F.when(_id() % 2 == 0, F.lit("<answer>short</answer>")).otherwise(F.lit("<answer>" + "x" * 600 + "</answer>"))
    rows = _items(spark, d).select("item_id", _text("a", _id(), " ", block, "b").alias("response"))
    return rows.select("item_id", _read(reasoning.without_short_answers).alias("kept"))


#: Marks before white space and a capital or digit, in texts whose characters outside printable ASCII are an x: white space means the same to both engines there.
_MARKED = r"regexp_replace(regexp_replace(coalesce(text, ''), '[^\x09\x0a\x0d\x20-\x7e]', 'x', 'g'), '([.?])(\s+[\"(]?[A-Z0-9])', '\1' || chr(30) || '\2', 'g')"
_PIECES = rf"list_filter(string_split({_MARKED}, chr(30)), lambda s: not regexp_full_match(s, '\s*'))"


@query(rf"select doc_id, len({_PIECES})::int as n, md5(coalesce(regexp_replace(regexp_replace({_PIECES}[1], '^\s+', ''), '\s+\z', ''), '')) as first from documents")
def clinical_sentences(spark, d):
    tidy = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x09\x0a\x0d\x20-\x7e]", "x")
    parts = table(spark, d, "documents").select("doc_id", sentences.split_column(tidy).alias("p"))
    return parts.select("doc_id", F.size("p").alias("n"), F.md5(F.coalesce(F.get("p", F.lit(0)), F.lit("")).cast("binary")).alias("first"))


@query("select item_id, 'One ' || item_id || ' two.' as first from benchmark")
def first_sentences(spark, d):
    made = [_text("One ", _id(), " two. Three", F.repeat(F.lit(" x"), 2000)), _text("One ", _id(), " two."), _text("  One ", _id(), " two. 3 more. And")]
    return _items(spark, d).select("item_id", sentences.first_sentence_column(_one_of(made, _id())).alias("first"))


@query("select item_id, ['One ' || item_id, '1.' || chr(10) || 'Two (it)', 'said so.\"', 'Then more... and on', 'End'] as parts from benchmark")
def outline_sentences(spark, d):
    made = _text("One ", _id(), '\n1.\nTwo (it)\nsaid so."\nThen more... and on\nEnd')
    return _items(spark, d).select("item_id", sentences.split_column(made, "outline").alias("parts"))


def _ids(full: str) -> tuple[list[int], list[tuple[int, int]]]:
    spans = sentences.whitespace_tokens(full)
    return list(range(len(spans))), spans


@query("""select case_id, 2::int as prompt_token_count, s.i as sentence_index, 3 + s.i * (k + 1) as token_start, 3 + (s.i + 1) * (k + 1) as token_end, 'S' || s.i || repeat(' w', k) || '.' as text, 'gout' as raw_answer
  from (select item_id::varchar as case_id, (1 + item_id % 5)::int as k, unnest(range(0, 1 + (item_id % 3)::int))::int as i from benchmark) s""".replace("s.i", "i"))
def trace_cuts(spark, d):
    """Sentences of a made response, cut between white-space tokens."""
    k = (1 + _id() % 5).cast("int")
    each = F.transform(F.sequence(F.lit(0), (_id() % 3).cast("int")), lambda i: F.concat(F.lit("S"), i.cast("string"), F.repeat(F.lit(" w"), k), F.lit(".")))
    full = _text("Q: ", _id(), "\n<think>\n", F.array_join(each, " "), "\n</think>\n<answer>gout</answer>")
    rows = _items(spark, d).select(_id().cast("string").alias("case_id"), _text("Q: ", _id()).alias("prompt"), full.alias("full_response"))
    made, _ = preparing.prepare_traces(rows, _ids)
    return made.select("case_id", "prompt_token_count", "raw_answer", F.explode("sentences").alias("s")).select("case_id", "prompt_token_count", "s.sentence_index", "s.token_start", "s.token_end", "s.text", "raw_answer")


@query("select item_id::varchar as case_id, case item_id % 2 when 0 then 'the reasoning is no verbatim part of the response' else 'the prompt does not begin the response' end as reason from benchmark")
def trace_skips(spark, d):
    full = _one_of([_text("Q: ", _id(), " <think>a <|x|> b</think>"), _text("other <think>a</think>")], _id())
    rows = _items(spark, d).select(_id().cast("string").alias("case_id"), _text("Q: ", _id()).alias("prompt"), full.alias("full_response"))
    return preparing.prepare_traces(rows, _ids)[1]


@query("select item_id::varchar as case_id, (1 + item_id % 3)::int as n_sentences from benchmark")
def eligible_cases(spark, d):
    each = F.transform(F.sequence(F.lit(0), (_id() % 3).cast("int")), lambda i: F.concat(F.lit("S"), i.cast("string"), F.lit(" w.")))
    rows = _items(spark, d).select(_id().cast("string").alias("case_id"), F.lit("").alias("prompt"), _text("<think>", F.array_join(each, " "), "</think>").alias("full_response"))
    return preparing.eligible(rows)


@query("select item_id, md5('Case: ' || coalesce(text, '') || ' End') as digest from benchmark")
def rendered_prompts(spark, d):
    return _items(spark, d).select("item_id", F.md5(text.rendered("Case: {case_prompt} End", _body()).cast("binary")).alias("digest"))


_JUDGED = "(select distinct source as case_id, lang as raw_answer, case when lang = 'de' then '' when lang = 'fr' then null else 'E ' || lang end as canonical from documents where lang is not null)"


def _scored(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    scores = docs.select(F.col("source").alias("case_id"), F.col("doc_id").alias("trace_id"), F.concat(F.lit(" "), "lang", F.lit(" ")).alias("raw_answer"), (F.col("n_chars") > 500).alias("valid"))
    canonical = F.when(F.col("lang") == "de", "").when(F.col("lang") != "fr", F.concat(F.lit("E "), "lang"))
    return scores, docs.where("lang is not null").select(F.col("source").alias("case_id"), F.col("lang").alias("raw_answer"), canonical.alias("canonical")).distinct()


@query(f"select doc_id as trace_id, canonical as entity from documents d join {_JUDGED} g on g.case_id = d.source and g.raw_answer = trim(d.lang) where n_chars > 500 and coalesce(canonical, '') <> '' and doc_id in (select doc_id from labels)")
def graded_scores(spark, d):
    """Valid scores with the entity of their stripped answer, of traces that are there."""
    scores, grades = _scored(spark, d)
    return readers.graded(scores, grades, table(spark, d, "labels").select(F.col("doc_id").alias("trace_id"))).select("trace_id", "entity")


@query(f"select doc_id as trace_id, canonical as base_entity from documents d join {_JUDGED} g on g.case_id = d.source and g.raw_answer = d.lang where coalesce(canonical, '') <> ''")
def base_entities(spark, d):
    traces = table(spark, d, "documents").select(F.col("source").alias("case_id"), F.col("doc_id").alias("trace_id"), F.col("lang").alias("raw_answer"))
    return gates.base_entity(traces, _scored(spark, d)[1]).select("trace_id", "base_entity")


@query("select o_custkey, (t - 1)::int as boundary, round((l[t] - l[1] + 5) / (l[len(l)] - l[1] + 5), 9) as depth from (select o_custkey, l, unnest(range(1, len(l) + 1)) as t from (select o_custkey, list(distinct o_orderkey order by o_orderkey) as l from orders group by o_custkey))")
def token_depth(spark, d):
    """Share of tokens after the prompt, which ends 5 before the first boundary."""
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderkey")).alias("l"))
    each = rows.select("o_custkey", "l", F.explode(F.sequence(F.lit(0), F.size("l") - 1)).alias("boundary"))
    return each.select("o_custkey", "boundary", F.round(readers.depth(F.col("l"), F.get("l", F.lit(0)) - 5, F.col("boundary")), 9).alias("depth"))


def _overlap(removed: pd.Series, first: pd.Series) -> pd.Series:
    """As a stand-in of an encoder: 1 for equal texts, 0.25 otherwise, none for one without words."""
    return pd.Series([float("nan") if f == "?" else 1.0 if r == f else 0.25 for r, f in zip(removed, first, strict=True)], dtype=float)


@query("""with r as (select item_id, item_id::varchar as trace_id, i as boundary_index, (item_id + i) % 5 as kind, case when i < 2 then 'Sentence ' || i || '.' else '' end as removed from (select item_id, unnest(range(0, 3))::int as i from benchmark)),
c as (select *, case kind when 0 then case when removed = '' then '9 <answer>The Gout!</answer>' else removed end when 1 then 'Another one.' when 2 then repeat('loop ', 1700) || 'x' when 3 then '' else '?' end as opening, case kind when 2 then 'length' else 'stop' end as finish_reason, kind in (0, 1) as tagged from r)
select 'c' as case_id, trace_id, boundary_index, 7::int as rollout_index, case when tagged then 'The Gout!' end as raw_answer, case when tagged then 'gout' end as bucket, case when tagged then boundary_index = 0 end as is_correct, md5(opening) as first_digest,
  case when removed = '' or opening = '' or kind in (2, 4) then null when opening = removed then 1.0 else 0.25 end::float as similarity, finish_reason, tagged as valid from c""")
def scored_rollouts(spark, d):
    """All columns of scores, the first sentence as its digest."""
    rows = _items(spark, d).select("item_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("boundary_index"))
    kind, removed = (_id() + F.col("boundary_index")) % 5, F.when(F.col("boundary_index") < 2, _text("Sentence ", F.col("boundary_index"), ".")).otherwise(F.lit(""))
    answer = F.lit("\n9 <answer>The Gout!</answer>")
    body = F.when(kind == 0, F.concat(removed, answer)).when(kind == 1, F.concat(F.lit("Another one."), answer)).when(kind == 2, F.lit("loop " * 1700 + "x")).when(kind == 3, F.lit("")).otherwise(F.lit("?"))
    made = rows.select(F.lit("c").alias("case_id"), _id().cast("string").alias("trace_id"), "boundary_index", F.lit(7).alias("rollout_index"), body.alias("continuation"), F.when(kind == 2, "length").otherwise("stop").alias("finish_reason"))
    traces = _items(spark, d).select(_id().cast("string").alias("trace_id"), F.array(F.lit("Sentence 0."), F.lit("Sentence 1.")).alias("sentences"))
    right = lambda r: F.when(r["bucket"].isNotNull(), r["boundary_index"] == 0)
    found = scoring.score_rollouts(made, traces, _overlap, is_correct=right)
    return found.withColumn("first_digest", F.md5(F.coalesce("first_sentence", F.lit("")).cast("binary"))).drop("first_sentence")


_NAMES = "(select p_partkey // 20 as case_no, p_partkey, case when p_partkey % 2 = 0 then p_type else array_to_string(list_reverse(string_split(p_type, ' ')), ' ') end as answer from part)"


def _named(spark, d) -> DataFrame:
    name = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.array_join(F.reverse(F.split("p_type", " ")), " "))
    rows = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 20).cast("string").alias("case_id"), name.alias("answer"), "p_partkey")
    return rows.groupBy("case_id", "answer").agg(F.min("p_partkey").alias("seen"))


@query(f"select case_no::varchar as case_id, answer, first_value(answer) over (partition by case_no, list_sort(string_split(lower(answer), ' ')) order by lower(answer), answer) as entity from (select distinct case_no, answer from {_NAMES})")
def grouped_answers(spark, d):
    """Names of the same words in any order are one, by a judge that goes by words."""
    rows = _named(spark, d)
    return grouping.group_answers(rows, rows.select("case_id", F.lit("").alias("case")).distinct(), grouping.rule_judge)


@query(f"select case_id, entity, case when entity = gold then 9.0 when contains(entity, 'STEEL') then 4.5 end::float as similarity, case when entity = gold then true when contains(entity, 'STEEL') then false end as is_correct from (select distinct case_no::varchar as case_id, answer as entity, min(answer) over (partition by case_no) as gold from {_NAMES})")
def graded_entities(spark, d):
    rows = _named(spark, d).select("case_id", F.col("answer").alias("entity"))
    gold = rows.groupBy("case_id").agg(F.min("entity").alias("gold"))
    return grouping.grade(rows, gold, lambda g, e: 9.0 if g == e else 4.5 if "STEEL" in e else None)


@query("select key, case when p_size % 3 = 0 then 'cached ' || key when p_size % 3 = 1 then upper(p_name) end as reply from (select distinct on (p_name) sha256(p_name) as key, p_name, p_size from (select p_name, min(p_size) as p_size from part group by p_name))")
def asked_with_cache(spark, d):
    """Replies from a cache, from a call, or none from one that fails."""
    rows = table(spark, d, "part").groupBy("p_name").agg(F.min("p_size").alias("p_size")).withColumn("key", F.sha2("p_name", 256))
    cache = rows.where("p_size % 3 = 0").select("key", F.concat(F.lit("cached "), "key").alias("reply"))
    requests = rows.select("key", F.concat_ws("|", (F.col("p_size") % 3).cast("string"), "p_name").alias("payload"))
    return grouping.ask_all(requests, cache, lambda p: p[2:].upper() if p[0] == "1" else None, attempts=1)


@query("select key, round(n / sqrt(n * n + 9), 5) as x, round(3 / sqrt(n * n + 9), 5) as y from (select distinct sha256(p_name) as key, length(p_name)::double as n from part where p_name <> '')")
def embedded_texts(spark, d):
    """Unit vectors by an encoder of length and a constant; a third of them were cached."""
    rows = table(spark, d, "part").select(F.col("p_name").alias("text")).distinct()
    size = F.length("text").cast("double")
    norm = F.sqrt(size * size + 9)
    cache = rows.where(F.length("text") % 3 == 0).select(text.embedding_key(F.col("text")).alias("key"), F.array((size / norm).cast("float"), (3 / norm).cast("float")).alias("vec"))
    found = grouping.embed_all(rows, cache, lambda some: [[float(len(t)), 3.0] for t in some], 2)
    return found.select("key", F.round(F.col("vec")[0].cast("double"), 5).alias("x"), F.round(F.col("vec")[1].cast("double"), 5).alias("y"))


@query()
def normal_tails(spark, d):
    """Two-sided normal tails of whole and half deviations; see the tests for their values."""
    return spark.range(9).select((F.col("id") / 2).alias("z")).withColumn("p", stats.normal_probability(F.col("z")))
