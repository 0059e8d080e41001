"""Declared schemas of the stored relations."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


TEXT, WHOLE, LONG, REAL, TRUTH = T.StringType(), T.IntegerType(), T.LongType(), T.FloatType(), T.BooleanType()

CASES = _struct(case_id=TEXT, source=TEXT, case=TEXT, answer=TEXT)
RESPONSES = _struct(original_message=_struct(role=TEXT, content=TEXT), full_response=TEXT, question_id=TEXT, category=TEXT, question=TEXT, gold_answer=TEXT, dataset_name=TEXT, pmcid=TEXT)
GRADED_RESPONSES = T.StructType(RESPONSES.fields + _struct(extracted_answer=TEXT, similarity_score=T.DoubleType(), is_correct=TRUTH, _true_description=TEXT, _predicted_description=TEXT).fields)
BOUNDARY = _struct(sentence_index=WHOLE, text=TEXT, char_start=WHOLE, char_end=WHOLE, token_start=WHOLE, token_end=WHOLE)
TRACES = _struct(model=TEXT, case_id=TEXT, trace_id=TEXT, full_response=TEXT, prompt_token_count=WHOLE, input_ids=T.ArrayType(WHOLE), sentences=T.ArrayType(BOUNDARY), raw_answer=TEXT, is_correct=TRUTH)
ROLLOUTS = _struct(case_id=TEXT, trace_id=TEXT, boundary_index=WHOLE, rollout_index=WHOLE, prefix_token_count=WHOLE, prefix_sha256=TEXT, output_token_ids=T.ArrayType(WHOLE), continuation=TEXT, finish_reason=TEXT, seed=LONG)
SCORES = _struct(case_id=TEXT, trace_id=TEXT, boundary_index=WHOLE, rollout_index=WHOLE, raw_answer=TEXT, bucket=TEXT, is_correct=TRUTH, first_sentence=TEXT, similarity=REAL, finish_reason=TEXT, valid=TRUTH)
GRADES = _struct(case_id=TEXT, raw_answer=TEXT, canonical=TEXT, similarity=REAL, is_correct=TRUTH, n_rollouts=WHOLE)
SKIPS = _struct(case_id=TEXT, reason=TEXT)
EMBEDDINGS = _struct(key=TEXT, vec=T.ArrayType(REAL), provider=TEXT, model=TEXT, revision=TEXT, dimensions=WHOLE, key_scheme=TEXT)
