"""From responses to traces whose sentences are exact cuts between tokens."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers, reasoning, sentences

#: A tokenizer: token ids of a text and the characters that each covers, without special tokens.
Encode = Callable[[str], tuple[list[int], list[tuple[int, int]]]]

TRACE = (
    "case_id string, trace_id string, full_response string, prompt_token_count int, input_ids array<int>, raw_answer string,"
    " sentences array<struct<sentence_index: int, text: string, char_start: int, char_end: int, token_start: int, token_end: int>>, reason string"
)


def prepared(full: str, prompt: str, encode: Encode, named: str | None, rules: str) -> dict:
    """Token ids, prompt's tokens and sentence boundaries of one response; an error says why there are none."""
    ids, offsets = encode(full)
    n_prompt = sentences.prompt_tokens(full, prompt, offsets)
    thought, _ = reasoning.extract(full, prompt, named)
    at = full.find(thought, len(prompt)) if thought else -1
    if at < 0:
        raise sentences.BoundaryError("the reasoning is no verbatim part of the response")
    span = sentences.token_span(offsets, at, at + len(thought))
    found = sentences.find_strictly(full, sentences.split(thought, rules), offsets, at, (max(n_prompt, span[0]), span[1]))
    if not found:
        raise sentences.BoundaryError("no sentences")
    return {"input_ids": ids, "prompt_token_count": n_prompt, "sentences": found}


def prepare_traces(responses: DataFrame, encode: Encode, named: str | None = None, rules: str = "clinical", readers: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Traces of responses (case_id, prompt, full_response), and a skip log (case_id, reason) of those that can't be cut.

    A trace's id is the SHA-256 of its response.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for case_id, prompt, full in zip(rows["case_id"], rows["prompt"], rows["full_response"], strict=True):
                full = full or ""
                made = {"case_id": case_id, "trace_id": hashlib.sha256(full.encode()).hexdigest(), "full_response": full, "raw_answer": answers.extract(full[len(prompt or "") :], readers)}
                try:
                    made |= prepared(full, prompt or "", encode, named, rules)
                except sentences.BoundaryError as e:
                    made["reason"] = str(e)
                out.append(made)
            names = ["case_id", "trace_id", "full_response", "prompt_token_count", "input_ids", "raw_answer", "sentences", "reason"]
            yield pd.DataFrame({n: pd.Series([m.get(n) for m in out], dtype="object") for n in names})

    made = responses.select("case_id", "prompt", "full_response").mapInPandas(run, TRACE)
    return made.where("reason is null").drop("reason"), made.where("reason is not null").select("case_id", "reason")


def rebuilt(base: str, offsets: Sequence[tuple[int, int]], prefix_tokens: int, continuation: str) -> str:
    """The response that a sample stands for: the base's text up to a token, and the continuation."""
    if not 0 < prefix_tokens < len(offsets):
        raise sentences.BoundaryError(f"a prefix of {prefix_tokens} tokens is outside of the base")
    return base[: offsets[prefix_tokens][0]] + continuation


def eligible(responses: DataFrame, named: str | None = None, rules: str = "clinical") -> DataFrame:
    """Number of sentences of each case whose reasoning stands verbatim in its response."""
    found = responses.withColumn("found", reasoning.extract_column(F.col("full_response"), F.col("prompt"), named)["text"])
    inside = found.where((F.col("found") != "") & F.contains(F.col("full_response"), F.col("found")))
    return inside.select("case_id", F.size(sentences.split_column(F.col("found"), rules)).alias("n_sentences"))
