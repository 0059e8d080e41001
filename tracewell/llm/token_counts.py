"""Token counts of every prefix of every document."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PrefixCounter
from .common import utf8

_counter: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The counter of a vocabulary file, one for each Python process."""
    if path not in _counter:
        _counter[path] = PrefixCounter(path)
    return _counter[path]


def prefix_counts(steps: bytes) -> np.ndarray:
    """The stored table of a text as counts: entry i is the count of its first i characters."""
    out = np.zeros(len(steps) + 1, np.int32)
    np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int32, out=out[1:])
    return out


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(counts <= budget)[-1])


def token_prefix_tables(docs: DataFrame, vocabulary: str, budget: int = 512, keep_tables: bool = False) -> DataFrame:
    """Exact token counts of all prefixes of each text, and what they answer.

    ``vocabulary`` is the path of a byte-level BPE file in the tokenizers format;
    counts are those of that library without added special tokens, special
    strings inside a text being their one token.

    Returns, per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, budget_chars
    (characters of the longest prefix within ``budget`` tokens) and, if
    ``keep_tables``, prefix_steps: one signed byte for each character, the change
    of the count there, which :func:`prefix_counts` turns into the counts.

    Null and empty texts have 0 bytes and 0 tokens. Null ids and repeated rows
    are kept as they are; other columns are left out. An empty table gives an
    empty one. No shuffle; memory is that of one Arrow batch and bounded tables.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tables = count.of_batch(texts)
            tokens, chars = [], []
            for steps in tables:
                counts = prefix_counts(steps)
                tokens.append(int(counts[-1]))
                chars.append(longest_within(counts, budget) if counts[-1] > budget else len(steps))
            columns = [batch.column(0), batch.column(2), pa.array(tokens, pa.int64()), pa.array(chars, pa.int64())]
            names = ["doc_id", "n_bytes", "n_tokens", "budget_chars"]
            if keep_tables:
                columns.append(pa.array(tables, pa.binary()))
                names.append("prefix_steps")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.octet_length(utf8(F.col("text"))).cast("long").alias("n_bytes"))
    schema = "doc_id long, n_bytes long, n_tokens long, budget_chars long" + ", prefix_steps binary" * keep_tables
    return rows.mapInArrow(run, schema)
