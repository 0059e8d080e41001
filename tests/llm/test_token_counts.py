import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracewell.llm.bpe import PrefixCounter, pieces
from tracewell.llm.token_counts import longest_within, prefix_counts, token_prefix_tables

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
COUNTER = PrefixCounter(PATH)


def brute(text):
    return [0] + [len(TOKENIZER.encode(text[:i], add_special_tokens=False).ids) for i in range(1, len(text) + 1)]


TEXTS = [
    "",
    "a",
    "   ",
    "it's we'll they're I'd 'lx 'r",
    "foo  bar \n\n baz\t qux \n",
    "a<|endoftext|>b  <|endoftext|><|endof",
    "Éçeau naïve 日本語 🙂🙂 x y z \x1c\x1d w",
    "=" * 70 + " " * 40 + "end" + "\n" * 9 + "x",
    "word%%% the&&& 12345 a1b2 don't''s \"'s",
]


@pytest.mark.parametrize("text", TEXTS)
def test_every_prefix(text):
    assert list(prefix_counts(COUNTER.of_batch([text])[0])) == brute(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'lrves \n\t1.=é 日<|>")) | st.characters(codec="utf-8"), max_size=40))
def test_any_text(text):
    assert " ".join(pieces(text)) == text
    assert list(prefix_counts(COUNTER.of_batch([text])[0])) == brute(text)


def test_budget():
    counts = prefix_counts(COUNTER.of_batch(["one two three four five"])[0])
    n = longest_within(counts, 3)
    assert counts[n] <= 3 and all(c > 3 for c in counts[n + 1 :])


def test_rows(spark):
    long = "lorem ipsum " * 30_000
    rows = [(1, None, "x"), (2, "", "y"), (None, "hello world", None), (2, "", "y"), (3, long, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(token_prefix_tables(df, PATH, keep_tables=True).collect(), key=lambda r: (r.doc_id or 0, r.n_tokens))
    n = len(TOKENIZER.encode(long).ids)
    assert [(r.doc_id, r.n_bytes, r.n_tokens) for r in got] == [(None, 11, 2), (1, 0, 0), (2, 0, 0), (2, 0, 0), (3, len(long), n)]
    assert len(got[-1].prefix_steps) == len(long)
    assert token_prefix_tables(df.limit(0), PATH).count() == 0
