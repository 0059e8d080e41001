import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tracewell.llm.packing import pack
from tracewell.llm.token_ids import TokenIds

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(df, texts, window=1024, **more):
    rows = pack(df, PATH, window=window, **more).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for doc_id, text in texts:
        want[doc_id].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [0])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc_id, copies in want.items():
        assert len(copies) == 1
        ids = []
        for r in sorted(by_doc.pop(doc_id), key=lambda r: r.start):
            assert r.start == len(ids) and r.doc_tokens == len(copies[0]) and r.length == len(r.ids) // 4 > 0
            ids += np.frombuffer(r.ids, "<u4").tolist()
        assert ids == copies[0]
    assert not by_doc
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, sum(r.length for r in rows)


def test_round_trip(spark):
    texts = [(i, " ".join(["alpha", "beta", "gamma delta"][: 1 + i % 3] * (1 + i * 37 % 400))) for i in range(300)]
    texts += [(900, None), (901, ""), (902, "x  \n " * 9000), (None, "null id <|endoftext|> inside")]
    df = spark.createDataFrame([(i, t, 7) for i, t in texts], "doc_id long, text string, sequence_id long")
    padding, total = check(df.repartition(3), texts)
    assert padding <= 0.02 * total
    check(df.repartition(3), texts, window=16, open_windows=2, merge_windows=2)


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_crc_is_that_of_the_ids(spark):
    from pyspark.sql import functions as F

    r = pack(spark.createDataFrame([(1, "hello world")], "doc_id long, text string"), PATH).withColumn("crc", F.crc32("ids")).first()
    assert r.crc == zlib.crc32(bytes(r.ids))


def test_ids_of_odd_texts():
    tokenizer = Tokenizer.from_file(PATH)
    texts = ["", " ", "a, b. c", "x  y", " \n z", "tab\t q ", "<|endoftext|> a<|endoftext|>b  <|endoftext|>", "1, 2. é, ü.  .", "nbsp\xa0 end", "...", ", .", "a" * 90 + ", " + "b" * 90 + "."]
    r = random.Random(0)
    parts = [*"ab'lrves \n\t1.=é日<|>ZĐ…²\xa0\x1c-,\"(", "  ", "\n\n", "'s", "'ll", " '", "’s", "\u3000"]
    texts += ["".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(5000)]
    encoder = TokenIds(PATH, pieces=3000)
    for _ in range(2):
        assert [x.tolist() for x in encoder.of_batch([t.encode() for t in texts])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_of_one_hash():
    """Thue-Morse words and their complements have the same polynomial hash modulo 2 ** 64, whatever the base."""
    tokenizer, texts = Tokenizer.from_file(PATH), []
    for pair in ("ab", "01"):
        word = pair[0]
        for _ in range(12):
            word += word.translate(str.maketrans(pair, pair[::-1]))
            texts += [word, word.translate(str.maketrans(pair, pair[::-1])), f"x {word}, y"]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = TokenIds(PATH)
    for _ in range(2):
        assert [x.tolist() for x in encoder.of_batch([t.encode() for t in texts])] == want
        assert [encoder.of_batch([t.encode()])[0].tolist() for t in reversed(texts)] == want[::-1]


def test_other_vocabularies_are_refused():
    import pytest

    for name in ("word_bpe_49k.json",):
        with pytest.raises(ValueError):
            TokenIds(public_tokenizers.path(name))
