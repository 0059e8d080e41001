"""Language-model scores of whole documents by context-tree weighting."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Chunk, chunked
from .common import checkpointed, partitions, utf8, written
from .context_tree import EDGE, Level, downward, grouped, strings, upward
from .exchange import ANSWERS, KEYS, KeyExchange, Route

#: Bytes of text whose strings are handled at once.
_BLOCK = 1_000_000
#: What a row of keys holds.
STRINGS, WORDS = 0, 1


def _joined(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings of all positions of some texts, ends included, and where each text's begin."""
    edge = bytes([EDGE])
    sizes = np.fromiter(map(len, texts), np.int64) + 1
    found = strings(b"".join([edge * depth + t + edge for t in texts]), depth)
    # the first ``depth`` of each later text have an edge as their last byte that is none of its own
    keep = np.ones(len(found), bool)
    ends = np.cumsum(sizes + depth) - depth
    for i in range(depth):
        keep[(ends[:-1] + i)] = False
    return found[keep], np.cumsum(sizes) - sizes


def _blocks(texts: list[bytes]) -> Iterator[list[bytes]]:
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size > _BLOCK:
            yield some
            some, size = [], 0
    if some:
        yield some


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts[order], starts)


def _word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    """Even buckets of keys; one bucket for 0 bits."""
    mixed = (keys.view(np.uint64) ^ (keys.view(np.uint64) >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64)


def _words_of(texts: Iterable[bytes]) -> list[bytes]:
    found: set[bytes] = set()
    for text in texts:
        found.update(text.split())
    return list(found)


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_word_key, words), np.uint64, len(words)).view(np.int64)


def _strings_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings of some texts, sorted, and their counts."""
    parts, held = [], 0
    for some in _blocks(texts):
        parts.append(np.unique(_joined(some, depth)[0], return_counts=True))
        held += len(parts[-1][0])
        if held > 1_500_000:
            parts = [_merged(parts)]
            held = len(parts[0][0])
    return _merged(parts) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _put_together(level: Level, context: int) -> tuple[np.ndarray, ...]:
    """What nodes give to those of a shorter context of so many bits: keys, zeros, ones, sums of weighted probabilities."""
    shorter = (level.keys >> 8 & ((1 << context) - 1)) << 8 | (level.keys & 0xFF)
    keys, place = np.unique(shorter, return_inverse=True)
    sums = [np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys))]
    for total, values in zip(sums, (level.zeros, level.ones, level.weighted), strict=True):
        np.add.at(total, place, values)
    return keys, *sums


def _string_values(totals: DataFrame, depth: int, parts: int, bits: int, hot: int) -> DataFrame:
    """Logarithm (base 10) of the model's probability for each distinct string: columns bucket, key, value.

    Strings whose last two context bytes agree are in one partition, which has
    all nodes of depth 2 and more above them. What the nodes of depth 1 and 0
    need is summed from all partitions; these have at most 256 contexts. Where
    more than ``hot`` strings share these two bytes (65,536 contexts at most),
    three have to agree, and the nodes of depth 2 are summed as well.
    """
    two = F.shiftright("key", 8).bitwiseAND(0xFFFF)
    counts = totals.groupBy(two.alias("two")).agg(F.count(F.lit(1)).alias("n"))
    split = sorted(r.two for r in counts.where(F.col("n") > hot).collect()) if depth > 2 else []
    together = F.when(two.isin(split), F.shiftright("key", 8).bitwiseAND(0xFFFFFF).bitwiseOR(1 << 24)).otherwise(two) if split else two
    dealt = totals.repartition(parts, together)

    def kinds(batches: Iterable[pa.RecordBatch]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """The strings of a partition and their counts, by the depth from which it has all of their nodes."""
        table = pa.Table.from_batches(list(batches), pa.schema([("key", pa.int64()), ("n", pa.int64())]))
        found, n = table.column(0).to_numpy(), table.column(1).to_numpy()
        apart = np.isin((found >> 8) & 0xFFFF, split) if split else np.zeros(len(found), bool)
        return [(top, found[some], n[some]) for top, some in ((2, ~apart), (3, apart)) if some.any()]

    def climb(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for top, found, n in kinds(batches):
            for bit, levels in enumerate(upward(found, n, depth, top)):
                keys, *sums = _put_together(levels[0], 8 * (top - 1))
                marks = [pa.array(np.full(len(keys), x, np.int32)) for x in (top - 1, bit)]
                yield pa.RecordBatch.from_arrays([*marks, pa.array(keys), *map(pa.array, sums)], ["depth", "bit", "key", "zeros", "ones", "below"])

    climbed = dealt.mapInArrow(climb, "depth int, bit int, key long, zeros long, ones long, below double").groupBy("depth", "bit", "key")
    # 256 contexts and those that are split, of 255 nodes at most
    rows = climbed.agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).orderBy("depth", "bit", "key").toArrow()
    columns = [rows.column(c).to_numpy() for c in ("depth", "bit", "key", "zeros", "ones", "below")]
    high: list[list[Level]] = []
    deep: list[Level] = []
    for bit in range(8):
        nodes = {d: [c[(columns[0] == d) & (columns[1] == bit)] for c in columns[2:]] for d in (1, 2)}
        deep.append(grouped(*nodes[2]))
        one = grouped(*(np.concatenate(c) for c in zip(nodes[1], _put_together(deep[-1], 8), strict=True)))
        high.append([grouped(one.keys & 0xFF, one.zeros, one.ones, one.weighted), one])

    def descend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for top, found, n in kinds(batches):
            above = high if top == 2 else [a + [b] for a, b in zip(high, deep, strict=True)]
            trees = [a + b for a, b in zip(above, upward(found, n, depth, top), strict=True)]
            for low in range(0, len(found), 200_000):
                some = found[low : low + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(_bucket(some, bits)), pa.array(some), pa.array(downward(some, trees, depth, 0) / math.log(10))], ["bucket", "key", "value"])

    return dealt.mapInArrow(descend, "bucket long, key long, value double")


def language_scores(docs: DataFrame, folds: int = 10, depth: int = 5, chunk_bytes: int = 16_000_000, bucket_bytes: int = 16_000_000, fan: int = 8, hot: int = 4_000_000) -> DataFrame:
    """Log-probabilities of whole texts under a byte model and a base model of words.

    Learns from rows whose CRC-32 of the id as text is not divisible by
    ``folds``. Texts are UTF-8 with A-Z lowered. The model is context-tree
    weighting over the last ``depth`` bytes (:mod:`~.context_tree`), the text's end
    being one more symbol; its counts come from all training texts, and the
    logarithms that it gives to bytes are rounded to single precision. The base
    adds 0.1 to the counts of words and ends.

    Returns, per row of ``docs``: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score (both base 10), bits_per_byte (code length of
    the text and its end over its bytes and one).

    Null and empty texts hold the end alone. Null ids are held out: the CRC-32 of
    nothing is 0. Repeated rows count as often as they come; other columns are
    left out. An empty table gives an empty one; without training rows every
    probability is that of no counts.

    Each chunk of documents (:mod:`~.chunks`) sends its distinct words and strings
    with their training counts to buckets by a hash, once each, and gets back the
    values in the same order (:mod:`~.exchange`, ``fan`` bits of buckets at a time). So nothing is broadcast, and no task holds more than
    a chunk, a bucket, or the distinct strings that share two bytes of context, three
    where there are more than ``hot`` of these.
    Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(utf8(F.col("text"))))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(total, 1) / bucket_bytes)))
    chunks = chunked(docs, chunk_bytes)
    ways = KeyExchange(Route(bits, chunks.count(), fan), bits, _bucket, lambda values, starts, _: np.add.reduceat(values, starts))

    def split(chunk: Chunk) -> tuple[list[bytes], np.ndarray]:
        texts = [t.lower() for t in chunk.texts()]
        held = np.array([zlib.crc32(str(i).encode() if i is not None else b"") % folds == 0 for i in chunk.doc_ids()], bool)
        return texts, held

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts, held = split(Chunk.unpack(blob))
                counted: Counter = Counter()
                for text, out in zip(texts, held.tolist(), strict=True):
                    counted.update(dict.fromkeys(text.split(), 0) if out else text.split())
                word_counts = np.fromiter(counted.values(), np.int64, len(counted))
                words = _hashed(list(counted))
                del counted
                seen, n = _strings_of([t for t, out in zip(texts, held, strict=True) if not out], depth)
                other, _ = _strings_of([t for t, out in zip(texts, held, strict=True) if out], depth)
                found, counts = _merged([(seen, n), (other, np.zeros(len(other), np.int64))])
                ends = int((~held).sum())
                for kind, keys, values in ((STRINGS, found, counts), (WORDS, words, word_counts)):
                    order = ways.order(keys)
                    for bucket, *packed in ways.rows(keys[order], values[order]):
                        row = [pa.array([kind], pa.int32()), pa.array([bucket], pa.int64()), pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in packed), pa.array([ends], pa.int64())]
                        yield pa.RecordBatch.from_arrays(row, ["kind", "bucket", "source", "keys", "values", "ends"])
                        ends = 0

    def count_words(group: pa.Table) -> pa.Table:
        sizes, keys, totals, place = ways.opened(group)
        first = [1] + [0] * (len(sizes) - 1)
        stats = {"distinct": int((totals > 0).sum()), "tokens": int(totals.sum())}
        return pa.table(ways.answers(group, sizes, totals[place]) | {k: pa.array([v * f for f in first], pa.int64()) for k, v in stats.items()})

    def count_strings(group: pa.Table) -> pa.Table:
        _, keys, totals, _ = ways.opened(group)
        return pa.table({"key": pa.array(keys), "n": pa.array(totals)})

    def value_strings(left: pa.Table, right: pa.Table) -> pa.Table:
        sizes, keys, _, place = ways.opened(left)
        known, value = right.column("key").to_numpy(), right.column("value").to_numpy()
        order = np.argsort(known)
        if len(known) != len(keys) or (known[order] != keys).any():
            raise RuntimeError("strings and their values differ")
        return pa.table(ways.answers(left, sizes, value[order][place].astype(np.float32)))

    sent = written(chunks.mapInArrow(send, "kind int, " + KEYS + ", ends long"))
    strings_sent, words_sent = (ways.up(sent.where(F.col("kind") == kind).select("bucket", "source", "keys", "values")) for kind in (STRINGS, WORDS))
    word_replies = checkpointed(words_sent[-1].groupBy("bucket").applyInArrow(count_words, ANSWERS + ", distinct long, tokens long"))
    distinct, tokens = word_replies.agg(F.sum("distinct"), F.sum("tokens")).first()
    ends = sent.agg(F.sum("ends")).first()[0] or 0
    n, v = (tokens or 0) + ends, (distinct or 0) + (ends > 0)
    scale = math.log10(n + 0.1 * (v + 1))
    end = math.log10(ends + 0.1) - scale

    string_totals = checkpointed(strings_sent[-1].groupBy("bucket").applyInArrow(count_strings, "key long, n long"))
    parts = max(partitions(spark), 1 + string_totals.count() // 1_000_000)
    values = _string_values(string_totals, depth, parts, bits, hot)
    string_replies = strings_sent[-1].groupBy("bucket").cogroup(values.groupBy("bucket")).applyInArrow(value_strings, ANSWERS)
    word_answers = ways.down(words_sent, word_replies.select("bucket", "source", "values"), np.int64)
    string_answers = ways.down(strings_sent, string_replies, np.float32)
    answered = word_answers.withColumn("kind", F.lit(WORDS)).unionByName(string_answers.withColumn("kind", F.lit(STRINGS)))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if len(left) != 1:
            raise RuntimeError("a chunk is not one row")
        chunk = Chunk.unpack(left.column("blob")[0].as_py())
        texts, held = split(chunk)
        replies: dict[int, dict[int, bytes]] = {STRINGS: {}, WORDS: {}}
        for kind, bucket, blob in zip(*(right.column(c).to_pylist() for c in ("kind", "bucket", "values")), strict=True):
            replies[kind][bucket] = blob

        words = _words_of(texts)
        counts = ways.back(_hashed(words), replies[WORDS], np.int64)
        unknown = math.log10(0.1) - scale
        cache = dict(zip(words, np.where(counts > 0, np.log10(counts + 0.1) - scale, unknown).tolist(), strict=True))
        del words, counts
        n_tokens, n_known, base = [], [], []
        for text in texts:
            own = [cache[w] for w in text.split()]
            n_tokens.append(len(own) + 1)
            n_known.append(len(own) - own.count(unknown) + (ends > 0))
            base.append(math.fsum(own) + end)
        del cache
        keys = _strings_of(texts, depth)[0]
        value = ways.back(keys, replies[STRINGS], np.float32).astype(np.float64)
        among = pa.array(keys)
        scores: list[np.ndarray] = []
        for some in _blocks(texts):
            found, starts = _joined(some, depth)
            scores.append(np.add.reduceat(value[pc.index_in(pa.array(found), value_set=among).to_numpy()], starts))
        total_score = np.concatenate(scores)
        size = np.array([len(t) + 1 for t in texts])
        columns = {
            "doc_id": pa.array(chunk.doc_ids(), pa.int64()), "held_out": pa.array(held), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array([n] * len(texts), pa.int64()),
            "base_score": pa.array(base, pa.float64()), "score": pa.array(total_score), "bits_per_byte": pa.array(-total_score * math.log2(10) / size),
        }
        return pa.table(columns)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return chunks.groupBy("chunk").cogroup(answered.groupBy("source")).applyInArrow(score, schema)
