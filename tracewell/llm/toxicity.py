"""Toxicity by the nearest labelled examples under TF-IDF cosine."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id
from .terms import Vocabulary, terms_of

#: Texts are scored so many at a time.
AT_ONCE = 128


def least_quadruple(text: str | None) -> int:
    """Least hash of the text's runs of four words, all words if there are fewer."""
    words = (text or "").lower().split()
    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + 4])) for i in range(max(1, len(words) - 3))), default=0) >> 1


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges of ``sizes`` from ``starts``, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class BlockMaxIndex:
    """Postings of vectors by term, their rows in blocks, and the largest weight of each term in each block.

    A search adds up the postings of the less frequent terms. The k-th largest sum
    is a floor of the k-th cosine. A block whose largest sum and the query's
    weights times the block maxima of the ``common`` most frequent terms stay
    below it is skipped; in the others these terms are added as well. So the
    result is that of a full scan.
    """

    def __init__(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, n_terms: int, block: int = 64, common: int = 1024):
        self.n, self.block = n, block
        self.blocks = max(1, -(-n // block))
        order = np.argsort(terms, kind="stable")
        self.rows, self.weights = rows[order].astype(np.int32), weights[order]
        self.sizes = np.bincount(terms, minlength=n_terms)
        self.starts = np.cumsum(self.sizes) - self.sizes
        often = np.argsort(-self.sizes, kind="stable")[:common]
        self.often = often[self.sizes[often] ** 2 > 16 * n]  # others cost less as postings
        self.place = np.full(n_terms, -1, np.int64)
        self.place[self.often] = np.arange(len(self.often))
        self._dense: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_dense": None, "tops": None}

    def forget(self) -> None:
        """Free what a search builds."""
        self._dense = self.tops = None

    @property
    def dense(self) -> np.ndarray:
        """Weights of the frequent terms by block, row and term; the maxima of each block by term."""
        if self._dense is None:
            found = np.zeros((self.blocks * self.block, len(self.often)))
            at = spread(self.starts[self.often], self.sizes[self.often])
            found[self.rows[at], np.repeat(np.arange(len(self.often)), self.sizes[self.often])] = self.weights[at]
            self._dense = found.reshape(self.blocks, self.block, len(self.often))
            self.tops = self._dense.max(1)
        return self._dense

    def search(self, texts: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, k: int, leave_out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For ``n`` queries given as entries, the k rows of highest positive cosine, the least row first among equals.

        Returns rows and cosines, one row of arrays for each query; -1 and 0 fill up. ``leave_out`` names a row for each query that is not to be found.
        """
        dense, wide = self.dense, self.blocks * self.block
        common = self.place[terms] >= 0
        asked = np.zeros((n, len(self.often)))
        asked[texts[common], self.place[terms[common]]] = weights[common]
        sizes = self.sizes[terms[~common]]
        at = spread(self.starts[terms[~common]], sizes)
        where = np.repeat(texts[~common] * wide, sizes) + self.rows[at]
        sums = np.bincount(where, weights=np.repeat(weights[~common], sizes) * self.weights[at], minlength=n * wide).astype(np.float64, copy=False).reshape(n, wide)  # whole numbers if there is nothing to add
        if leave_out is not None:
            sums[np.arange(n), leave_out] = -10.0  # below any cosine
        k = min(k, wide)
        floor = np.partition(sums, wide - k, axis=1)[:, wide - k, None] - 1e-9
        open_blocks = sums.reshape(n, self.blocks, self.block).max(2) + asked @ self.tops.T >= floor
        self.skipped = 1 - open_blocks.mean()
        if self.skipped < 0.5:  # one product over all blocks costs less than a choice of them
            sums += asked @ dense.reshape(wide, -1).T
        else:
            for b in range(self.blocks):
                queries = np.flatnonzero(open_blocks[:, b])
                sums[queries, b * self.block : (b + 1) * self.block] += asked[queries] @ dense[b].T
        rows, cosines = np.full((n, k), -1, np.int64), np.zeros((n, k))
        high = (sums >= floor) & (sums > 0)
        for i in range(n):
            some = np.flatnonzero(high[i])
            found = np.round(sums[i, some], 12)
            if len(found) > k:
                near = found >= np.partition(found, len(found) - k)[len(found) - k]
                some, found = some[near], found[near]
            best = np.argsort(-found, kind="stable")[:k]
            rows[i, : len(best)], cosines[i, : len(best)] = some[best], found[best]
        return rows, cosines


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit, pools having one more example of either kind in all."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for value, label in zip(x[order], y[order], strict=True):
        pools.append([value, label, 1.0])
        while len(pools) > 1 and (pools[-2][0] / pools[-2][2] == pools[-1][0] / pools[-1][2] or pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]):
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])


class ToxicityModel:
    """Labelled examples over all of their terms, and the calibration of their votes.

    ``entries`` are the examples' terms as arrays of example, term, count. A
    term's weight is (1 + ln count) times its ``idf``; vectors have length 1.
    """

    def __init__(self, vocabulary: Vocabulary, idf: np.ndarray, ids: list[int], labels: list[int], entries: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, closeness: float = 0.1):
        self.vocabulary, self.idf, self.k, self.closeness = vocabulary, np.asarray(idf, float), k, closeness
        order = np.lexsort((np.array(ids, np.int64), np.array(labels, np.int64)))  # rows of a label share blocks
        self.ids, self.labels = np.array(ids, np.int64)[order], np.array(labels, float)[order]
        rank = np.zeros(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        self.base = (self.labels.sum() + 0.5) / (len(ids) + 1)
        rows, terms, weights = self.weighted(rank[entries[0]], entries[1], entries[2], len(ids))
        del entries
        self.index = BlockMaxIndex(rows, terms, weights, len(ids), len(vocabulary))
        blank = self.labels[np.bincount(rows, minlength=len(ids)) == 0]
        self.blank = (blank.sum() + self.base) / (len(blank) + 1)
        order = np.argsort(rows, kind="stable")
        rows, terms, weights = rows[order], terms[order], weights[order]
        cuts = np.searchsorted(rows, np.arange(0, len(ids) + AT_ONCE, AT_ONCE))
        votes, marks = [0.0, 1.0], [0.0, 1.0]
        for part, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            own = np.arange(part * AT_ONCE, min(len(ids), (part + 1) * AT_ONCE))
            found = self.index.search(rows[a:b] - part * AT_ONCE, terms[a:b], weights[a:b], len(own), self.k, own)
            some = found[0][:, 0] >= 0
            votes += self.vote(*found)[some].tolist()
            marks += self.labels[own][some].tolist()
        self.knots = isotonic(np.array(votes), np.array(marks))
        self.index.forget()  # the driver has no more use for it

    def weighted(self, texts: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = (1 + np.log(counts)) * self.idf[terms]
        norm = np.sqrt(np.bincount(texts, weights=raw * raw, minlength=n))
        return texts, terms, raw / norm[texts]

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        """Share of label 1 among neighbours, each by the inverse of its distance, and a weak prior."""
        weights = np.where(rows >= 0, 1 / (self.closeness + 1 - np.minimum(cosines, 1.0)), 0.0)
        prior = 0.5 / (self.closeness + 1)
        return (prior * self.base + (weights * np.where(rows >= 0, self.labels[rows], 0.0)).sum(1)) / (prior + weights.sum(1))

    def scored(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of texts, and their nearest examples' rows (-1 for none) and cosines."""
        if not len(self.ids):
            return np.full(len(texts), self.blank), np.full((len(texts), 1), -1), np.zeros((len(texts), 1))
        rows, cosines = self.index.search(*self.weighted(*self.vocabulary.counted(texts), len(texts)), len(texts), self.k)
        scores = np.clip(np.interp(self.vote(rows, cosines), *self.knots), 0.0, 1.0)
        return np.where(rows[:, 0] >= 0, scores, self.blank), rows, cosines


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, examples: int = 4096) -> ToxicityModel:
    """A model from a bounded sample of labelled rows.

    Labelled ids whose CRC-32 as text is not divisible by ``folds`` are
    candidates, and the ``examples`` of least hash of the id that are in ``docs``
    are taken; of repeated rows of an id the least text counts and of repeated
    labels the highest. All terms of the examples are in the index. A term's
    inverse document frequency counts all of ``docs``; where its shares in the
    examples of either label are more than two standard errors apart, it is
    raised by the square of their distance,

        (1 + ln((1 + N) / (1 + df))) * max(1, (distance / (2 standard errors)) ** 2).

    (By the plain factor alone the rare words that two texts happen to share
    outweigh those that the label goes by.) Examples that share the least hash of
    their word quadruples, as near copies do, count as one in these shares. The
    neighbours are as many as a third of the root of the examples.

    Rows of null id or label teach nothing. What reaches the driver is the
    examples' terms, and a count for each of them.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    fold = known.where(crc32_of_id(F.col("id")) % folds != 0).groupBy("id").agg(F.max("y").alias("y"))
    there = docs.select(F.col("doc_id").cast("long").alias("id")).where("id is not null")
    chosen = fold.join(there, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(examples).persist()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"))

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(low, AT_ONCE)
                strings = some.column(1).to_pylist()
                found = [Counter(terms_of(t)) for t in strings]
                lists = [pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array([least_quadruple(t) for t in strings], pa.int64()), *lists], ["id", "y", "sign", "terms", "counts"])

    rows = texts.mapInArrow(parts, "id long, y int, sign long, terms array<string>, counts array<int>").toArrow().combine_chunks()
    chosen.unpersist()
    lists = rows.column("terms").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.string()))
    coded = lists.flatten().dictionary_encode()
    vocabulary = coded.dictionary.to_pylist()
    terms = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    own = np.repeat(np.arange(rows.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False)) if rows.num_rows else np.zeros(0, np.int64)
    counts = rows.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False) if rows.num_rows else np.zeros(0, np.int64)
    ids, y, sign = rows.column("id").to_pylist(), rows.column("y").to_pylist(), rows.column("sign").to_numpy().copy()
    counts = counts.astype(np.int32)
    del rows, lists, coded
    words = Vocabulary(vocabulary)

    def frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = np.zeros(len(words) + 1, np.int64), 0
        for batch in batches:
            total += batch.num_rows
            for low in range(0, batch.num_rows, AT_ONCE):
                found += np.bincount(words.counted(batch.column(0).slice(low, AT_ONCE).to_pylist())[1], minlength=len(found))
        found[-1] = total
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(found[some])], ["term", "n"])

    everywhere = docs.select("text").mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(words) + 1)
    df[everywhere.column("term").to_numpy()] = everywhere.column("n").to_numpy()
    mark = np.array(y, float)
    weight = 1 / np.unique(sign, return_counts=True)[1][np.unique(sign, return_inverse=True)[1]] if len(sign) else np.zeros(0)
    ones, zeros = float((weight * mark).sum()), float((weight * (1 - mark)).sum())
    of_ones = np.bincount(terms, weights=(weight * mark)[own], minlength=len(words))
    of_zeros = np.bincount(terms, weights=(weight * (1 - mark))[own], minlength=len(words))
    share = (of_ones + of_zeros + 0.5) / (ones + zeros + 1)
    apart = (of_ones / max(ones, 1.0) - of_zeros / max(zeros, 1.0)) ** 2 / (share * (1 - share) * (1 / max(ones, 1.0) + 1 / max(zeros, 1.0)))
    idf = (1 + np.log((1 + df[-1]) / (1 + df[:-1]))) * np.maximum(1.0, apart / 4)
    return ToxicityModel(words, idf, ids, y, (own, terms, counts), max(3, math.isqrt(len(ids)) // 3))


def toxicity(docs: DataFrame, model: ToxicityModel, shown: int = 5) -> DataFrame:
    """Score of each text, with the examples that it rests on.

    Returns, per row of ``docs``: doc_id, score (0 to 1), evidence (the nearest
    ``shown`` examples, an array of structs of doc_id, cosine, label).

    A text without terms of the vocabulary (null and empty ones as well) has no
    evidence and the share of label 1 among examples without any. Ids, repeated
    rows and order play no part; other columns are left out. A model without
    examples gives 0.5. No shuffle; the model is sent to the executors and is
    bounded by its examples.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for low in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(low, AT_ONCE)
                scores, rows, cosines = own.scored(some.column(1).to_pylist())
                rows, cosines = rows[:, :shown], cosines[:, :shown]
                there = rows >= 0
                cuts = np.concatenate([[0], np.cumsum(there.sum(1))]).astype(np.int32)
                near = [pa.array(own.ids[rows[there]], pa.int64()), pa.array(cosines[there], pa.float64()), pa.array(own.labels[rows[there]].astype(np.int32))]
                evidence = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays(near, ["doc_id", "cosine", "label"]))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(scores, pa.float64()), evidence], ["doc_id", "score", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id: long, cosine: double, label: int>>")


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """``docs``, all columns, without the rows whose text scores ``threshold`` or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for low in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(low, AT_ONCE)
                yield some.filter(pa.array(own.scored(some.column(at).to_pylist())[0] < threshold))

    return docs.mapInArrow(run, docs.schema)
