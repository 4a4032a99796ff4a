"""Hashed n-grams: the features of the generative models."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_pieces

#: Buckets of either order: word unigrams, then word bigrams.
BUCKETS = 1 << 13
SIZE = 2 * BUCKETS
#: Buckets of words where only their presence in a text counts.
WORDS = 1 << 18

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_REPEAT = 1  # the bigram hash of any word and itself


class _Hashes(dict):
    """Hashes of words that a worker has met; emptied when it has grown to some 15 MB."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_known = _Hashes()


def buckets(text: str) -> np.ndarray:
    """The bucket of each unigram and bigram of the lower-cased words and punctuation runs. A word after itself is one
    bigram whatever the word, since repetition is a trait of its own."""
    return buckets_of(word_hashes(text))


def word_hashes(text: str) -> np.ndarray:
    """The hashes of the lower-cased words and punctuation runs, in order."""
    return np.array(list(map(_known.__getitem__, _TOKEN.findall(text.lower()))), np.uint64)


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    """As buckets, from word_hashes."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    pairs = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[1:]) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(33)
    pairs[hashes[:-1] == hashes[1:]] = _REPEAT
    return np.concatenate([hashes % np.uint64(BUCKETS), pairs % np.uint64(BUCKETS) + np.uint64(BUCKETS)]).astype(np.int64)


def words_in(hashes: np.ndarray) -> np.ndarray:
    """The word buckets, of WORDS, that a text has; each once."""
    return np.unique(hashes % np.uint64(WORDS)).astype(np.int64)


def presence_counts(docs: DataFrame, classes: int) -> np.ndarray:
    """docs (text string, class int from 0) to counts[class, word bucket]: how many texts of the class have the word; the
    last column is how many texts the class has. So many numbers reach the driver at most, as for model_counts."""
    width = WORDS + 1

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((classes, width), np.int64)
        for batch in batches:
            for text, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[kind, words_in(word_hashes(text))] += 1
                counts[kind, WORDS] += 1
        at = np.flatnonzero(counts.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts.ravel()[at])], names=["at", "n"])

    out = np.zeros(classes * width)
    for r in docs.select("text", "class").mapInArrow(by_pieces(scan), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(classes, width)


def model_counts(docs: DataFrame, classes: int) -> np.ndarray:
    """docs (text string, class int from 0, or null for none) to counts[class, bucket] over all rows; the last row counts the
    rows without class too, so it covers the whole table: counts[classes] is everything. A task gives at most
    (classes + 1) x SIZE sums, added up before and after the shuffle; so many numbers reach the driver."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((classes + 1, SIZE), np.int64)
        held: list[list[np.ndarray]] = [[] for _ in range(classes + 1)]

        def add() -> None:
            for k, parts in enumerate(held):
                if parts:
                    counts[k] += np.bincount(np.concatenate(parts), minlength=SIZE)
                    parts.clear()
            counts[classes] += counts[:classes].sum(0) - before
            before[:] = counts[:classes].sum(0)

        before, weight = np.zeros(SIZE, np.int64), 0
        for batch in batches:
            for text, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = buckets(text)
                held[classes if kind is None else kind].append(own)
                weight += len(own)
                if weight > 1 << 20:
                    add()
                    weight = 0
        add()
        at = np.flatnonzero(counts.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts.ravel()[at])], names=["at", "n"])

    sums = docs.select("text", "class").mapInArrow(by_pieces(scan), "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    out = np.zeros((classes + 1) * SIZE)
    for r in sums.collect():
        out[r["at"]] = r["n"]
    return out.reshape(classes + 1, SIZE)
