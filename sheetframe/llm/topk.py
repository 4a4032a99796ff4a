"""Exact top-k inner-product search by columnar branch-and-bound.

Candidates are laid out vertically, a row per dimension, in blocks. A query adds up its score one block of dimensions after
another; after each, a candidate whose partial score plus the largest product that its remaining mass and the query's allow
(Cauchy-Schwarz) stays below the query's k-th best so far is dropped and the survivors are compacted. Components are whole
numbers, so scores are exact.

Queries and candidates are written tables in the shared folder, the queries in blocks of bounded size. The unit of work is a
block of queries and a span of candidate files: a task reads both from the shared folder, streams its candidates past its
queries and gives k rows for each query, so neither passes through the driver and a task's memory is that of one block.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir

#: Queries in one block: at 64 dimensions 2 MB.
QUERY_BLOCK = 4096
CHUNK = 8192
DIMENSIONS = 8
_EXACT = float(2**52)


def _floor(x: Column) -> Column:
    """As double; those beyond 2^52 are whole already."""
    return F.when(F.abs(x) < _EXACT, F.floor(x).cast("double")).otherwise(x)


def whole_vectors(vectors: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v: each component x as floor(scale * x). Rows whose id or vector is null, or whose vector holds null or
    non-finite components, or one that the scale makes so, are left out. An empty vector is a vector like any other."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), F.transform(vectors[vector_col].cast("array<double>"), lambda x: x * F.lit(scale)).alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(~bad).select("vec_id", F.transform(v, _floor).alias("v"))


class Best:
    """The k best (score, id) of each query so far; of equal scores the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        n, d = vectors.shape
        self.scores, self.found, self.have = np.full((n, k), -np.inf), np.zeros((n, k), np.int64), np.zeros(n, np.int64)
        edges = list(range(0, d, DIMENSIONS)) + [d]
        self.blocks = list(zip(edges, edges[1:], strict=False)) or [(0, 0)]
        squares = vectors**2
        self.rest = [np.sqrt(squares[:, b:].sum(1)) for _, b in self.blocks]
        self.top = float(np.abs(vectors).max(initial=0))

    def _merge(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        own = ids != self.ids[q]
        ids, scores = np.concatenate([self.found[q, : self.have[q]], ids[own]]), np.concatenate([self.scores[q, : self.have[q]], scores[own]])
        if len(ids) > 4 * self.k:  # only what reaches the k-th score
            near = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            ids, scores = ids[near], scores[near]
        order = np.lexsort((ids, -scores))[: self.k]
        self.have[q] = len(order)
        self.found[q, : len(order)], self.scores[q, : len(order)] = ids[order], scores[order]

    def add(self, ids: np.ndarray, columns: np.ndarray) -> None:
        """columns: a row per dimension, a column per candidate."""
        d = len(columns)
        if d * self.top * float(np.abs(columns).max(initial=0)) >= _EXACT:
            return self._add_large(ids, columns)
        if not len(self.ids):
            return None
        squares = columns**2
        rest = [np.sqrt(squares[b:].sum(0)) for _, b in self.blocks]
        a, b = self.blocks[0]
        for at in range(0, len(self.ids), 64):
            part = self.vectors[at : at + 64]
            first = part[:, a:b] @ columns[a:b]
            for k in range(len(part)):
                q, score, alive = at + k, first[k], None
                if self.have[q] == self.k:
                    least = self.scores[q, -1]
                    alive = np.flatnonzero(score + self.rest[0][q] * rest[0] * (1 + 1e-9) + 1e-6 >= least)
                    score = score[alive]
                for s, (lo, hi) in enumerate(self.blocks[1:], 1):
                    if alive is None:
                        score = score + self.vectors[q, lo:hi] @ columns[lo:hi]
                        continue
                    if not len(alive):
                        break
                    score = score + self.vectors[q, lo:hi] @ columns[lo:hi, alive]
                    stay = np.flatnonzero(score + self.rest[s][q] * rest[s][alive] * (1 + 1e-9) + 1e-6 >= least)
                    if len(stay) < len(alive):
                        alive, score = alive[stay], score[stay]
                self._merge(q, ids if alive is None else ids[alive], score)

    def _add_large(self, ids: np.ndarray, columns: np.ndarray) -> None:
        """Products beyond what doubles hold exactly: whole numbers of any size, no bounds."""
        ints = [[int(x) for x in c] for c in columns.T]
        self.scores = self.scores.astype(object)
        for q, vector in enumerate(self.vectors):
            own = [int(x) for x in vector]
            scored = [(-sum(x * y for x, y in zip(own, c, strict=True)), int(i)) for c, i in zip(ints, ids, strict=True) if i != self.ids[q]]
            scored += [(-int(s), int(i)) for s, i in zip(self.scores[q, : self.have[q]], self.found[q], strict=False)]
            best = sorted(scored)[: self.k]
            self.have[q] = len(best)
            for k, (s, i) in enumerate(best):
                self.scores[q, k], self.found[q, k] = -s, i

    def rows(self) -> Iterator[tuple[int, int, int]]:
        """(query's place, id, score); scores beyond 64 bits are held at the largest or smallest long."""
        for q, n in enumerate(self.have):
            for i, s in zip(self.found[q, :n], self.scores[q, :n], strict=True):
                yield q, int(i), max(-(2**63), min(2**63 - 1, int(s)))


def _files(folder: str) -> list[str]:
    """The Parquet files below a folder, in order, by path within its store."""
    store, base = fs.FileSystem.from_uri(folder)
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True)) if f.is_file and f.path.endswith(".parquet"))


def _batches(folder: str, files: list[str]) -> Iterator[pa.RecordBatch]:
    store, _ = fs.FileSystem.from_uri(folder)
    for path in files:
        with store.open_input_file(path) as f:
            yield from pq.ParquetFile(f).iter_batches(CHUNK, columns=["vec_id", "v"])


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, vectors) of a batch, by the length of the vectors."""
    vectors = batch.column(1)
    lengths = vectors.value_lengths().to_numpy()
    for d in np.unique(lengths):
        own = np.flatnonzero(lengths == d)
        yield int(d), own, vectors.take(pa.array(own)).flatten().to_numpy().reshape(len(own), d)


def _answer(folder: str, block: int, span: int, spans: int, k: int) -> Iterator[pa.RecordBatch]:
    """(block, place, query_id, vec_id, score): the best of a span of candidates for each query of a block."""
    by_length: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    begin = 0
    for batch in _batches(f"{folder}/queries", _files(f"{folder}/queries/block={block}")):
        for d, own, vectors in _parts(batch):
            by_length.setdefault(d, []).append((begin + own, batch.column(0).to_numpy()[own], vectors))
        begin += batch.num_rows
    asked = {d: tuple(map(np.concatenate, zip(*parts, strict=True))) for d, parts in by_length.items()}
    best = {d: Best(ids, vectors, k) for d, (_, ids, vectors) in asked.items()}
    for batch in _batches(f"{folder}/candidates", _files(f"{folder}/candidates")[span::spans]):
        ids = batch.column(0).to_numpy()
        for d, own, vectors in _parts(batch):
            if d in best:
                best[d].add(ids[own], np.ascontiguousarray(vectors.T))
    for d, found in best.items():
        places, query_ids, _ = asked[d]
        rows = [(block, places[q], query_ids[q], i, s) for q, i, s in found.rows()]
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["block", "place", "query_id", "vec_id", "score"])


def search(candidates: DataFrame, queries: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of queries its k highest inner products among the candidates of
    its length with another id, ties to the smaller id. Both tables as whole_vectors() gives them. A candidate row counts as
    often as it is there; equal query rows are answered once, and rows with one id and several vectors each by itself, under
    that id. Without candidates a query has no rows, and without queries there are none. The shared folder must be a URI that
    pyarrow.fs opens."""
    spark = candidates.sparkSession
    folder = f"{shared_dir(spark)}/search/{uuid.uuid4().hex}"
    asked = queries.select("vec_id", "v").distinct()
    blocks = max(1, math.ceil(asked.count() / query_block))
    asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))).write.partitionBy("block").parquet(f"{folder}/queries")
    candidates.select("vec_id", "v").write.parquet(f"{folder}/candidates")
    # Blocks are enough work for a large table; where they are fewer than the cores, candidates are dealt out too.
    spans = max(1, math.ceil(spark.sparkContext.defaultParallelism / blocks))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.column(0).to_pylist():
                yield from _answer(folder, unit // spans, unit % spans, spans, k)

    part = spark.range(0, blocks * spans, 1, blocks * spans).mapInArrow(scan, "block long, place long, query_id long, vec_id long, score long")
    order = Window.partitionBy("block", "place", "query_id").orderBy(F.col("score").desc(), "vec_id")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_inner_products(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """search() with the rows whose id is divisible by `every` as queries, against all rows; nulls are as in whole_vectors()."""
    whole = whole_vectors(vectors, scale, id_col, vector_col)
    return search(whole, whole.where(F.col("vec_id") % every == 0), k)
