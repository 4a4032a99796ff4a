"""Exact duplicates by content sort.

Texts are normalised to bytes, range-partitioned by sampled splitters, and sorted externally, so equal texts lie next to
each other; one streaming pass compares each text in full with its neighbour and numbers the runs. The splitter key is
(leading bytes, 64-bit hash, id, place): a sample of it is small whatever the length of the texts, and a text that a third of
all rows share, even under one id, is cut into as many partitions as its share asks for. Only runs of a partition's first and
last key can go on elsewhere; those, at most two a partition but for hash collisions, are put together by digest in a
broadcast table. A pass holds one text and, to number a run, the ids of its own partition's part of it.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_pieces, map_arrow, saved, shuffle_partitions, text_of

PREFIX_BYTES = 64
_NO_ID = -(2**63)


def _order(keep: str) -> Column:
    return F.col("_doc").desc_nulls_last() if keep == "largest" else F.col("_doc").asc_nulls_last()


def _placed(docs: DataFrame, keep: str, id_col: str, text_col: str, carried: list[T.StructField], partitions: int | None) -> DataFrame:
    """(_doc, _norm, _mixed, carried columns as c0, c1, ...) in sorted partitions; of equal texts the one that stays is first."""
    into = docs.select(F.nullif(docs[id_col].cast("long"), F.lit(_NO_ID)).alias("_doc"), text_of(docs, text_col).alias("_text"), *(docs[f"`{f.name}`"].alias(f"c{k}") for k, f in enumerate(carried)))

    def lowered(batch: pa.RecordBatch) -> pa.RecordBatch:
        norm = pa.array([t.lower() for t in batch.column(1).cast(pa.binary()).to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), norm, *batch.columns[2:]], names=["_doc", "_norm", *batch.schema.names[2:]])

    kinds = T.StructType([T.StructField("_doc", T.LongType()), T.StructField("_norm", T.BinaryType()), *(T.StructField(f"c{k}", f.dataType) for k, f in enumerate(carried))])
    rows = map_arrow(into, lowered, kinds).withColumn("_place", F.monotonically_increasing_id())
    lead, mixed = F.substring("_norm", 1, PREFIX_BYTES), F.xxhash64("_norm")
    placed = rows.repartitionByRange(partitions or shuffle_partitions(docs.sparkSession), lead, mixed, _order(keep), "_place")
    return placed.sortWithinPartitions(lead, mixed, "_norm", _order(keep), "_place").select("_doc", "_norm", mixed.alias("_mixed"), *(f"c{k}" for k in range(len(carried))))


class _Runs:
    """Takes sorted rows; gives them back with their run's digest, kept id, size and whether it may go on elsewhere."""

    SCHEMA = "_id long, _sha binary, _keep long, _size long, _head boolean, _edge boolean, _part int"

    def __init__(self, part: int, rows_per: int = 16_384):
        self.part, self.rows_per = part, rows_per
        self.first_key = self.key = self.norm = None
        self.ids = array("q")
        self.open: list[list] = []  # runs of the current key: digest, first id, size
        self.done: list[tuple[bytes, int | None, int, bool]] = []  # and of earlier ones, with whether they may go on

    def close_key(self, last: bool) -> None:
        edge = last or self.key == self.first_key
        self.done += [(sha, keep, size, edge) for sha, keep, size in self.open]
        self.open = []

    def flush(self) -> Iterator[pa.RecordBatch]:
        """All rows of the runs done."""
        if not self.done:
            return
        sha, keep, size, edge = (pa.array(c, t) for c, t in zip(zip(*self.done, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.bool_()), strict=True))
        sizes = size.to_numpy()
        run, n = np.repeat(np.arange(len(sizes)), sizes), int(sizes.sum())
        head = np.zeros(n, bool)
        head[np.cumsum(sizes) - sizes] = True
        ids, self.ids, self.done = np.frombuffer(self.ids[:n], np.int64), self.ids[n:], []
        for at in range(0, n, self.rows_per):
            own, which = ids[at : at + self.rows_per], pa.array(run[at : at + self.rows_per])
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int64(), mask=own == _NO_ID), sha.take(which), keep.take(which), size.take(which), pa.array(head[at : at + len(own)]), edge.take(which), pa.array(np.full(len(own), self.part, np.int32))],
                names=["_id", "_sha", "_keep", "_size", "_head", "_edge", "_part"],
            )

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for doc, norm, h in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if norm != self.norm:
                key = (norm[:PREFIX_BYTES], h)
                if key != self.key:
                    if self.key is not None:
                        self.close_key(False)
                        if len(self.ids) >= self.rows_per:
                            yield from self.flush()
                    self.key = key
                    if self.first_key is None:
                        self.first_key = key
                self.norm = norm
                self.open.append([hashlib.sha256(norm).digest(), doc, 0])
            self.open[-1][2] += 1
            self.ids.append(_NO_ID if doc is None else doc)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.key is not None:
            self.close_key(True)
            yield from self.flush()


def content_sort(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. Texts are equal when their bytes are, after
    lower-casing A-Z; a null text counts as empty, and a text of any length is compared whole. keep is which id of a group
    stays, "smallest" or "largest". A null id, and the least long, which counts as one, never stay where another row of the
    group has an id; of repeated rows with the id that stays, exactly one is kept. An empty table gives an empty result; columns
    of docs other than id and text aren't read."""

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(TaskContext.get().partitionId())
        for batch in batches:
            yield from runs.add(batch)
        yield from runs.end()

    found = saved(_placed(docs, keep, id_col, text_col, [], partitions).mapInArrow(by_pieces(walk), _Runs.SCHEMA))
    best = F.max if keep == "largest" else F.min
    edges = (
        found.where("_edge")
        .groupBy(F.col("_sha").alias("_edge_sha"))
        .agg(best("_keep").alias("_all_keep"), F.sum(F.when(F.col("_head"), F.col("_size"))).alias("_all_size"), F.min("_part").alias("_first"))
    )
    joined = found.join(F.broadcast(edges), F.col("_edge") & (F.col("_sha") == F.col("_edge_sha")), "left")
    first = F.coalesce("_first", "_part") == F.col("_part")
    return joined.select(
        F.col("_id").alias("doc_id"),
        F.coalesce("_all_keep", "_keep").alias("keep_id"),
        F.coalesce("_all_size", "_size").alias("group_size"),
        (F.col("_head") & first).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """docs with one row of each group of equal texts, columns as they are, whatever their names: the row that content_sort
    keeps, with the same say on nulls, ties and repeated rows. Only the first row of each run is passed on, so a text that very
    many rows share is held once."""
    carried = list(docs.schema)
    def heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, norm, first_key, last_key = TaskContext.get().partitionId(), None, None, None
        held: list[pa.RecordBatch] = []

        def given(rows: list[pa.RecordBatch], is_last: bool) -> Iterator[pa.RecordBatch]:
            for out in rows:
                keys = list(zip((n[:PREFIX_BYTES] for n in out.column(1).to_pylist()), out.column(2).to_pylist(), strict=True))
                edge = [k == first_key or is_last and k == last_key for k in keys]
                sha = [hashlib.sha256(n).digest() if e else None for n, e in zip(out.column(1).to_pylist(), edge, strict=True)]
                arrays = [*out.columns[3:], pa.array(sha, pa.binary()), pa.array([part] * out.num_rows, pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*out.schema.names[3:], "_sha", "_part"])

        for batch in batches:
            norms = batch.column(1).to_pylist()
            new = [k for k, n in enumerate(norms) if n != (norms[k - 1] if k else norm)]
            if not norms:
                continue
            norm = norms[-1]
            if not new:
                continue
            rows = batch.take(pa.array(new))
            key_of = lambda k: (norms[k][:PREFIX_BYTES], batch.column(2)[k].as_py())
            if first_key is None:
                first_key = key_of(0)
            # Runs of the last key may go on in the next partition: the heads of that key wait for the next batch.
            key = key_of(new[-1])
            if key != last_key:
                yield from given(held, False)
                held = []
            last_key = key
            split = next(i for i, k in enumerate(new) if key_of(k) == key)
            if split:
                yield from given([rows.slice(0, split)], False)
            held.append(rows.slice(split))
        yield from given(held, True)

    kinds = T.StructType([*(T.StructField(f"c{k}", f.dataType) for k, f in enumerate(carried)), T.StructField("_sha", T.BinaryType()), T.StructField("_part", T.IntegerType())])
    found = saved(_placed(docs, keep, id_col, text_col, carried, partitions).mapInArrow(by_pieces(heads), kinds))
    firsts = found.where("_sha is not null").groupBy(F.col("_sha").alias("_edge_sha")).agg(F.min("_part").alias("_first"))
    joined = found.join(F.broadcast(firsts), F.col("_sha") == F.col("_edge_sha"), "left")
    return joined.where(F.coalesce("_first", "_part") == F.col("_part")).select(*(F.col(f"c{k}").alias(f.name) for k, f in enumerate(carried)))
