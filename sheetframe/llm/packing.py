"""Best-fit packing of token pieces into training sequences under several capacities.

Documents are tokenised once where they lie and cut into pieces; only (id, piece, length, digest) travels. The pieces are
dealt by hash into groups of a fixed mean size and each group is packed by itself: longest first, each piece into the open
bin that it fits in every capacity (tokens, documents, attention cost = sum of squared lengths) and that scores best, by the
weighted norm of what stays free or by the weighted dot product of demand and free capacity. What a group leaves in bins far
from full is dealt into groups once more, those of all groups together, until one group holds the rest; so the loss doesn't
grow with the number of groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_arrow, saved, text_of
from .tokens import default_path, encoder


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most, and the weight of each capacity in the choice of a bin."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"  # or "dot"


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenised_pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece. A document is its ids and a closing 0; one of more than capacity ids is cut into pieces of exactly
    capacity, but for the first, which takes what is left over. with_ids adds the ids themselves. A null text is empty: one
    piece, the closing 0."""
    path = tokenizer or default_path()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(path).ids
        cols: list[list] = [[], [], [], [], [], []]
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = encode(text)
            ids.append(0)
            array, n = np.array(ids, "<u4"), len(ids)
            start, end, piece = 0, n % capacity or min(n, capacity), 0
            while start < n:
                part = array[start:end]
                for to, value in zip(cols, (doc, piece, start, end - start, zlib.crc32(part.tobytes())), strict=False):
                    to.append(value)
                if with_ids:
                    cols[5].append(part.astype(np.int32))
                start, end, piece = end, end + capacity, piece + 1
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in list(zip(cols, kinds, strict=True))[: 5 + with_ids]], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    return map_arrow(rows, cut, PIECES + ", ids array<int>" * with_ids)


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each length, bins numbered from 0. Longest first; ties in the order given."""
    size = np.array([capacity.tokens, capacity.documents, capacity.attention], np.float64)
    weight = np.array(capacity.weights) / (size**2 if capacity.rule == "norm" else size)
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    free = np.zeros((3, 1024))
    names, used, made = np.zeros(1024, np.int64), 0, 0
    for k in np.argsort(-lengths, kind="stable"):
        need = np.array([lengths[k], 1, float(lengths[k]) ** 2])
        if (need > size).any():
            raise ValueError(f"a piece of {lengths[k]} tokens doesn't fit an empty sequence")
        at = -1
        if used:
            left = free[:, :used] - need[:, None]
            fits = np.flatnonzero((left >= 0).all(0))
            if len(fits):
                score = weight @ left[:, fits] ** 2 if capacity.rule == "norm" else -((weight * need) @ free[:, fits])
                at = int(fits[score.argmin()])
        if at < 0:
            if used == free.shape[1]:
                free, names = np.concatenate([free, np.zeros_like(free)], 1), np.concatenate([names, np.zeros_like(names)])
            at, used = used, used + 1
            free[:, at], names[at] = size, made
            made += 1
        bins[k], offsets[k] = names[at], capacity.tokens - free[0, at]
        free[:, at] -= need
        if free[:, at].min() < 1:  # full: the last open bin takes its place
            used -= 1
            free[:, at], names[at] = free[:, used], names[used]
    return bins, offsets


#: Pieces of a group on average, and how full a bin must be, in any of the capacities, not to be packed again.
GROUP_SIZE = 8192
FULL = 0.99


def _shares(lengths: np.ndarray, bins: np.ndarray, capacity: Capacity) -> np.ndarray:
    """The largest share of a capacity that is used in each bin, for each piece's bin."""
    n = int(bins.max(initial=-1)) + 1
    used = (np.bincount(bins, lengths, n) / capacity.tokens, np.bincount(bins, minlength=n) / capacity.documents, np.bincount(bins, lengths.astype(float) ** 2, n) / capacity.attention)
    return np.max(used, axis=0)[bins]


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), group_size: int = GROUP_SIZE) -> DataFrame:
    """pieces (doc_id, piece, length and any other columns, whatever their names) with sequence_id and offset, which take the
    place of columns so named. pieces is read more than once; pass a written table. Groups go by id, piece and place in the
    table, so that null ids and repeated rows are dealt out like any other; each row is packed by itself. Ties go by id and
    piece. An empty table gives an empty one; a piece that doesn't fit an empty sequence is an error."""
    pieces = pieces.drop("sequence_id", "offset")
    names, of, left_open, done = pieces.columns, fresh("group", pieces), fresh("left_open", pieces), []
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + f", sequence_id long, offset long, `{left_open}` boolean"

    def filler(level: int) -> Callable[[pa.Table], pa.Table]:
        def fill(table: pa.Table) -> pa.Table:
            table = table.sort_by([(n, "ascending") for n in ("length", "doc_id", "piece")])
            lengths, group = table.column("length").to_numpy(), table.column(of)[0].as_py()
            bins, offsets = best_fit(lengths, capacity)
            ids, open_ends = bins + (group << 24) + (level << 56), _shares(lengths, bins, capacity) < FULL
            return table.select(names).append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offsets, pa.int64())).append_column(left_open, pa.array(open_ends))

        return fill

    count, level = pieces.count(), 0
    while True:
        groups = max(1, round(count / group_size))
        group = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups))
        packed = pieces.withColumn(of, group).groupBy(of).applyInArrow(filler(level), schema)
        if groups > 1:
            packed = saved(packed)
            before, count, level = count, packed.where(F.col(left_open)).count(), level + 1
        # Pieces most of which stay in bins far from full, such as many of one length, fit no better in another round.
        if groups == 1 or count > before // 2:
            done.append(packed.drop(left_open))
            break
        done.append(packed.where(~F.col(left_open)).drop(left_open))
        pieces = packed.where(F.col(left_open)).select(*names)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, capacity: Capacity = Capacity(), tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is one piece, the closing
    0; texts of any length are encoded whole; repeated rows and null ids are packed each by itself; an empty table gives an
    empty result; columns of docs other than id and text aren't read."""
    return pack(saved(tokenised_pieces(docs, capacity.tokens, tokenizer, id_col=id_col, text_col=text_col)), capacity)
