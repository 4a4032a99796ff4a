"""Merged ranges: which range a cell belongs to.

Ranges of a sheet don't overlap, but nothing bounds how many there are, so the lookup is an equi-join on a block of rows and
not a nested loop: the ranges that reach a block stand together under it, and a cell meets those of its own block once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256


def merged_lookup(cells: DataFrame, ranges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """cells (row, col, ...) with merged boolean and range string (null outside). ranges: row1, col1, row2, col2, ref, position;
    both have the columns `by`, such as the file, if any. Of ranges that overlap the first by position counts. Rows of cells
    stay as often as they are there."""
    box = F.struct(F.col("position"), "row1", "col1", "row2", "col2", "ref")
    block = F.explode(F.sequence(F.floor(F.col("row1") / BLOCK), F.floor(F.col("row2") / BLOCK))).alias("_block")
    own = [F.col(k).alias(f"_by{n}") for n, k in enumerate(by)]
    boxes = ranges.select(*own, box.alias("_box"), block).groupBy("_block", *(f"_by{n}" for n in range(len(by)))).agg(F.array_sort(F.collect_list("_box")).alias("_boxes"))
    on = F.floor(cells["row"] / BLOCK) == boxes["_block"]
    for n, k in enumerate(by):
        on &= cells[k].eqNullSafe(boxes[f"_by{n}"])
    joined = cells.join(boxes, on, "left")
    row, col = cells["row"], cells["col"]
    found = F.get(F.filter(boxes["_boxes"], lambda b: row.between(b["row1"], b["row2"]) & col.between(b["col1"], b["col2"])), 0)
    ref = found["ref"]
    return joined.select(*(cells[c] for c in cells.columns), ref.isNotNull().alias("merged"), ref.alias("range"))
