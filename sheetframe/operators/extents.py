"""Extents and counts: the aggregations over cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addressing import col_letter_expr


def _filled() -> Column:
    return F.coalesce(F.col("i").cast("string"), F.col("d").cast("string"), F.col("b").cast("string"), F.col("x")).isNotNull()


def _extent() -> list[Column]:
    least_row, most_row, least_col, most_col = F.min("row"), F.max("row"), F.min("col"), F.max("col")
    return [
        least_row.alias("min_row"),
        most_row.alias("max_row"),
        F.coalesce(most_row - least_row + 1, F.lit(0)).alias("count_rows"),
        least_col.alias("min_col"),
        most_col.alias("max_col"),
        F.coalesce(most_col - least_col + 1, F.lit(0)).alias("count_columns"),
    ]


def actual_dimension(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """min_row, max_row, count_rows, min_col, max_col, count_columns and dimension (A1:C3) of the cells that are there, for each
    value of the columns `by`; without such columns, a sheet that has no cell has counts of 0 and no dimension."""
    found = cells.groupBy(*by).agg(*_extent())
    first = F.concat(col_letter_expr(F.col("min_col")), F.col("min_row").cast("string"))
    last = F.concat(col_letter_expr(F.col("max_col")), F.col("max_row").cast("string"))
    return found.withColumn("dimension", F.when(first == last, first).otherwise(F.concat_ws(":", first, last)))


def stat(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The extent with cells_total and cells_filled (those whose value isn't null), for each value of the columns `by`."""
    return cells.groupBy(*by).agg(*_extent(), F.count("*").alias("cells_total"), F.count(F.when(_filled(), 1)).alias("cells_filled"))


def book_stat(cells: DataFrame) -> DataFrame:
    """stat for each sheet and, with sheet null, for all sheets together. cells has sheet besides."""
    return cells.rollup("sheet").agg(*_extent(), F.count("*").alias("cells_total"), F.count(F.when(_filled(), 1)).alias("cells_filled"))
