"""Workbooks that arrive in a folder, as a stream of cells: an extension, for the batch engine knows no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.typing_rules import typed_cell
from ..sources.workbook import ScanOptions, scan_rows

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def stream_cells(spark: SparkSession, folder: str, options: ScanOptions = ScanOptions(), files_per_trigger: int = 64) -> DataFrame:
    """A streaming relation (book, sheet, row, and a typed cell's fields) of the files that come into folder; each file is
    read once, so a file must be moved in whole."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    rows = scan_rows(files.select("path", "content"), options)
    return rows.select("book", "sheet", "row", F.explode(F.transform("cells", lambda c: typed_cell(c))).alias("c")).select("book", "sheet", "row", "c.*")


def stream_stat(cells: DataFrame) -> DataFrame:
    """Running counts for each book and sheet."""
    return cells.groupBy("book", "sheet").agg(F.count("*").alias("cells_total"), F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.min("col").alias("min_col"), F.max("col").alias("max_col"))
