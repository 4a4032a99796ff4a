"""Workbooks: the facade over sources and operators.

A Book is a lazy description of a file, or of many files that are read alike: a sheet then stands for the sheets of that name,
the first sheet for that of each file. Its catalogue (sheets, names) is read once when asked for. Everything else is a
DataFrame; those of many files can carry the file, and headers and row numbers are each file's own.
"""

from __future__ import annotations

import os
from dataclasses import replace
from functools import cached_property
from typing import Any, BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.addressing import Area, range_stats, split_sheet_ref
from ..functions.dates import letters_pattern, locale_codes, spark_pattern
from ..functions.typing_rules import DateMode, typed_cell
from ..operators import extents, merged, styles
from ..operators.grid import Cursor, Grid
from ..sources.ooxml import SheetError
from ..sources.split_text import records_scan, split_records
from ..sources.workbook import ScanOptions, bytes_frame, files_of, is_xls, is_xlsx, scan_part, scan_rows


class Sheet:
    """One sheet: a grid and the metadata relations that belong to it. ref says which it is in each file: its name, or None for
    the first."""

    def __init__(self, book: Book, sheet_id: int, name: str, state: str, dimension: str, path: str, ref: str | None):
        self.book, self.id, self.name, self._state, self.declared, self.path, self.ref = book, sheet_id, name, state, dimension or "", path, ref

    @property
    def active(self) -> bool:
        """Whether the file marks the sheet as the one to show."""
        return bool(self._own("sheets").first()["active"])

    def is_name(self, name: str) -> bool:
        return self.name.lower() == name.lower()

    @property
    def state(self) -> str:
        return self._state

    def set_state(self, state: str) -> Sheet:
        """visible, hidden or veryHidden, from now on in this book; the file stays as it is."""
        self._state = state
        return self

    @property
    def visible(self) -> bool:
        return self.state == "visible"

    @property
    def hidden(self) -> bool:
        return not self.visible

    def _resolve(self, name: str) -> str | None:
        for known, ref in self.book.defined_names.items():
            if known.lower() == name.lower():
                sheet, area = split_sheet_ref(ref)
                if sheet is None or self.is_name(sheet):
                    return area
        return None

    def _options(self) -> ScanOptions:
        return replace(self.book.options, sheet=self.ref, missing_ok=True)

    def grid(self) -> Grid:
        def scan(area: Area, row_limit: int, row_mode: bool) -> DataFrame:
            return scan_rows(self.book.files, replace(self._options(), area=area, row_limit=row_limit, row_mode=row_mode)).drop("sheet_id", "sheet")

        return Grid(scan, dates=self.book.dates, resolve_name=self._resolve)

    def set_read_area(self, text: str, first_row_keys: bool = False) -> Grid:
        return self.grid().set_read_area(text, first_row_keys)

    def from_cell(self, cell: str, first_row_keys: bool = False) -> Grid:
        return self.grid().from_cell(cell, first_row_keys)

    def set_read_area_columns(self, text: str, first_row_keys: bool = False) -> Grid:
        return self.grid().set_read_area_columns(text, first_row_keys)

    def with_header(self, names: list[str] | None = None) -> Grid:
        return self.grid().with_header(names)

    def read_rows(self, *args: Any, **kw: Any) -> DataFrame:
        return self.grid().rows(*args, **kw)

    def read_columns(self, *args: Any, **kw: Any) -> DataFrame:
        return self.grid().columns(*args, **kw)

    def read_cells(self, *args: Any, **kw: Any) -> DataFrame:
        return self.grid().cells(*args, **kw)

    def read_first_row(self, *args: Any, **kw: Any) -> DataFrame:
        return self.grid().first_row(*args, **kw)

    def read_first_row_cells(self) -> DataFrame:
        return self.grid().first_row_cells()

    def read_cells_with_styles(self, key: str | None = None, area: str | None = None) -> DataFrame:
        grid = self.set_read_area(area) if area else self.grid()
        return styles.with_styles(grid.cells(book_name="book"), self.book.styles(), key)

    def read_cell_styles(self, flat: bool = False, part: str | None = None) -> DataFrame:
        return styles.with_styles(self.grid().cells(book_name="book").select("book", "address", "row", "col", "s"), self.book.styles(), None, part, flat)

    def read_rows_with_styles(self, *args: Any, **kw: Any) -> DataFrame:
        return styles.with_styles(self.grid().row_styles(*args, **kw), self.book.styles())

    # The same from a cell on.

    def read_rows_from(self, cell: str, first_row_keys: bool = False, **kw: Any) -> DataFrame:
        return self.from_cell(cell, first_row_keys).rows(**kw)

    def read_columns_from(self, cell: str, first_row_keys: bool = False, **kw: Any) -> DataFrame:
        return self.from_cell(cell, first_row_keys).columns(**({"keys": True} if first_row_keys else {}) | kw)

    def read_cells_from(self, cell: str, **kw: Any) -> DataFrame:
        return self.from_cell(cell).cells(**kw)

    def read_first_row_from(self, cell: str, **kw: Any) -> DataFrame:
        return self.from_cell(cell).first_row(**kw)

    def read_first_row_cells_from(self, cell: str) -> DataFrame:
        return self.from_cell(cell).first_row_cells()

    def read_first_row_with_styles(self, cell: str = "A1") -> DataFrame:
        return styles.with_styles(self.from_cell(cell).first_row_cells(book_name="book"), self.book.styles())

    def read_rows_with_styles_from(self, cell: str, first_row_keys: bool = False, **kw: Any) -> DataFrame:
        return styles.with_styles(self.from_cell(cell, first_row_keys).row_styles(**kw), self.book.styles())

    def read_columns_with_styles(self, cell: str = "A1", **kw: Any) -> DataFrame:
        """The long form, ordered by column then row where it is sorted by the caller: key, row, value and style groups."""
        return self.read_rows_with_styles_from(cell, **kw)

    def read_callback(self, callback, *args: Any, **kw: Any) -> None:
        self.grid().read_callback(callback, *args, **kw)

    def cursor(self, keys: Any = (), mode: int = 0) -> Cursor:
        return self.grid().cursor(keys, mode)

    # Extents

    def dimension(self) -> str:
        """As the file declares it, which may be wrong or missing."""
        return self.declared

    def dimension_stats(self, text: str | None = None) -> dict[str, int]:
        return range_stats(self.declared if text is None else text)

    def actual_dimension(self, by: tuple[str, ...] = ()) -> DataFrame:
        """by=("book",) gives one for each file."""
        return extents.actual_dimension(self.grid().cell_relation(), by)

    def stat(self, by: tuple[str, ...] = ()) -> DataFrame:
        return extents.stat(self.grid().cell_relation(), by)

    # Metadata

    def _own(self, part: str) -> DataFrame:
        return scan_part(self.book.files, part, self._options())

    def merged_cells(self) -> DataFrame:
        return self._own("merged_cells")

    def merged_lookup(self, cells: DataFrame) -> DataFrame:
        """cells (row, col, ..., and book where there are many files) with merged and range."""
        return merged.merged_lookup(cells, self.merged_cells(), ("book",) if "book" in cells.columns else ())

    def is_merged(self, row: int, col: int) -> bool:
        return self.merged_range(row, col) is not None

    def merged_range(self, row: int, col: int) -> str | None:
        found = self.merged_cells().where(F.lit(row).between(F.col("row1"), F.col("row2")) & F.lit(col).between(F.col("col1"), F.col("col2"))).orderBy("position").first()
        return found["ref"] if found else None

    def hyperlinks(self) -> DataFrame:
        return self._own("hyperlinks")

    def data_validations(self) -> DataFrame:
        return self._own("validations")

    def conditional_formatting(self) -> DataFrame:
        return self._own("conditional_formats")

    def column_attributes(self) -> DataFrame:
        return self._own("columns")

    def column_styles(self) -> DataFrame:
        return self._own("columns").join(self.book.styles().withColumnRenamed("s", "style"), ["book", "style"], "left")

    def column_width(self, col: int) -> float | None:
        found = self._own("columns").where(F.col("col") == col).first()
        return found["width"] if found else None

    def row_attributes(self) -> DataFrame:
        return self._own("row_attrs")

    def row_styles(self) -> DataFrame:
        return self._own("row_attrs").join(self.book.styles().withColumnRenamed("s", "style"), ["book", "style"], "left")

    def row_height(self, row: int, default: float | None = None) -> float | None:
        """A row's height; for a row without one of its own the sheet's default, or the default given."""
        found = self._own("row_attrs").where(F.col("row") == row).first()
        if found is None:
            return None
        return default if default is not None and not found["attributes"].get("ht") else found["height"]

    def sheet_view(self) -> DataFrame:
        """Freeze pane and tab colour."""
        return self._own("sheet_view")

    # Images

    def images(self) -> DataFrame:
        return self._own("images")

    def has_images(self) -> bool:
        return not self.images().isEmpty()

    def count_images(self) -> int:
        return self.images().count()

    def images_by_row(self, row: int) -> DataFrame:
        return self.images().where(F.col("row") == row)

    def image(self, row: int, col: int) -> Any:
        """The picture at a cell: name, file_name, mime and content; None if there is none."""
        return self.images().where((F.col("row") == row) & (F.col("col") == col)).first()

    def image_path(self, row: int, col: int) -> str | None:
        """The file and, after a #, the part of the package that holds the picture at a cell."""
        found = self.image(row, col)
        return f"{found['book']}#{found['part']}" if found is not None and found["part"] else None

    def save_image(self, row: int, col: int, path: str) -> bool:
        """Writes the picture at a cell to a file of the driver: a pull of one value. For many pictures read images()."""
        found = self.image(row, col)
        if found is None or found["content"] is None:
            return False
        with open(path, "wb") as f:
            f.write(found["content"])
        return True

    def save_image_to(self, row: int, col: int, folder: str) -> str | None:
        """save_image() under the picture's own file name; the path, or None if there is no picture."""
        found = self.image(row, col)
        if found is None or not found["file_name"]:
            return None
        path = os.path.join(folder, found["file_name"])
        return path if self.save_image(row, col, path) else None


class Book:
    def __init__(self, spark: SparkSession, files: DataFrame, options: ScanOptions = ScanOptions()):
        self.spark, self.files, self.options = spark, files, options
        self.dates = DateMode()
        self._format: str | None = None

    def part(self, name: str) -> DataFrame:
        """A metadata relation, of all sheets."""
        return scan_part(self.files, name, replace(self.options, sheet="*"))

    @cached_property
    def catalog(self) -> list[Sheet]:
        """A Sheet for each name, in order of their places; of many files the first by path tells id, state and dimension."""
        first = F.min_by(F.struct("sheet_id", "sheet", "state", "dimension", "path"), F.struct("book", "position"))
        found = self.part("sheets").groupBy(F.lower("sheet").alias("name")).agg(F.min("position").alias("position"), first.alias("s")).orderBy("position", "name").collect()
        if not found:
            raise SheetError("the book has no sheet")
        return [Sheet(self, *(r["s"][k] for k in ("sheet_id", "sheet", "state", "dimension", "path")), r["s"]["sheet"]) for r in found]

    @cached_property
    def defined_names(self) -> dict[str, str]:
        return {r["name"]: r["ref"] for r in self.part("defined_names").collect()}

    # Navigation

    def sheets(self) -> list[Sheet]:
        return self.catalog

    def visible_sheets(self) -> list[Sheet]:
        return [s for s in self.catalog if s.visible]

    def hidden_sheets(self) -> list[Sheet]:
        return [s for s in self.catalog if s.hidden]

    def sheet_names(self) -> list[str]:
        return [s.name for s in self.catalog]

    def count_sheets(self) -> int:
        return len(self.catalog)

    def sheet(self, name: str | None = None) -> Sheet | None:
        """The sheet of that name, without regard to case; the first one without a name."""
        return self.first_sheet() if name is None else next((s for s in self.catalog if s.is_name(name)), None)

    def sheet_exists(self, name: str) -> bool:
        return self.sheet(name) is not None

    def get_sheet(self, name: str | None = None) -> Sheet:
        found = self.sheet(name)
        if found is None:
            raise SheetError(f"no sheet {name!r}")
        return found

    def sheet_by_id(self, sheet_id: int) -> Sheet:
        found = next((s for s in self.catalog if s.id == sheet_id), None)
        if found is None:
            raise SheetError(f"no sheet with id {sheet_id}")
        return found

    def first_sheet(self) -> Sheet:
        """The first sheet of each file, whatever its name."""
        first = self.catalog[0]
        return Sheet(self, first.id, first.name, first.state, first.declared, first.path, None)

    def set_read_area(self, text: str, first_row_keys: bool = False) -> Grid:
        """A range of the first sheet, or a defined name, on whichever sheet it lies."""
        for known, ref in self.defined_names.items():
            if known.lower() == text.lower():
                sheet, area = split_sheet_ref(ref)
                return self.get_sheet(sheet).set_read_area(area, first_row_keys)
        return self.first_sheet().set_read_area(text, first_row_keys)

    # Reading on the first sheet

    def read_rows(self, *args: Any, **kw: Any) -> DataFrame:
        return self.first_sheet().read_rows(*args, **kw)

    def read_columns(self, *args: Any, **kw: Any) -> DataFrame:
        return self.first_sheet().read_columns(*args, **kw)

    def read_columns_with_styles(self, *args: Any, **kw: Any) -> DataFrame:
        return self.first_sheet().read_columns_with_styles(*args, **kw)

    def read_cells(self, *args: Any, **kw: Any) -> DataFrame:
        return self.first_sheet().read_cells(*args, **kw)

    def read_rows_with_styles(self, *args: Any, **kw: Any) -> DataFrame:
        return self.first_sheet().read_rows_with_styles(*args, **kw)

    def read_cells_with_styles(self, *args: Any, **kw: Any) -> DataFrame:
        return self.first_sheet().read_cells_with_styles(*args, **kw)

    def read_cell_styles(self, *args: Any, **kw: Any) -> DataFrame:
        return self.first_sheet().read_cell_styles(*args, **kw)

    def read_callback(self, callback, *args: Any, **kw: Any) -> None:
        self.first_sheet().read_callback(callback, *args, **kw)

    # Dates

    def set_date_format(self, fmt: str) -> Book:
        """A gmdate-style format for all dates, Y-m-d for example."""
        self._format = fmt
        self.dates = DateMode("pattern", letters_pattern(fmt))
        return self

    def get_date_format(self) -> str | None:
        return self._format

    def date_formatter(self, formatter: Any, locale: str | None = None) -> Book:
        """None: the serial text; False: seconds of numbers only; True: by each cell's own code, then the date format, then
        seconds; text: that format; a function of columns (seconds, code, style): its result."""
        if formatter is None:
            self.dates = DateMode("original")
        elif formatter is False:
            self.dates = DateMode("plain")
        elif formatter is True:
            codes: dict[str, str] = {}
            for r in self.part("style_types").where("category = 'date'").select("code").distinct().collect():
                pattern = spark_pattern(r["code"])
                if pattern:
                    codes[r["code"]] = pattern
            codes |= locale_codes(self.spark, locale) if locale else {}
            self.dates = DateMode("own", letters_pattern(self._format) if self._format else None, codes=codes)
        elif isinstance(formatter, str):
            self.set_date_format(formatter)
        else:
            self.dates = DateMode("function", function=formatter)
        return self

    def use_locale_formats(self, locale: str) -> Book:
        """Builtin date codes as that locale writes them, any that the JVM knows; other codes stay."""
        return self.date_formatter(True, locale)

    # Styles, statistics, metadata

    def styles(self) -> DataFrame:
        """Complete styles: s, format, font, fill, border."""
        return styles.complete_styles(self.part("style_tables"))

    def style_types(self) -> DataFrame:
        return self.part("style_types")

    def cells(self) -> DataFrame:
        """Typed cells of all sheets: sheet, row, col and the value's fields."""
        rows = scan_rows(self.files, replace(self.options, sheet="*"))
        return rows.select("sheet", "row", F.explode(F.transform("cells", lambda c: typed_cell(c, self.dates))).alias("c")).select("sheet", "row", "c.*")

    def stat(self) -> DataFrame:
        return extents.book_stat(self.cells())

    def properties(self) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.part("properties").collect()}

    def images(self) -> DataFrame:
        return self.part("images")

    def count_images(self) -> int:
        return self.images().count()

    def media_files(self) -> DataFrame:
        return self.part("media")

    def extra_images(self) -> DataFrame:
        """Media of the package that no cell shows."""
        return self.part("media").join(self.images().select("book", "part"), ["book", "part"], "left_anti")

    def entries(self) -> DataFrame:
        return self.part("entries")

    def contents(self, entry: str | None = None) -> DataFrame:
        """The files within the package, or the one of that name."""
        found = self.part("contents")
        return found if entry is None else found.where(F.col("entry") == entry)

    def validate(self) -> DataFrame:
        """entry, ok, message for each XML part of the package."""
        return self.part("validate")


def open_book(spark: SparkSession, path: str, **options: Any) -> Book:
    """A workbook or delimited file; what it is follows from its first bytes. Options are those of ScanOptions."""
    return Book(spark, files_of(spark, path), ScanOptions(**options))


def open_bytes(spark: SparkSession, content: bytes, **options: Any) -> Book:
    if not content:
        raise SheetError("the file is empty")
    return Book(spark, bytes_frame(spark, {"bytes": content}), ScanOptions(**options))


def open_stream(spark: SparkSession, stream: BinaryIO, **options: Any) -> Book:
    """From where the stream stands; the caller keeps it."""
    return open_bytes(spark, stream.read(), **options)


def open_xls(spark: SparkSession, path: str) -> Book:
    return open_book(spark, path, kind="xls")


def open_csv(spark: SparkSession, path: str, **csv: Any) -> Book:
    return open_book(spark, path, kind="csv", csv=csv)


def split_csv(spark: SparkSession, path: str, **csv: Any) -> Grid:
    """Delimited files of any size as a grid: files are cut into splits, where open_csv reads each file in one task."""
    return Grid(records_scan(split_records(spark, path, csv)))


def file_kinds(files: DataFrame) -> DataFrame:
    """files (path, content) with is_xls and is_xlsx, by signature."""
    return files.withColumn("is_xls", F.coalesce(F.substring("content", 1, 8) == F.unhex(F.lit("D0CF11E0A1B11AE1")), F.lit(False))).withColumn("is_xlsx", F.coalesce(F.substring("content", 1, 4) == F.unhex(F.lit("504B0304")), F.lit(False)))


__all__ = ["Book", "Sheet", "file_kinds", "is_xls", "is_xlsx", "open_book", "open_bytes", "open_csv", "open_stream", "open_xls", "split_csv"]
