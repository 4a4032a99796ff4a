"""Workbooks as Spark sources.

scan_rows() and scan_part() read files through Spark's binaryFile source, so any store that Spark reads will do, and parse
them in Arrow batches on the executors, a file per row; sheet, area and row limit go into the scan, where cells outside are
never decoded. spark.read.format("workbook") (see register()) gives the same cells through the Python Data Source API, one
partition per file and sheet. A sheet is one deflated stream of at most 1,048,576 rows, so files and sheets are the unit of
parallelism.
"""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions.addressing import Area, parse_area
from ..functions.typing_rules import RAW_CELL
from .biff import XlsBook
from .delimited import DelimitedBook
from .ole import MAGIC as OLE_MAGIC
from .ooxml import SheetError, XlsxBook

ZIP_MAGIC = b"PK\x03\x04"


def is_xls(head: bytes) -> bool:
    return head.startswith(OLE_MAGIC)


def is_xlsx(head: bytes) -> bool:
    return head.startswith(ZIP_MAGIC)


@dataclass(frozen=True)
class ScanOptions:
    """What a scan reads. kind: auto (by the first bytes, never by the name), xlsx, xls or csv. sheet: a name, without regard
    to case, an id, None for the first, or * for all; a file without it is an error, or gives nothing if missing_ok."""

    kind: str = "auto"
    sheet: str | int | None = None
    area: Area = Area()
    row_limit: int = 0
    row_mode: bool = False
    prefixed: bool = False
    csv: dict[str, Any] = field(default_factory=dict)
    missing_ok: bool = False


def open_content(content: bytes, options: ScanOptions = ScanOptions()):
    """A file's book, by kind."""
    if not content:
        raise SheetError("the file is empty")
    kind = options.kind
    if kind == "auto":
        kind = "xls" if is_xls(content[:8]) else "xlsx" if is_xlsx(content[:4]) else "csv"
    if kind == "xls":
        return XlsBook(content)
    if kind == "xlsx":
        return XlsxBook(content, options.prefixed)
    return DelimitedBook(content, options.csv)


def chosen_sheets(book, sheet: str | int | None, missing_ok: bool = False) -> list:
    if sheet == "*":
        return list(book.sheets)
    if sheet is None:
        return book.sheets[:1]
    if isinstance(sheet, int):
        found = [s for s in book.sheets if s.id == sheet]
    else:
        found = [s for s in book.sheets if s.name.lower() == sheet.lower()][:1]
    if not found and not missing_ok:
        raise SheetError(f"no sheet {sheet!r}")
    return found


#: A row of a sheet. first_row and first_col are the number of the first row that the scan gives of the sheet and its first
#: column (null without cells), head a hash of that row's cells: what a plan needs to know of each file's header.
ROWS = f"book string, sheet_id int, sheet string, row int, first_row int, first_col int, head long, attrs map<string,string>, cells array<{RAW_CELL}>"
_CELL_NAMES = ("col", "t", "s", "raw", "f", "text", "fmt", "code", "base1904")
_BATCH_CELLS = 20_000


def _row_batches(path: str, book, options: ScanOptions, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """ROWS in batches, put together column by column."""
    cell_type = schema.field("cells").type.value_type
    for sheet in chosen_sheets(book, options.sheet, options.missing_ok):
        held: list[tuple[int, dict[str, str], list[dict[str, Any]]]] = []
        first: tuple[int, int | None, int] | None = None

        def give() -> pa.RecordBatch:
            flat = [c for _, _, cells in held for c in cells]
            fields = [pa.array([c[k] for c in flat], cell_type.field(k).type) for k in _CELL_NAMES]
            ends = list(accumulate((len(cells) for _, _, cells in held), initial=0))
            n = len(held)
            columns = {
                "book": pa.array([path] * n, pa.string()),
                "sheet_id": pa.array([sheet.id] * n, pa.int32()),
                "sheet": pa.array([sheet.name] * n, pa.string()),
                "row": pa.array([row for row, _, _ in held], pa.int32()),
                "first_row": pa.array([first[0]] * n, pa.int32()),
                "first_col": pa.array([first[1]] * n, pa.int32()),
                "head": pa.array([first[2]] * n, pa.int64()),
                "attrs": pa.array([list(attrs.items()) for _, attrs, _ in held], schema.field("attrs").type),
                "cells": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=[cell_type.field(k) for k in _CELL_NAMES])),
            }
            return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        size = 0
        for row, attrs, cells in sheet.rows(options.area, options.row_limit, options.row_mode):
            if first is None:
                of = repr([(c["col"], c["t"], c["raw"], c["f"], c["text"], c["fmt"]) for c in cells]).encode("utf-8", "surrogatepass")
                first = row, min((c["col"] for c in cells), default=None), int.from_bytes(hashlib.blake2b(of, digest_size=8).digest(), "little", signed=True)
            held.append((row, attrs, cells))
            size += len(cells) + 1
            if size >= _BATCH_CELLS:
                yield give()
                held, size = [], 0
        if held:
            yield give()


#: Metadata relations: their columns after book, and what gives them, of a book and the sheets asked for. A format that lacks
#: one gives no rows.
PARTS: dict[str, tuple[str, Callable[[Any, list], Iterable[dict[str, Any]]]]] = {}


def _part(name: str, schema: str):
    def add(fn):
        PARTS[name] = (schema, fn)
        return fn

    return add


def _per_sheet(sheets: list, method: str) -> Iterator[tuple[Any, Any]]:
    for s in sheets:
        if (found := getattr(s, method, None)) is not None:
            yield s, found() if callable(found) else found


@_part("sheets", "sheet_id int, sheet string, position int, state string, path string, dimension string, active boolean")
def _sheets(book, sheets):
    for k, s in enumerate(book.sheets):
        if s not in sheets:
            continue
        yield {"sheet_id": s.id, "sheet": s.name, "position": k, "state": s.state, "path": s.path, "dimension": getattr(s, "dimension", ""), "active": bool(getattr(s, "active", k == 0))}


@_part("defined_names", "name string, ref string")
def _names(book, sheets):
    return ({"name": k, "ref": v} for k, v in book.defined_names.items())


@_part("properties", "key string, value string")
def _properties(book, sheets):
    return ({"key": k, "value": v} for k, v in (book.properties() if hasattr(book, "properties") else {}).items())


@_part("merged_cells", "sheet_id int, sheet string, ref string, row1 int, col1 int, row2 int, col2 int, position int")
def _merged(book, sheets):
    from ..functions.addressing import parse_box

    for s, refs in _per_sheet(sheets, "merged_cells"):
        for k, ref in enumerate(refs):
            box = parse_box(ref)
            if box:
                yield {"sheet_id": s.id, "sheet": s.name, "ref": ref, "row1": box.row1, "col1": box.col1, "row2": box.row2, "col2": box.col2, "position": k}


@_part("hyperlinks", "sheet_id int, sheet string, ref string, link string, location string, display string, tooltip string")
def _hyperlinks(book, sheets):
    return ({"sheet_id": s.id, "sheet": s.name, **h} for s, found in _per_sheet(sheets, "hyperlinks") for h in found)


@_part("validations", "sheet_id int, sheet string, type string, sqref string, formula1 string, formula2 string")
def _validations(book, sheets):
    return ({"sheet_id": s.id, "sheet": s.name, **v} for s, found in _per_sheet(sheets, "validations") for v in found)


@_part("conditional_formats", "sheet_id int, sheet string, type string, sqref string, attributes map<string,string>")
def _conditional(book, sheets):
    return ({"sheet_id": s.id, "sheet": s.name, **c, "attributes": list(c["attributes"].items())} for s, found in _per_sheet(sheets, "conditional_formats") for c in found)


@_part("columns", "sheet_id int, sheet string, col int, width double, style int, attributes map<string,string>")
def _columns(book, sheets):
    return ({"sheet_id": s.id, "sheet": s.name, **c, "attributes": list(c["attributes"].items())} for s, found in _per_sheet(sheets, "columns") for c in found)


@_part("row_attrs", "sheet_id int, sheet string, row int, height double, style int, attributes map<string,string>")
def _row_attrs(book, sheets):
    for s in sheets:
        if s.kind == "csv":
            continue
        default = getattr(s, "default_height", 15.0)
        for row, attrs, _ in s.rows(Area(), 0, True):
            yield {"sheet_id": s.id, "sheet": s.name, "row": row, "height": float(attrs["ht"]) if attrs.get("ht") else default, "style": int(attrs.get("s") or 0), "attributes": list(attrs.items())}


@_part("sheet_view", "sheet_id int, sheet string, x_split int, y_split int, top_left string, tab_rgb string, tab_theme int, tab_tint double, default_height double")
def _view(book, sheets):
    for s in sheets:
        if not hasattr(s, "freeze_pane"):
            continue
        pane, tab = s.freeze_pane() or {}, s.tab_color() or {}
        yield {"sheet_id": s.id, "sheet": s.name, **{k: pane.get(k) for k in ("x_split", "y_split", "top_left")}, "tab_rgb": tab.get("rgb"), "tab_theme": int(tab["theme"]) if "theme" in tab else None, "tab_tint": float(tab["tint"]) if "tint" in tab else None, "default_height": s.default_height}


@_part("images", "sheet_id int, sheet string, row int, col int, name string, file_name string, part string, mime string, content binary")
def _images(book, sheets):
    return ({"sheet_id": s.id, "sheet": s.name, **i} for s, found in _per_sheet(sheets, "images") for i in found)


@_part("media", "part string")
def _media(book, sheets):
    return ({"part": m} for m in (book.media() if hasattr(book, "media") else ()))


@_part("entries", "entry string, size bigint")
def _entries(book, sheets):
    return book.entries() if hasattr(book, "entries") else ()


@_part("contents", "entry string, content binary")
def _contents(book, sheets):
    """The files within a package, as they are: what no other relation covers can be read from here."""
    return ({"entry": n, "content": book.open(n).read()} for n in book.names) if book.kind == "xlsx" else ()


@_part("validate", "entry string, ok boolean, message string")
def _validate(book, sheets):
    return book.validate() if hasattr(book, "validate") else ()


@_part("style_types", "s int, category string, code string")
def _style_types(book, sheets):
    return ({"s": k, "category": kind, "code": code} for k, (kind, code) in enumerate(getattr(book, "style_types", ())))


@_part("style_tables", "kind string, idx int, num_fmt int, font int, fill int, border int, xf int, own map<string,string>")
def _style_tables(book, sheets):
    """One relation of all style tables: formats, fonts, fills and borders as maps, xf records with their ids."""
    for kind, rows in (book.style_tables() if hasattr(book, "style_tables") else {}).items():
        for k, row in enumerate(rows):
            ids = {n: row.get(i) for n, i in (("num_fmt", "numFmtId"), ("font", "fontId"), ("fill", "fillId"), ("border", "borderId"), ("xf", "xfId"))}
            own = row.get("align", {}) if "numFmtId" in row else row
            yield {"kind": kind, "idx": int(row.get("format-num-id", k)), **ids, "own": [(a, str(b)) for a, b in own.items() if b is not None]}


@_part("records", "row int, fields array<string>, errors array<struct<code:int,message:string,record:int,column:int>>")
def _records(book, sheets):
    """Records of delimited text as the low-level engine numbers them, with the errors of each instead of a failure."""
    from .delimited import DelimitedReader

    if book.kind != "csv":
        return
    found: list[Any] = []
    reader = DelimitedReader(book.reader.stream, book.reader.options, found.append)
    for number, fields in reader.records():
        yield {"row": number, "fields": fields, "errors": [{"code": e.code, "message": str(e), "record": e.record, "column": e.column} for e in found]}
        found.clear()


def _batches(rows: Iterable[dict[str, Any]], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    held: list[dict[str, Any]] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _scan(files: DataFrame, schema: str, give: Callable[[str, bytes, pa.Schema], Iterable[pa.RecordBatch]]) -> DataFrame:
    kind: StructType = _parse_datatype_string(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                yield from give(path.as_py(), content.as_py(), arrow)

    return files.select("path", "content").mapInArrow(run, kind)


def files_of(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, content) of the files."""
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def scan_rows(files: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """files (path string, content binary) to ROWS: a row of a sheet with its cells as raw structs, in order of column."""
    return _scan(files, ROWS, lambda path, content, schema: _row_batches(path, open_content(content, options), options, schema))


def scan_part(files: DataFrame, part: str, options: ScanOptions = ScanOptions()) -> DataFrame:
    """files to a metadata relation: book and the columns of PARTS[part], of the sheets that options.sheet names."""
    schema, fn = PARTS[part]

    def give(path: str, content: bytes, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        book = open_content(content, options)
        return _batches(({"book": path, **r} for r in fn(book, chosen_sheets(book, options.sheet, options.missing_ok))), arrow)

    return _scan(files, "book string, " + schema, give)


# The Python Data Source

CELLS = "book string, sheet_id int, sheet string, row int, col int, t string, s int, raw string, f string, text string, fmt string, code string, base1904 boolean"


@dataclass
class _Piece(InputPartition):
    path: str
    sheet_id: int | None


def _expand(path: str) -> list[str]:
    import glob
    import os

    from pyarrow import fs

    if "://" in path:
        store, base = fs.FileSystem.from_uri(path)
        info = store.get_file_info(base)
        scheme = path.split("://")[0]
        if info.type == fs.FileType.Directory:
            return sorted(f"{scheme}://{f.path}" for f in store.get_file_info(fs.FileSelector(base)) if f.is_file)
        return [path]
    if os.path.isdir(path):
        return sorted(p for p in glob.glob(os.path.join(path, "*")) if os.path.isfile(p))
    return sorted(glob.glob(path)) or [path]


def _read_file(path: str) -> bytes:
    from pyarrow import fs

    if "://" in path:
        store, base = fs.FileSystem.from_uri(path)
        with store.open_input_file(base) as f:
            return f.read()
    with open(path, "rb") as f:
        return f.read()


class _Reader(DataSourceReader):
    def __init__(self, given: dict[str, str], schema: StructType):
        self.schema = schema
        self.paths = [p for given_path in json.loads(given["path"]) for p in _expand(given_path)] if given.get("path", "").startswith("[") else _expand(given.get("path", ""))
        sheet: str | int | None = given.get("sheet")
        self.part = given.get("part", "cells")
        self.options = ScanOptions(
            given.get("kind", "auto"),
            int(sheet) if sheet and sheet.isdigit() else sheet,
            parse_area(given["area"]) if given.get("area") else Area(),
            int(given.get("rowlimit", 0)),
            False,
            given.get("prefixed", "false").lower() == "true",
            {k.removeprefix("csv."): v for k, v in given.items() if k.startswith("csv.")},
        )

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            if self.part != "cells":
                out.append(_Piece(path, None))
            else:
                out += [_Piece(path, s.id) for s in chosen_sheets(open_content(_read_file(path), self.options), self.options.sheet)]
        return out

    def read(self, partition: _Piece) -> Iterator[pa.RecordBatch]:
        book = open_content(_read_file(partition.path), self.options)
        if self.part != "cells":
            rows = ({"book": partition.path, **r} for r in PARTS[self.part][1](book, list(book.sheets)))
        else:
            sheet = next(s for s in book.sheets if s.id == partition.sheet_id)
            rows = (
                {"book": partition.path, "sheet_id": sheet.id, "sheet": sheet.name, "row": row, **{k: c[k] for k in _CELL_NAMES}}
                for row, _, cells in sheet.rows(self.options.area, self.options.row_limit)
                for c in cells
            )
        yield from _batches(rows, to_arrow_schema(self.schema))


class WorkbookSource(DataSource):
    """format("workbook"): options path, kind, sheet (name, id or *), area, part (cells or a name of PARTS), rowLimit, prefixed,
    and csv.delimiter and the like."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        part = self.options.get("part", "cells")
        return CELLS if part == "cells" else "book string, " + PARTS[part][0]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in dict(self.options).items()}, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)


def engine_rows(files: DataFrame, csv: dict[str, Any] | None = None, keys: Any = None, mode: int = 0, from_row: int = 1, from_col: int = 1, header: list[str] | bool = False, limit: int = 0) -> DataFrame:
    """(book, row, cells map<string,string>): rows of delimited text the way the low-level engine keys them, columns from 0
    and rows by record number, or as mode says."""
    from .delimited import DelimitedReader

    def give(path: str, content: bytes, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        reader = DelimitedReader(content, csv).from_row(from_row).from_col(from_col)
        if header:
            reader.with_header(header if isinstance(header, list) else None)
        yield from _batches(({"book": path, "row": row, "cells": [(str(k), v) for k, v in cells.items()]} for row, cells in reader.rows(keys, mode, limit)), arrow)

    return _scan(files, "book string, row int, cells map<string,string>", give)


def bytes_frame(spark: SparkSession, named: dict[str, bytes]) -> DataFrame:
    """(path, content) of contents at hand, such as a stream that has been read."""
    return spark.createDataFrame([(k, bytearray(v)) for k, v in named.items()], "path string, content binary").coalesce(max(1, len(named)))


def read_stream(stream: io.RawIOBase) -> bytes:
    """A stream's bytes from where it stands; the caller keeps it."""
    return stream.read()
