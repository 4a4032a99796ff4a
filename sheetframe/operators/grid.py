"""The grid algebra.

A Grid is an immutable view of a sheet, or of the sheets of that place or name in each file of a book: a scan, an area, header
and string options. Its verbs compile to DataFrames over one row per sheet row with an array of typed cells, so selecting,
renaming and typing columns never shuffles; only verbs that turn the grid (columns) or count over it (extents) aggregate. What a
plan must know beforehand, header names, columns in use and their kinds, comes from one aggregation over the scan, or from the
first row of each file where that will do. Headers and row offsets are those of a row's own file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from itertools import accumulate
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addressing import MAX_ROW, Area, address_expr, col_letter, col_letter_expr, col_number, parse_area
from ..functions.typing_rules import CASTS, DateMode, as_string, trim_expr, typed_cell

KEYS_ORIGINAL, KEYS_FIRST_ROW = 0, 1
KEYS_ROW_ZERO_BASED, KEYS_COL_ZERO_BASED, KEYS_ZERO_BASED = 2, 4, 6
KEYS_ROW_ONE_BASED, KEYS_COL_ONE_BASED, KEYS_ONE_BASED = 8, 16, 24
KEYS_RELATIVE, KEYS_SWAP = 32, 64
RESULT_MODE_ROW, TRIM_STRINGS, TREAT_EMPTY_STRING_AS_EMPTY_CELL = 1024, 2048, 4096

#: scan(area, row limit, row mode) to (book, row, first_row, first_col, head, attrs, cells), see workbook.ROWS.
Scan = Callable[[Area, int, bool], DataFrame]
Keys = dict[str, str] | list | bool | None


def value_of(cell: Any) -> Any:
    """A typed cell as a Python value."""
    if cell is None:
        return None
    return next((v for v in (cell["i"], cell["d"], cell["b"], cell["x"]) if v is not None), None)


@dataclass(frozen=True)
class Layout:
    """What is settled when a plan is made: for each kind of first row (one, None, without a header) the columns in order with
    their keys, the kinds of their values where they were asked for, and how rows are numbered. Columns are numbers on the
    sheet, or counted from the first row's first one (relative)."""

    columns: dict[int | None, list[tuple[int, Any]]]
    kinds: dict[tuple[int | None, int], str]
    header: bool
    relative: bool
    renumbered: int | None

    def of(self, head: int) -> list[tuple[int, Any]]:
        return self.columns.get(head) or self.columns.get(None) or []

    def row_key(self) -> Column:
        return F.col("row") if self.renumbered is None else F.col("row") - F.col("first_row") + (self.renumbered - int(self.header))

    def sources(self) -> dict[str, list[tuple[int | None, int]]]:
        """For each key, by its text, the columns that have it."""
        out: dict[str, list[tuple[int | None, int]]] = {}
        for head, columns in self.columns.items():
            for col, key in columns:
                out.setdefault(str(key), []).append((head, col))
        return out

    def cell(self, head: int | None, col: int) -> Column:
        at = F.col("first_col") + (col - 1) if self.relative else F.lit(col)
        found = F.get(F.filter("cells", lambda c: c["col"] == at), 0)
        return found if len(self.columns) == 1 else F.when(F.col("head") == head, found)

    def key_map(self) -> Column:
        """The key of a cell, as text, by the struct (head, column); head is null where there is one layout only."""
        entries = [(head if len(self.columns) > 1 else None, col, str(key)) for head, columns in self.columns.items() for col, key in columns]
        if not entries:
            return F.create_map().cast("map<struct<head:bigint,col:int>,string>")
        return F.map_from_entries(F.array(*(F.struct(F.struct(F.lit(h).cast("long").alias("head"), F.lit(c).cast("int").alias("col")), F.lit(k)) for h, c, k in entries)))

    def key_of(self, col: Column) -> Column:
        head = F.col("head") if len(self.columns) > 1 else F.lit(None)
        at = col - F.col("first_col") + 1 if self.relative else col
        return F.element_at(self.key_map(), F.struct(head.cast("long").alias("head"), at.cast("int").alias("col")))


@dataclass(frozen=True)
class Grid:
    scan: Scan
    area: Area = Area()
    first_row_keys: bool = False
    header_names: tuple[str, ...] = ()
    row_limit: int = 0
    dates: DateMode = field(default_factory=DateMode)
    resolve_name: Callable[[str], str | None] = lambda name: None

    # Selection

    def set_read_area(self, text: str, first_row_keys: bool = False) -> Grid:
        """A range, or a defined name that resolves to one on this sheet."""
        return replace(self, area=parse_area(self.resolve_name(text) or text), first_row_keys=first_row_keys)

    def from_cell(self, cell: str, first_row_keys: bool = False) -> Grid:
        if ":" in cell:
            raise ValueError(f"Wrong address or range: {cell}")
        return self.set_read_area(cell, first_row_keys)

    def set_read_area_columns(self, text: str, first_row_keys: bool = False) -> Grid:
        area = parse_area(text)
        return replace(self, area=replace(area, row_min=1, row_max=MAX_ROW), first_row_keys=first_row_keys)

    def with_header(self, names: list[str] | None = None) -> Grid:
        """The first row of the area is the header; names take the place of its names by position. A short list leaves the
        other names as they are, a long one is cut."""
        return replace(self, first_row_keys=True, header_names=tuple(names or ()))

    def limit(self, rows: int) -> Grid:
        """At most so many raw rows, the header among them."""
        return replace(self, row_limit=rows)

    def with_dates(self, dates: DateMode) -> Grid:
        return replace(self, dates=dates)

    # Relations

    def typed_rows(self, mode: int = 0, filled: bool = False) -> DataFrame:
        """(book, row, first_row, first_col, head, attrs, cells array of typed cells) of the area; rows without cells in row
        mode only, and not if only filled ones are asked for, which are told apart before cells are typed."""
        row_mode = bool(mode & RESULT_MODE_ROW)
        raw = self.scan(self.area, self.row_limit, row_mode)
        if filled:
            raw = raw.where(F.size("cells") > 0)
        cells = F.transform("cells", lambda c: typed_cell(c, self.dates))
        if mode & TRIM_STRINGS:
            cells = F.transform(cells, lambda c: c.withField("x", trim_expr(c["x"])))
        if mode & TREAT_EMPTY_STRING_AS_EMPTY_CELL:
            cells = F.filter(cells, lambda c: F.coalesce(c["x"] != "", F.lit(True)))
        typed = raw.select("book", "row", "first_row", "first_col", "head", "attrs", cells.alias("cells"))
        return typed.where(F.size("cells") > 0) if filled and mode & TREAT_EMPTY_STRING_AS_EMPTY_CELL else typed

    def cell_relation(self, mode: int = 0) -> DataFrame:
        """One row per cell that is there: book, row, col and the typed cell's fields."""
        return self.typed_rows(mode).select("book", "row", F.explode("cells").alias("c")).select("book", "row", "c.*")

    # Plan-time knowledge

    def _header_wanted(self, keys: Keys, mode: int) -> bool:
        """A map of keys counts the header by the mode alone; True and False settle it; an empty one leaves it to mode, then
        area."""
        if isinstance(keys, dict) and keys:
            return bool(mode & KEYS_FIRST_ROW)
        if keys is None or isinstance(keys, bool):
            return bool(keys)
        return bool(mode & KEYS_FIRST_ROW) or self.first_row_keys

    def _known(self, mode: int) -> list[int]:
        """The columns that every row of the scan has, of a scan that says so: a table's."""
        known = getattr(self.scan, "columns", None)
        return known(self.area) if known and not mode & TREAT_EMPTY_STRING_AS_EMPTY_CELL else []

    def _survey(self, mode: int, header: bool, relative: bool, kinds: bool) -> list[Any]:
        """For each kind of first row (head; null without a header) and column that has a cell: the header's cell, and whether
        all values beneath are booleans, dates, whole numbers, numbers. One aggregation over one scan, which gives a row per
        distinct header and column; nothing is read for a bounded area without header, and a row per file with one."""
        if (self.area.bounded or self._known(mode)) and not kinds:
            if not header:
                return []
            rows = replace(self, row_limit=1).typed_rows(mode)
        else:
            rows = self.typed_rows(mode)
        first, c = F.col("row") == F.col("first_row"), F.col("c")
        col = c["col"] - F.col("first_col") + 1 if relative else c["col"]
        filled = F.coalesce(c["i"], c["d"]).isNotNull() | c["b"].isNotNull() | c["x"].isNotNull()
        body = filled & ~first if header else filled
        every = lambda x: F.every(F.when(body, x))
        cells = rows.select("row", "first_row", "first_col", "head", F.explode("cells").alias("c"))
        return cells.groupBy((F.col("head") if header else F.lit(None).cast("long")).alias("head"), col.alias("col")).agg(
            F.first(F.when(first, c), ignorenulls=True).alias("name"),
            every(c["b"].isNotNull()).alias("boolean"),
            every((c["t"] == "date") & c["i"].isNotNull()).alias("timestamp"),
            every(c["i"].isNotNull()).alias("long"),
            every(c["i"].isNotNull() | c["d"].isNotNull()).alias("double"),
        ).collect()

    def layout(self, keys: Keys = (), mode: int = 0, kinds: bool = False) -> Layout:
        header, given = self._header_wanted(keys, mode), {}
        if isinstance(keys, dict):
            given = {col_number(k): v for k, v in keys.items()}
        numeric = bool(mode & (KEYS_COL_ZERO_BASED | KEYS_COL_ONE_BASED))
        relative = numeric and not self.area.bounded and not header and not given
        found, known = self._survey(mode, header, relative, kinds), self._known(mode)
        known = [c - known[0] + 1 for c in known] if relative else known
        columns: dict[int | None, list[tuple[int, Any]]] = {}
        for head in sorted({r["head"] for r in found}, key=lambda h: (h is not None, h)) or [None]:
            own = {r["col"]: r for r in found if r["head"] == head}
            cols = self.area.columns or known or sorted(own)
            names: dict[int, Any] = {}
            if header:
                names = {k: value_of(r["name"]) for k, r in own.items() if r["name"] is not None}
                if not isinstance(keys, dict) or not keys:
                    names |= dict(zip(cols, self.header_names, strict=False))
            names = {c: n for c, n in (names | given).items() if n is not None}
            first_cols = [k for k, r in own.items() if r["name"] is not None]
            start = 1 if relative else self.area.col_min if self.area.bounded else min(first_cols, default=(known or [1])[0])
            shift = start if mode & KEYS_COL_ZERO_BASED else start - 1
            columns[head] = [(c, names[c] if c in names else c - shift if numeric else col_letter(c)) for c in cols]
        best = {(r["head"], r["col"]): next((k for k in ("boolean", "timestamp", "long", "double") if r[k]), "string") for r in found if r["long"] is not None}
        renumbered = 0 if mode & KEYS_ROW_ZERO_BASED else 1 if mode & KEYS_ROW_ONE_BASED else None
        return Layout(columns, best, header, relative, renumbered)

    # Verbs

    def rows(self, keys: Keys = (), mode: int = 0, types: dict[Any, str] | str | None = None, row_name: str = "row", book_name: str | None = None) -> DataFrame:
        """A column for the row key and one for each column key, null where a row has no cell; with book_name, one for the
        file. Values are text unless types names a cast (string, long, double, boolean, timestamp) for all or for some keys, or
        "infer" asks for the narrowest that every cell of a column has. Of columns with one key the last that has a value
        counts; files with other headers have their own columns under the same names. With KEYS_SWAP the grid is turned, see
        columns()."""
        if mode & KEYS_SWAP:
            return self.columns(keys, mode & ~KEYS_SWAP, book_name)
        layout = self.layout(keys, mode, types == "infer")
        sources = layout.sources()
        if types == "infer":
            types = {}
            for key, cols in sources.items():
                seen = {layout.kinds[s] for s in cols if s in layout.kinds}
                types[key] = seen.pop() if len(seen) == 1 else "double" if seen == {"long", "double"} else "string"
        elif isinstance(types, str):
            types = dict.fromkeys(sources, types)
        casts = {str(k): v for k, v in (types or {}).items()}
        taken = {k.lower() for k in sources}
        out = []
        for name, value in ((book_name, F.col("book")), (row_name, layout.row_key())):
            while name and name.lower() in taken:
                name = "_" + name
            out += [value.alias(name)] if name else []
        held = {at: f"_c{n}" for n, at in enumerate(dict.fromkeys(at for cols in sources.values() for at in cols))}
        for key, cols in sources.items():
            cast = CASTS[casts.get(key, "string")]
            found = [cast(F.col(held[at])) for at in reversed(cols)]
            out.append((found[0] if len(found) == 1 else F.coalesce(*found)).alias(key))
        if mode & RESULT_MODE_ROW:
            out.append(F.col("attrs").alias("__row"))
        # A cell is looked up in a step of its own, as casts name it several times.
        found_cells = self._body(layout, mode).select("book", "row", "first_row", "attrs", *(layout.cell(*at).alias(n) for at, n in held.items()))
        return found_cells.select(*out)

    def _body(self, layout: Layout, mode: int) -> DataFrame:
        rows = self.typed_rows(mode, not mode & RESULT_MODE_ROW)
        return rows.where(F.col("row") != F.col("first_row")) if layout.header else rows

    def long_rows(self, keys: Keys = (), mode: int = 0) -> DataFrame:
        """(book, row, col, value): the grid's cells by row key and column key, a row each, cells of other columns left out.
        What turned columns are made of, and of any size."""
        return self._long(keys, mode).select("book", F.col("at").alias("row"), "col", as_string(F.col("c")).alias("value"))

    def _long(self, keys: Keys, mode: int) -> DataFrame:
        layout = self.layout(keys, mode)
        cells = self._body(layout, mode).select("book", layout.row_key().alias("at"), "first_col", "head", F.explode("cells").alias("c"))
        return cells.select("book", "at", layout.key_of(F.col("c")["col"]).alias("col"), "c").where("col is not null")

    def columns(self, keys: Keys = None, mode: int = 0, book_name: str | None = None) -> DataFrame:
        """The grid turned: for each file a row per column key with its values by row key, col string, values
        array<struct<row, value>>; with book_name, the file too. Values stay with their row, whatever columns other rows have.
        A column of one sheet is one value, so 1,048,576 entries are its bound; long_rows() has none."""
        item = F.struct(F.col("row"), F.col("value"))
        turned = self.long_rows(keys, mode).groupBy("book", "col").agg(F.array_sort(F.collect_list(item)).alias("values"))
        return turned.select(*([F.col("book").alias(book_name)] if book_name else []), "col", "values")

    def cells(self, mode: int = 0, book_name: str | None = None) -> DataFrame:
        """(address, row, col, t, i, d, b, x, o, s, f, value), with book_name the file before them. An area with a right bound
        gives its absent cells too, as nulls, for every row that has a cell."""
        rows = self.typed_rows(mode, True)
        if self.area.bounded:
            at = F.explode(F.sequence(F.lit(self.area.col_min), F.lit(self.area.col_max))).alias("at")
            rows = rows.select("book", "row", "cells", at)
            found = rows.select("book", "row", "at", F.get(F.filter("cells", lambda c: c["col"] == F.col("at")), 0).alias("c"))
        else:
            found = rows.select("book", "row", F.explode("cells").alias("c")).select("book", "row", F.col("c.col").alias("at"), "c")
        fields = [F.col(f"c.{k}").alias(k) for k in ("t", "i", "d", "b", "x", "o", "s", "f")]
        book = [F.col("book").alias(book_name)] if book_name else []
        return found.select(*book, address_expr(F.col("row"), F.col("at")).alias("address"), "row", F.col("at").alias("col"), *fields, as_string(F.col("c")).alias("value"))

    def first_row_number(self, book_name: str | None = None) -> DataFrame:
        """first_row, first_col (a letter): of the first row of the area that has a cell, in each file; none without one."""
        firsts = replace(self, row_limit=1).typed_rows()
        return firsts.select(*([F.col("book").alias(book_name)] if book_name else []), "first_row", col_letter_expr(F.col("first_col")).alias("first_col"))

    def first_row(self, keys: Keys = (), mode: int = 0, book_name: str | None = None) -> DataFrame:
        """rows() of the first row of the area that has a cell, a header or not."""
        grid = replace(self, first_row_keys=False, row_limit=1)
        return grid.rows(keys if isinstance(keys, dict) else None, mode & ~(KEYS_FIRST_ROW | KEYS_ROW_ZERO_BASED | KEYS_ROW_ONE_BASED), book_name=book_name)

    def first_row_cells(self, mode: int = 0, book_name: str | None = None) -> DataFrame:
        return replace(self, row_limit=1).cells(mode, book_name)

    def row_styles(self, keys: Keys = (), mode: int = 0) -> DataFrame:
        """(book, row, key, value, t, s, f, o): the long form of rows() with the style index of each cell, to be joined with a
        style relation."""
        c = F.col("c")
        return self._long(keys, mode).select("book", F.col("at").alias("row"), F.col("col").alias("key"), as_string(c).alias("value"), c["t"].alias("t"), F.coalesce(c["s"], F.lit(0)).alias("s"), c["f"].alias("f"), c["o"].alias("o"))

    # Pull

    def next_row(self, keys: Keys = (), mode: int = 0) -> Iterator[tuple[int, dict[Any, Any]]]:
        """(row key, {column key: value}) in order of file and row: a pull, which brings a partition at a time to the driver and
        is meant for looking at a sheet, not for processing it. Each call is a stream of its own. A row has the keys of its
        cells only, unless the area has a right bound."""
        layout = self.layout(keys, mode)
        body = self._body(layout, mode).select("book", "row", layout.row_key().alias("at"), "first_col", "head", "attrs", "cells")
        for r in body.orderBy("book", "row").toLocalIterator(prefetchPartitions=True):
            names, less = dict(layout.of(r["head"])), r["first_col"] - 1 if layout.relative else 0
            row = {names[c]: None for c in names} if self.area.bounded else {}
            row |= {names[c["col"] - less]: value_of(c) for c in r["cells"] if c["col"] - less in names}
            yield r["at"], {"__cells": row, "__row": r["attrs"]} if mode & RESULT_MODE_ROW else row

    def read_callback(self, callback: Callable[[int, Any, Any], Any], keys: Keys = (), mode: int = 0) -> None:
        """callback(row key, column key, value) for each cell; a true result ends it."""
        for row, cells in self.next_row(keys, mode & ~RESULT_MODE_ROW):
            for key, value in cells.items():
                if callback(row, key, value):
                    return

    def cursor(self, keys: Keys = (), mode: int = 0) -> Cursor:
        return Cursor(self, keys, mode)


class Cursor:
    """Rows one by one, with a reset: a pull, like Grid.next_row()."""

    def __init__(self, grid: Grid, keys: Keys, mode: int):
        self.grid, self.keys, self.mode = grid, keys, mode
        self.row_number = 0
        self.reset()

    def reset(self) -> None:
        """The next row is the first again; the row number stays until then."""
        plain = self.mode & ~(KEYS_ROW_ZERO_BASED | KEYS_ROW_ONE_BASED)
        self._rows = self.grid.next_row(self.keys, plain)

    rewind = reset

    def read_next_row(self) -> dict[Any, Any] | None:
        """The next row, None at the end; row_number is its number on the sheet."""
        number, row = next(self._rows, (None, None))
        if number is not None:
            self.row_number = number
        return row


def numbered(df: DataFrame, order_by: list[str], name: str = "row", parts: int | None = None) -> DataFrame:
    """df with a column that numbers its rows from 1 by order_by, which must be unique. No task sees more than a share of the
    rows: they are dealt into ranges between sampled keys, counted and numbered there, and the counts of the ranges before are
    added. Costs a look at the keys alone (count, sample and range counts) and one shuffle."""
    from pyspark.sql import Window

    spark = df.sparkSession
    keys = df.select(*order_by)
    total, parts = keys.count(), parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if total <= parts:
        cuts = []
    else:
        sample = sorted(map(tuple, keys.na.drop().sample(fraction=min(1.0, 60.0 * parts / total), seed=7).collect()))
        cuts = [sample[len(sample) * k // parts] for k in range(1, parts)] if len(sample) >= parts else []
    kinds = dict(df.dtypes)
    here = F.struct(*(F.col(c) for c in order_by))
    edges = [F.struct(*(F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order_by, cut, strict=True))) for cut in cuts]

    def range_of(low: int, high: int) -> Column:
        """How many of the edges low to high - 1 a key reaches, plus low: halved at each step."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(here >= edges[middle], range_of(middle + 1, high)).otherwise(range_of(low, middle))

    part = range_of(0, len(edges))
    counts = {r["part"]: r["n"] for r in df.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before = list(accumulate((counts.get(k, 0) for k in range(len(edges))), initial=0))
    offset = F.element_at(F.array(*map(F.lit, before)), F.col("_part") + 1)
    placed = df.withColumn("_part", part)
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order_by))
    return placed.withColumn(name, (within + offset).cast("int")).drop("_part")


def table_scan(df: DataFrame, order_by: list[str], columns: list[str] | None = None, header: bool = False) -> Scan:
    """A table as a sheet: row numbers by order_by (see numbered()), columns from A on, all values as raw text. A table may have
    more rows than a sheet of a file; an area that reaches the last row of one has no lower end here."""
    names = columns or df.columns
    kinds = dict(df.dtypes)
    none = F.lit(None).cast("string")
    wide = df.select(*dict.fromkeys([*order_by, *names]))
    known: list[DataFrame] = []

    def cell(k: int, name: str) -> Column:
        numeric = kinds[name] in ("int", "bigint", "double", "float", "smallint", "tinyint")
        return F.struct(F.lit(k).alias("col"), F.lit("n" if numeric else "s").alias("t"), F.lit(0).alias("s"), F.col(f"`{name}`").cast("string").alias("raw"), none.alias("f"), none.alias("text"), F.lit("").alias("fmt"), F.lit("").alias("code"), F.lit(False).alias("base1904"))

    def inside_of(area: Area) -> list[tuple[int, str]]:
        return [(k, n) for k, n in enumerate(names, 1) if area.col_min <= k <= area.col_max]

    def scan(area: Area, row_limit: int, row_mode: bool) -> DataFrame:
        if not known:
            known.append(numbered(wide, order_by, "#row"))
        inside = inside_of(area)
        first = max(area.row_min, 1 + int(header))
        rows = known[0].select(
            F.lit("").alias("book"),
            (F.col("#row") + int(header)).alias("row"),
            F.lit(first).alias("first_row"),
            F.lit(inside[0][0] if inside else None).cast("int").alias("first_col"),
            F.lit(0).cast("long").alias("head"),
            F.create_map().cast("map<string,string>").alias("attrs"),
            F.array(*(cell(k, n) for k, n in inside)).alias("cells"),
        )
        rows = rows.where(F.col("row") >= area.row_min)
        if area.row_max < MAX_ROW:
            rows = rows.where(F.col("row") <= area.row_max)
        return rows.where(F.col("row") < first + row_limit) if row_limit else rows

    scan.columns = lambda area: [k for k, _ in inside_of(area)]
    return scan
