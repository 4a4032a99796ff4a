"""A1 addresses and ranges, in Python for plans and as Spark columns for data."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ROW, MAX_COL = 1_048_576, 16_384

_CELLS = re.compile(r"\$?([A-Za-z]+)\$?(\d+)(?::\$?([A-Za-z]+)\$?(\d+))?")
_COLUMNS = re.compile(r"\$?([A-Za-z]+)(?::\$?([A-Za-z]+))?")


class AddressError(ValueError):
    """Not an address or range."""


def col_number(letters: str) -> int:
    """A is 1, XFD 16384; 0 for anything that is no column."""
    n = 0
    for c in letters.upper():
        if not "A" <= c <= "Z":
            return 0
        n = n * 26 + ord(c) - 64
    return n if n <= MAX_COL else 0


def col_letter(number: int) -> str:
    out = ""
    while number > 0:
        number, k = divmod(number - 1, 26)
        out = chr(65 + k) + out
    return out


def col_letter_expr(n: Column) -> Column:
    """The letters of a column number from 1 to 16384."""
    a, b = n - 703, n - 27
    three = F.when(n > 702, F.char((65 + F.floor(a / 676)).cast("int"))).otherwise("")
    two = F.when(n > 26, F.char((65 + F.floor(b / 26) % 26).cast("int"))).otherwise("")
    return F.concat(three, two, F.char((65 + (n - 1) % 26).cast("int")))


def col_number_expr(letters: Column) -> Column:
    """The number of one to three letters."""
    up = F.upper(letters)
    value = lambda k: F.ascii(F.substring(up, k, 1)) - 64
    size = F.length(up)
    return F.when(size == 1, value(1)).when(size == 2, value(1) * 26 + value(2)).when(size == 3, value(1) * 676 + value(2) * 26 + value(3))


def address_expr(row: Column, col: Column) -> Column:
    return F.concat(col_letter_expr(col), row.cast("string"))


@dataclass(frozen=True)
class Area:
    """A rectangle of cells; bounded says that its right side is given, so that its columns are known without reading."""

    row_min: int = 1
    row_max: int = MAX_ROW
    col_min: int = 1
    col_max: int = MAX_COL
    bounded: bool = False

    @property
    def columns(self) -> list[int]:
        return list(range(self.col_min, self.col_max + 1)) if self.bounded else []

    def has(self, row: int, col: int) -> bool:
        return self.row_min <= row <= self.row_max and self.col_min <= col <= self.col_max


def parse_area(text: str) -> Area:
    """B2 (open to the right and below), A1:C3, C:E, C. Dollar signs and case don't matter."""
    text = text.strip()
    if m := _CELLS.fullmatch(text):
        c1, r1, c2, r2 = m.groups()
        area = Area(int(r1), int(r2) if r2 else MAX_ROW, col_number(c1), col_number(c2) if c2 else MAX_COL, bool(c2))
    elif m := _COLUMNS.fullmatch(text):
        c1, c2 = m.groups()
        area = Area(1, MAX_ROW, col_number(c1), col_number(c2) if c2 else MAX_COL, bool(c2))
    else:
        raise AddressError(f"Wrong address or range: {text}")
    if not area.col_min or not area.col_max or not 1 <= area.row_min <= MAX_ROW:
        raise AddressError(f"Wrong address or range: {text}")
    return area


@dataclass(frozen=True)
class Box:
    """A range on a sheet, as declared."""

    row1: int
    col1: int
    row2: int
    col2: int

    def __str__(self) -> str:
        first = f"{col_letter(self.col1)}{self.row1}"
        return first if (self.row1, self.col1) == (self.row2, self.col2) else f"{first}:{col_letter(self.col2)}{self.row2}"


def parse_box(text: str) -> Box | None:
    """A range or a single cell as a box; None if it is neither."""
    m = _CELLS.fullmatch(text.strip())
    if not m:
        return None
    c1, r1, c2, r2 = m.groups()
    return Box(int(r1), col_number(c1), int(r2 or r1), col_number(c2 or c1))


def range_stats(text: str) -> dict[str, int]:
    """Counts and bounds that a range text declares; zeros for an empty one."""
    box = parse_box(text) if text else None
    if box is None:
        return dict.fromkeys(("count_rows", "count_columns", "min_row", "max_row", "min_column", "max_column"), 0)
    return {"count_rows": box.row2 - box.row1 + 1, "count_columns": box.col2 - box.col1 + 1, "min_row": box.row1, "max_row": box.row2, "min_column": box.col1, "max_column": box.col2}


def range_stats_expr(text: Column) -> Column:
    """range_stats() as a struct, of a column of range texts."""
    pattern = r"^\s*\$?([A-Za-z]{1,3})\$?([0-9]+)(?::\$?([A-Za-z]{1,3})\$?([0-9]+))?\s*$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    either = lambda k, other: F.when(part(k) != "", part(k)).otherwise(part(other))
    row1, row2 = part(2).try_cast("int"), either(4, 2).try_cast("int")
    col1, col2 = col_number_expr(part(1)).cast("int"), col_number_expr(either(3, 1)).cast("int")
    found = {"count_rows": row2 - row1 + 1, "count_columns": col2 - col1 + 1, "min_row": row1, "max_row": row2, "min_column": col1, "max_column": col2}
    return F.struct(*(F.coalesce(v, F.lit(0)).alias(k) for k, v in found.items()))


def split_sheet_ref(text: str) -> tuple[str | None, str]:
    """'My sheet'!$A$1:$B$2 to (My sheet, $A$1:$B$2); the sheet is None where none is named."""
    if "!" not in text:
        return None, text
    sheet, _, area = text.rpartition("!")
    if len(sheet) > 1 and sheet[0] == sheet[-1] == "'":
        sheet = sheet[1:-1].replace("''", "'")
    return sheet, area
