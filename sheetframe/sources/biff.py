"""Legacy XLS workbooks (BIFF8): globals, cells, styles, merged ranges, formulas and pictures. No Spark here.

A sheet's rows come from one forward pass over its records, from the offset that the globals name; other sheets aren't
touched.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cached_property
from typing import Any

from ..functions.addressing import Area, Box
from ..functions.dates import format_category, format_code
from . import escher
from .formula import ERRORS, decompile, number_text
from .ole import OleError, OleFile
from .ooxml import INDEXED_COLORS, SheetError

BOF, EOF, CONTINUE, FILEPASS, DATEMODE, BOUNDSHEET, SST = 0x0809, 0x000A, 0x003C, 0x002F, 0x0022, 0x0085, 0x00FC
FONT, FORMAT, XF, PALETTE, DRAWING_GROUP, DRAWING, EXTERNSHEET = 0x0031, 0x041E, 0x00E0, 0x0092, 0x00EB, 0x00EC, 0x0017
DIMENSIONS, ROW, MERGED, LABELSST, LABEL, RSTRING = 0x0200, 0x0208, 0x00E5, 0x00FD, 0x0204, 0x00D6
NUMBER, RK, MULRK, BLANK, MULBLANK, BOOLERR, FORMULA, STRING, SHRFMLA = 0x0203, 0x027E, 0x00BD, 0x0201, 0x00BE, 0x0205, 0x0006, 0x0207, 0x04BC
CELL_RECORDS = frozenset((LABELSST, LABEL, RSTRING, NUMBER, RK, MULRK, BLANK, MULBLANK, BOOLERR, FORMULA))

#: Underline codes, fill patterns, border styles and alignments of the format by number (fixed values).
UNDERLINES = {0x01: 1, 0x02: 2, 0x21: 1, 0x22: 2}
PATTERNS = [
    "none", "solid", "mediumGray", "darkGray", "lightGray", "darkHorizontal", "darkVertical", "darkDown", "darkUp", "darkGrid",
    "darkTrellis", "lightHorizontal", "lightVertical", "lightDown", "lightUp", "lightGrid", "lightTrellis", "gray125", "gray0625",
]
BORDERS = [
    "none", "thin", "medium", "dashed", "dotted", "thick", "double", "hair", "mediumDashed", "dashDot", "mediumDashDot",
    "dashDotDot", "mediumDashDotDot", "slantDashDot",
]
HORIZONTAL = [None, "left", "center", "right", "fill", "justify", "centerContinuous", "distributed"]
VERTICAL = ["top", "center", None, "justify", "distributed"]  # bottom is the default


def decode_rk(value: int) -> float | int:
    """Two flag bits: divided by 100, and a 30-bit signed integer instead of the high half of a double."""
    if value & 2:
        number: float | int = (value >> 2) - (1 << 30 if value & 0x80000000 else 0)
    else:
        number = struct.unpack("<d", struct.pack("<II", 0, value & 0xFFFFFFFC))[0]
    if value & 1:
        number = number / 100
    return int(number) if number == int(number) else number


def records(data: bytes, at: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """(offset, id, body) up to the end."""
    n = len(data)
    while at + 4 <= n:
        kind, size = struct.unpack_from("<HH", data, at)
        yield at, kind, data[at + 4 : at + 4 + size]
        at += 4 + size


def short_string(data: bytes, at: int, wide_length: bool = False) -> tuple[str, int]:
    """A Unicode string with a length of one or two bytes, and where it ends."""
    n = struct.unpack_from("<H", data, at)[0] if wide_length else data[at]
    at += 2 if wide_length else 1
    flags = data[at]
    at += 1
    runs = far = 0
    if flags & 8:
        runs = struct.unpack_from("<H", data, at)[0]
        at += 2
    if flags & 4:
        far = struct.unpack_from("<I", data, at)[0]
        at += 4
    size = n * 2 if flags & 1 else n
    text = data[at : at + size].decode("utf-16-le" if flags & 1 else "latin-1", "replace")
    return text, at + size + 4 * runs + far


def shared_strings(parts: list[bytes]) -> list[str]:
    """The strings of an SST record and its continuations. A string that a boundary cuts goes on after a flag byte of its own
    that says whether the rest is wide."""
    if not parts:
        return []
    count, block, at, out = struct.unpack_from("<I", parts[0], 4)[0], 0, 8, []

    def room() -> int:
        return len(parts[block]) - at

    def take(n: int) -> bytes:
        nonlocal block, at
        got = b""
        while n:
            if not room():
                block, at = block + 1, 0
            piece = parts[block][at : at + n]
            got, at, n = got + piece, at + len(piece), n - len(piece)
        return got

    for _ in range(count):
        if not room() and block + 1 >= len(parts):
            break
        n, flags = struct.unpack("<HB", take(3))
        runs = struct.unpack("<H", take(2))[0] if flags & 8 else 0
        far = struct.unpack("<I", take(4))[0] if flags & 4 else 0
        text, wide = "", flags & 1
        while n:
            if not room():
                block, at = block + 1, 1
                wide = parts[block][0] & 1
            k = min(n, room() // 2 if wide else room())
            text += take(k * 2).decode("utf-16-le", "surrogatepass") if wide else take(k).decode("latin-1")
            n -= k
        take(4 * runs + far)
        out.append(text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace"))
    return out


class XlsSheet:
    kind = "xls"

    def __init__(self, book: XlsBook, sheet_id: int, name: str, state: str, offset: int):
        self.book, self.id, self.name, self.state, self.offset, self.path = book, sheet_id, name, state, offset, ""

    def _records(self) -> Iterator[tuple[int, bytes]]:
        depth = 0
        for _, kind, body in records(self.book.data, self.offset):
            if kind == BOF:
                depth += 1
            elif kind == EOF:
                depth -= 1
                if not depth:
                    return
            if depth == 1:
                yield kind, body

    @cached_property
    def dimension(self) -> str:
        for kind, body in self._records():
            if kind == DIMENSIONS:
                r1, r2, c1, c2 = struct.unpack_from("<IIHH", body)
                return str(Box(r1 + 1, c1 + 1, r2, c2)) if r2 > r1 and c2 > c1 else ""
        return ""

    def merged_cells(self) -> list[str]:
        out = []
        for kind, body in self._records():
            if kind == MERGED:
                for k in range(struct.unpack_from("<H", body)[0]):
                    r1, r2, c1, c2 = struct.unpack_from("<HHHH", body, 2 + 8 * k)
                    out.append(str(Box(r1 + 1, c1 + 1, r2 + 1, c2 + 1)))
        return out

    @cached_property
    def shared_formulas(self) -> dict[tuple[int, int], bytes]:
        """Tokens of shared formulas by the first cell of the group, which each of its cells names."""
        out, last = {}, (0, 0)
        for kind, body in self._records():
            if kind == FORMULA:
                last = struct.unpack_from("<HH", body)
            elif kind == SHRFMLA:
                size = struct.unpack_from("<H", body, 8)[0]
                r1, _, c1 = struct.unpack_from("<HHB", body)
                out[last] = out[(r1, c1)] = body[10 : 10 + size]
        return out

    def _formula(self, row: int, col: int, body: bytes) -> str | None:
        size = struct.unpack_from("<H", body, 20)[0]
        tokens, base = body[22 : 22 + size], None
        if tokens[:1] == b"\x01" and size >= 5:
            at = struct.unpack_from("<HH", tokens, 1)
            tokens, base = self.shared_formulas.get(at), (row, col)
            if tokens is None:
                return None
        text = decompile(tokens, base, self.book.extern_sheets)
        return None if text is None else "=" + text

    def rows(self, area: Area = Area(), row_limit: int = 0, row_mode: bool = False) -> Iterator[tuple[int, dict[str, str], list[dict[str, Any]]]]:
        """(row, attributes, cells); a row without cells isn't given, in row mode either."""
        current, cells, attrs, given = None, [], {}, 0
        waiting: dict[str, Any] | None = None

        def finished() -> tuple[int, dict[str, str], list[dict[str, Any]]]:
            return current + 1, attrs.get(current, {}) if row_mode else {}, sorted(cells, key=lambda c: c["col"])

        for kind, body in self._records():
            if kind == ROW and row_mode:
                number, _, _, height, _, _, flags = struct.unpack_from("<HHHHHHI", body)
                a = {"r": str(number + 1), "ht": number_text((height & 0x7FFF) / 20)}
                if flags & 0x20:
                    a["hidden"] = "1"
                if flags & 0x80:
                    a |= {"customFormat": "1", "s": str(flags >> 16 & 0xFFF)}
                attrs[number] = a
            elif kind == STRING and waiting is not None:
                waiting["raw"], waiting["t"] = short_string(body, 0, True)[0], "s"
                waiting = None
            found = self._cells(kind, body)
            if not found:
                continue
            row = found[0]
            if current is not None and row != current:
                if cells:
                    yield finished()
                    given += 1
                    if row_limit and given >= row_limit:
                        return
                cells = []
            current = row
            if row + 1 > area.row_max:
                return
            if row + 1 >= area.row_min:
                inside = [c for c in found[1] if area.col_min <= c["col"] <= area.col_max]
                cells += inside
                waiting = inside[-1] if inside and kind == FORMULA and inside[-1]["t"] == "pending" else None
        if current is not None and cells:
            yield finished()

    def _cells(self, kind: int, body: bytes) -> tuple[int, list[dict[str, Any]]] | None:
        if kind not in CELL_RECORDS:
            return None
        row, col = struct.unpack_from("<HH", body)
        make = self._make
        if kind == MULRK:
            n = (len(body) - 6) // 6
            return row, [make(col + k, xf, decode_rk(rk)) for k, (xf, rk) in enumerate(struct.unpack_from("<HI", body, 4 + 6 * k) for k in range(n))]
        if kind == MULBLANK:
            n = (len(body) - 6) // 2
            return row, [make(col + k, struct.unpack_from("<H", body, 4 + 2 * k)[0], None) for k in range(n)]
        xf = struct.unpack_from("<H", body, 4)[0]
        if kind == LABELSST:
            k = struct.unpack_from("<I", body, 6)[0]
            strings = self.book.strings
            return row, [make(col, xf, strings[k] if k < len(strings) else "")]
        if kind in (LABEL, RSTRING):
            return row, [make(col, xf, short_string(body, 6, True)[0])]
        if kind == NUMBER:
            return row, [make(col, xf, struct.unpack_from("<d", body, 6)[0])]
        if kind == RK:
            return row, [make(col, xf, decode_rk(struct.unpack_from("<I", body, 6)[0]))]
        if kind == BLANK:
            return row, [make(col, xf, None)]
        if kind == BOOLERR:
            value, is_error = body[6], body[7]
            return row, [make(col, xf, ERRORS.get(value, "#N/A"), "e") if is_error else make(col, xf, bool(value))]
        formula = self._formula(row, col, body)
        result = body[6:14]
        if result[6:8] != b"\xff\xff":
            cell = make(col, xf, struct.unpack("<d", result)[0])
        elif result[0] == 1:
            cell = make(col, xf, bool(result[2]))
        elif result[0] == 2:
            cell = make(col, xf, ERRORS.get(result[2], "#N/A"), "e")
        else:
            cell = make(col, xf, "")
            if result[0] == 0:
                cell["t"] = "pending"  # its text follows in a STRING record
        cell["f"] = formula
        return row, [cell]

    def _make(self, col: int, xf: int, value: Any, kind: str = "") -> dict[str, Any]:
        category, code = self.book.style_type(xf)
        cell = {"col": col + 1, "t": kind, "s": xf, "raw": None, "f": None, "text": None, "fmt": "", "code": code, "base1904": self.book.date1904}
        if isinstance(value, bool):
            cell |= {"t": "b", "raw": "1" if value else "0"}
        elif isinstance(value, int | float):
            cell |= {"t": "n", "raw": number_text(value), "fmt": category}
        elif isinstance(value, str):
            cell |= {"t": kind or "s", "raw": value}
        return cell

    def images(self) -> list[dict[str, Any]]:
        drawing = b"".join(body for kind, body in self._records() if kind == DRAWING)
        return [self.book.picture(k, row + 1, col + 1, name) for k, row, col, name in escher.shapes(drawing)]


class XlsBook:
    kind = "xls"

    def __init__(self, data: bytes):
        try:
            ole = OleFile(data)
            stream = next((n for n in ("Workbook", "Book") if ole.has(n)), None)
            if stream is None:
                raise SheetError("the compound file holds no workbook")
            if stream == "Book":
                raise SheetError("BIFF5 and BIFF7 workbooks aren't supported")
            self.data = ole.stream(stream)
        except OleError as e:
            raise SheetError(str(e)) from e
        self.date1904, self.defined_names = False, {}
        self.sheets: list[XlsSheet] = []
        self.formats: dict[int, str] = {}
        self.xfs: list[bytes] = []
        self.font_records: list[bytes] = []
        self.palette: list[str] = []
        self.extern_sheets: list[str] = []
        sst: list[bytes] = []
        group, last, extern = b"", 0, []
        for at, kind, body in records(self.data):
            if at == 0:
                if kind != BOF or struct.unpack_from("<H", body)[0] != 0x0600:
                    raise SheetError("not a BIFF8 workbook")
            elif kind == EOF:
                break
            if kind == CONTINUE:
                if last == SST:
                    sst.append(body)
                elif last == DRAWING_GROUP:
                    group += body
                continue
            last = kind
            if kind == FILEPASS:
                raise SheetError("the workbook is encrypted")
            if kind == DATEMODE:
                self.date1904 = struct.unpack_from("<H", body)[0] == 1
            elif kind == BOUNDSHEET:
                offset, state, what = struct.unpack_from("<IBB", body)
                if what == 0:
                    name = short_string(body, 6)[0]
                    self.sheets.append(XlsSheet(self, len(self.sheets) + 1, name, ("visible", "hidden", "veryHidden")[min(state & 3, 2)], offset))
            elif kind == SST:
                sst = [body]
            elif kind == FORMAT:
                self.formats[struct.unpack_from("<H", body)[0]] = short_string(body, 2, True)[0]
            elif kind == XF:
                self.xfs.append(body)
            elif kind == FONT:
                self.font_records.append(body)
            elif kind == PALETTE:
                self.palette = [body[k : k + 3].hex().upper() for k in range(2, len(body) - 3, 4)]
            elif kind == DRAWING_GROUP:
                group += body
            elif kind == EXTERNSHEET:
                extern = [struct.unpack_from("<HHH", body, 2 + 6 * k) for k in range(struct.unpack_from("<H", body)[0])]
        self._sst, self._group = sst, group
        self.extern_sheets = [self.sheets[first].name if first < len(self.sheets) else "#REF" for _, first, _ in extern]

    @cached_property
    def strings(self) -> list[str]:
        """Shared strings, read when a cell first asks for one."""
        return shared_strings(self._sst)

    def style_type(self, xf: int) -> tuple[str, str]:
        return self.style_types[xf] if xf < len(self.style_types) else ("", "")

    @cached_property
    def style_types(self) -> list[tuple[str, str]]:
        out = []
        for body in self.xfs:
            k = struct.unpack_from("<H", body, 2)[0]
            code = self.formats.get(k, "")
            out.append((format_category(code, k, True), format_code(code, k)))
        return out

    def color(self, k: int) -> str | None:
        """The palette's colour of an index, else the fixed one; None for automatic ones."""
        if 8 <= k < 8 + len(self.palette):
            return "#" + self.palette[k - 8]
        return "#" + INDEXED_COLORS[k] if k < len(INDEXED_COLORS) else None

    def style_tables(self) -> dict[str, list[dict[str, Any]]]:
        fonts = []
        for body in self.font_records:
            height, flags, color, weight, _, underline = struct.unpack_from("<HHHHHB", body)
            row: dict[str, Any] = {"font-size": number_text(height / 20), "font-name": short_string(body, 14)[0], "font-color": self.color(color)}
            row |= {name: 1 for name, on in (("font-style-bold", weight >= 600), ("font-style-italic", flags & 2), ("font-style-strike", flags & 8)) if on}
            if underline in UNDERLINES:
                row["font-style-underline"] = UNDERLINES[underline]
            fonts.append({k: v for k, v in row.items() if v is not None})
        fills: list[dict[str, Any]] = []
        borders: list[dict[str, Any]] = []
        xfs = []
        for body in self.xfs:
            font, fmt, _, align = struct.unpack_from("<HHHB", body)
            line1, line2, colors = struct.unpack_from("<IIH", body, 10)
            pattern = line2 >> 26 & 0x3F
            fill = {"fill-pattern": PATTERNS[pattern] if pattern < len(PATTERNS) else "none"}
            if pattern and (c := self.color(colors & 0x7F)):
                fill["fill-color"] = c
            border: dict[str, Any] = {}
            for side, style, color in (("left", line1 & 15, line1 >> 16 & 0x7F), ("right", line1 >> 4 & 15, line1 >> 23 & 0x7F), ("top", line1 >> 8 & 15, line2 & 0x7F), ("bottom", line1 >> 12 & 15, line2 >> 7 & 0x7F), ("diagonal", line2 >> 21 & 15, line2 >> 14 & 0x7F)):
                if style and style < len(BORDERS):
                    border |= {f"border-{side}-style": BORDERS[style], f"border-{side}-color": self.color(color) or "#000000"}
            for table, item in ((fills, fill), (borders, border)):
                if item not in table:
                    table.append(item)
            align_row = {"format-align-horizontal": HORIZONTAL[align & 7], "format-align-vertical": VERTICAL[align >> 4 & 7] if (align >> 4 & 7) < len(VERTICAL) else None, "format-wrap-text": 1 if align & 8 else None}
            xfs.append({"numFmtId": fmt, "fontId": font - (font > 4), "fillId": fills.index(fill), "borderId": borders.index(border), "xfId": None, "align": align_row})
        formats = [{"format-num-id": k, "format-pattern": v, "format-category": format_category(v, k, True)} for k, v in self.formats.items()]
        return {"formats": formats, "fonts": fonts, "fills": fills, "borders": borders, "cellStyleXfs": [], "cellXfs": xfs}

    @cached_property
    def blips(self) -> list[tuple[str, bytes]]:
        return escher.blip_store(self._group)

    def picture(self, k: int, row: int, col: int, name: str | None) -> dict[str, Any]:
        from .ooxml import mime_type

        extension, content = self.blips[k - 1] if 0 < k <= len(self.blips) else ("", None)
        return {"row": row, "col": col, "name": name, "file_name": f"image{k}.{extension}" if extension else None, "part": None, "mime": mime_type(content), "content": content}

    def media(self) -> list[str]:
        return [f"image{k}.{extension}" for k, (extension, _) in enumerate(self.blips, 1)]
