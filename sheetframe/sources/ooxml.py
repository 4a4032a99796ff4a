"""XLSX packages: catalogue, sheet rows, metadata parts, styles and images, from bytes or a file object. No Spark here.

Rows stream out of the package: a sheet's XML is inflated and parsed a block at a time and one row is held at once.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from functools import cached_property
from typing import Any, BinaryIO
from xml.etree import ElementTree
from xml.parsers import expat

from ..functions.addressing import MAX_COL, MAX_ROW, Area, col_letter, col_number, parse_box
from ..functions.dates import format_category, format_code, is_date_format
from ..functions.typing_rules import unescape

_BLOCK = 1 << 16
_REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_REF = re.compile(r"(\$?)([A-Z]{1,3})(\$?)([0-9]+)(?![0-9A-Za-z_(!.])")
_ROWS_BEGIN = re.compile(rb"<((?:[A-Za-z_][\w.-]*:)?)sheetData\s*(/?)>")
_TEXT = re.compile(r"\"[^\"]*\"|'[^']*'")

#: Legacy indexed colours 0 to 63 (fixed values): eight basic ones, twice, then the default palette.
INDEXED_COLORS = [
    "000000", "FFFFFF", "FF0000", "00FF00", "0000FF", "FFFF00", "FF00FF", "00FFFF",
    "000000", "FFFFFF", "FF0000", "00FF00", "0000FF", "FFFF00", "FF00FF", "00FFFF",
    "800000", "008000", "000080", "808000", "800080", "008080", "C0C0C0", "808080",
    "9999FF", "993366", "FFFFCC", "CCFFFF", "660066", "FF8080", "0066CC", "CCCCFF",
    "000080", "FF00FF", "FFFF00", "00FFFF", "800080", "800000", "008080", "0000FF",
    "00CCFF", "CCFFFF", "CCFFCC", "FFFF99", "99CCFF", "FF99CC", "CC99FF", "FFCC99",
    "3366FF", "33CCCC", "99CC00", "FFCC00", "FF9900", "FF6600", "666699", "969696",
    "003366", "339966", "003300", "333300", "993300", "993366", "333399", "333333",
]

#: System colours of a theme as they are reported (fixed values).
SYSTEM_COLORS = {"windowText": "#ffffff", "window": "#202020"}

#: Document properties and the names they are reported under (fixed values).
PROPERTY_NAMES = {
    "title": "title", "subject": "subject", "creator": "creator", "keywords": "keywords", "description": "description", "category": "category",
    "lastModifiedBy": "last_modified_by", "created": "date_created", "modified": "date_modified", "revision": "revision", "version": "version", "language": "language",
    "contentStatus": "content_status", "identifier": "identifier", "Application": "application", "AppVersion": "app_version", "Company": "company", "Manager": "manager", "HyperlinkBase": "hyperlink_base", "DocSecurity": "doc_security",
}


class SheetError(ValueError):
    """A file that can't be read as what it claims to be."""


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].rsplit(":", 1)[-1]


def children(node: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (n for n in node if local(n.tag) == name)


def child(node: ElementTree.Element | None, name: str) -> ElementTree.Element | None:
    return None if node is None else next(children(node, name), None)


def shift_formula(formula: str, rows: int, cols: int) -> str:
    """A formula moved by so many rows and columns. Dollar signs hold a part; texts, sheet names and function names stay."""

    def moved(m: re.Match) -> str:
        fixed_col, letters, fixed_row, digits = m.groups()
        if m.start() and (m.string[m.start() - 1].isalnum() or m.string[m.start() - 1] in "_."):
            return m[0]
        col, row = col_number(letters), int(digits)
        if not col:
            return m[0]
        col, row = col if fixed_col else col + cols, row if fixed_row else row + rows
        return f"{fixed_col}{col_letter(col)}{fixed_row}{row}" if 1 <= col <= MAX_COL and 1 <= row <= MAX_ROW else "#REF!"

    out, at = [], 0
    for m in _TEXT.finditer(formula):
        out += [_REF.sub(moved, formula[at : m.start()]), m[0]]
        at = m.end()
    return "".join(out) + _REF.sub(moved, formula[at:])


class XlsxSheet:
    """A sheet's place in the book; reads rows and parts on request."""

    kind = "xlsx"

    def __init__(self, book: XlsxBook, sheet_id: int, name: str, state: str, path: str):
        self.book, self.id, self.name, self.state, self.path = book, sheet_id, name, state, path

    def rows(self, area: Area = Area(), row_limit: int = 0, row_mode: bool = False) -> Iterator[tuple[int, dict[str, str], list[dict[str, Any]]]]:
        """(row, attributes, cells) in document order, cells as dicts of RAW_CELL and vm. Rows without cells in the area come
        only in row mode. row_limit counts raw rows."""
        given = 0
        for row, attrs, cells in self._parse(area, row_mode):
            if row > area.row_max:
                return
            if row < area.row_min or not cells and not row_mode:
                continue
            yield row, attrs, cells
            given += 1
            if row_limit and given >= row_limit:
                return

    def _parse(self, area: Area, row_mode: bool) -> Iterator[tuple[int, dict[str, str], list[dict[str, Any]]]]:
        prefixed, finish = self.book.prefixed, self._finish
        row_min, col_min, col_max = area.row_min, area.col_min, area.col_max
        done: list[tuple[int, dict[str, str], list[dict[str, Any]]]] = []
        shared: dict[str, tuple[int, int, str]] = {}
        numbers: dict[str, int] = {}
        row = col = 0
        cell: dict[str, Any] | None = None
        inside = ""
        row_attrs: dict[str, str] = {}
        cells: list[dict[str, Any]] = []
        buffer: list[str] = []

        def start(name: str, attrs: dict[str, str]) -> None:
            nonlocal row, col, cell, inside, row_attrs, cells
            if prefixed:
                name = name.rpartition(":")[2]
            if name == "c":
                letters = attrs["r"].rstrip("0123456789") if "r" in attrs else ""
                if letters not in numbers:
                    numbers[letters] = col_number(letters)
                col = numbers[letters] if letters else col + 1
                if row >= row_min and col_min <= col <= col_max:
                    cell = {"col": col, "t": attrs.get("t", ""), "s": int(attrs["s"]) if "s" in attrs else 0, "raw": None, "f": None, "text": None, "vm": int(attrs["vm"]) if "vm" in attrs else None, "fattr": None}
            elif name == "row":
                row = int(attrs["r"]) if "r" in attrs else row + 1
                row_attrs = dict(attrs) if row_mode else {}
                cells, col = [], 0
            elif cell is not None and (name == "v" or name == "f" or name == "is"):
                inside = name
                buffer.clear()
                if name == "f":
                    cell["fattr"] = attrs

        def text(data: str) -> None:
            if inside:
                buffer.append(data)

        def end(name: str) -> None:
            nonlocal cell, inside
            if prefixed:
                name = name.rpartition(":")[2]
            if cell is not None:
                if name == "c":
                    cells.append(finish(cell, row, shared))
                    cell = None
                    return
                if name == inside and name:
                    cell["raw" if name == "v" else "f" if name == "f" else "text"] = "".join(buffer)
                    inside = ""
                    return
            if name == "row":
                done.append((row, row_attrs, cells))

        parser = expat.ParserCreate()
        parser.buffer_text = True
        parser.StartElementHandler, parser.CharacterDataHandler, parser.EndElementHandler = start, text, end
        with self.book.open(self.path) as stream:
            while block := stream.read(_BLOCK):
                parser.Parse(block, False)
                yield from done
                done.clear()
            parser.Parse(b"", True)
            yield from done

    def _finish(self, cell: dict[str, Any], row: int, shared: dict[str, tuple[int, int, str]]) -> dict[str, Any]:
        attrs = cell.pop("fattr")
        if attrs is not None:
            formula, si = cell["f"] or "", attrs.get("si", "") if attrs.get("t") == "shared" else ""
            if formula:
                formula = formula if formula.startswith("=") else "=" + formula
                if si:
                    shared[si] = (row, cell["col"], formula)
            elif si in shared:
                first_row, first_col, master = shared[si]
                formula = shift_formula(master, row - first_row, cell["col"] - first_col)
            cell["f"] = formula
        if cell["t"] == "s" and (cell["raw"] or "").strip().isdigit():
            cell["raw"] = self.book.shared_string(int(cell["raw"]), cell["raw"])
        kind, code = self.book.style_type(cell["s"])
        cell["fmt"], cell["code"], cell["base1904"] = kind, code, self.book.date1904
        own = kind if cell["s"] > 0 and kind and cell["t"] in ("", "n", "s") else cell["t"]
        if own in ("s", "string", "inlineStr"):
            for slot in ("raw", "text"):
                if cell[slot] and "_x" in cell[slot]:
                    cell[slot] = unescape(cell[slot])
        return cell

    def _without_rows(self) -> bytes | None:
        """The sheet's XML with its rows left out unread. None where bytes don't tell where they end: with a comment, a CDATA
        section or a document type somewhere, or in an encoding of wider units."""
        kept, tail, closing = b"", b"", b""
        with self.book.open(self.path) as stream:
            while block := stream.read(_BLOCK):
                if b"<!" in tail + block:
                    return None
                if not closing:
                    kept += block
                    tail = kept[-1:]
                    if m := _ROWS_BEGIN.search(kept):
                        if m[2]:  # no rows at all
                            return kept + stream.read()
                        closing, kept, tail = b"</" + m[1] + b"sheetData", kept[: m.end()], kept[m.end() :]
                        block = b""
                    elif len(kept) > 1 << 20:
                        return None
                if closing:
                    tail += block
                    if (at := tail.find(closing)) >= 0:
                        rest = tail[at:] + stream.read()
                        return None if b"<!" in rest else kept + rest
                    tail = tail[-len(closing) :]
        return None

    @cached_property
    def tree(self) -> dict[str, list[ElementTree.Element]]:
        """The top elements of the sheet but for its rows, by local name."""
        found: dict[str, list[ElementTree.Element]] = {}
        plain = self._without_rows()
        with self.book.open(self.path) if plain is None else io.BytesIO(plain) as stream:
            depth, prefixed = 0, self.book.prefixed
            for event, node in ElementTree.iterparse(stream, ("start", "end")):
                if event == "start":
                    depth += 1
                    continue
                depth -= 1
                name = local(node.tag)
                if name == "row":
                    node.clear()
                elif depth == 1 and name != "sheetData" and (prefixed or node.tag):
                    found.setdefault(name, []).append(node)
        return found

    def first(self, name: str) -> ElementTree.Element | None:
        return self.tree.get(name, [None])[0]

    @property
    def dimension(self) -> str:
        node = self.first("dimension")
        return "" if node is None else node.get("ref", "")

    @property
    def active(self) -> bool:
        return any(v.get("tabSelected") in ("1", "true") for views in self.tree.get("sheetViews", ()) for v in views)

    def merged_cells(self) -> list[str]:
        return [m.get("ref", "") for node in self.tree.get("mergeCells", ()) for m in children(node, "mergeCell")]

    def hyperlinks(self) -> list[dict[str, str | None]]:
        rels = self.book.relations(self.path)
        return [
            {"ref": h.get("ref"), "link": rels.get(h.get(_REL_ID, ""), {}).get("target"), "location": h.get("location"), "display": h.get("display"), "tooltip": h.get("tooltip")}
            for node in self.tree.get("hyperlinks", ())
            for h in children(node, "hyperlink")
        ]

    def validations(self) -> list[dict[str, str | None]]:
        out = []
        for node in [n for name in ("dataValidations", "extLst") for n in self.tree.get(name, ())]:
            for v in node.iter():
                if local(v.tag) != "dataValidation":
                    continue
                parts = {local(n.tag): "".join(n.itertext()).strip() for n in v}
                out.append({"type": v.get("type"), "sqref": v.get("sqref") or parts.get("sqref"), "formula1": parts.get("formula1"), "formula2": parts.get("formula2")})
        return out

    def conditional_formats(self) -> list[dict[str, Any]]:
        out = []
        for node in self.tree.get("conditionalFormatting", ()):
            attributes: dict[str, str] = {}
            for rule in children(node, "cfRule"):
                attributes |= dict(rule.attrib)
            out.append({"type": attributes.pop("type", None), "sqref": node.get("sqref"), "attributes": attributes})
        return out

    def columns(self) -> list[dict[str, Any]]:
        out = []
        for node in self.tree.get("cols", ()):
            for c in children(node, "col"):
                for n in range(int(c.get("min", 1)), min(int(c.get("max", 1)), MAX_COL) + 1):
                    out.append({"col": n, "width": float(c.get("width")) if c.get("width") else None, "style": int(c.get("style", 0)), "attributes": dict(c.attrib)})
        return out

    @property
    def default_height(self) -> float:
        node = self.first("sheetFormatPr")
        return float(node.get("defaultRowHeight", 15)) if node is not None else 15.0

    def freeze_pane(self) -> dict[str, Any] | None:
        for views in self.tree.get("sheetViews", ()):
            for pane in views.iter():
                if local(pane.tag) == "pane" and pane.get("state") in ("frozen", "frozenSplit"):
                    return {"x_split": int(float(pane.get("xSplit", 0))), "y_split": int(float(pane.get("ySplit", 0))), "top_left": pane.get("topLeftCell")}
        return None

    def tab_color(self) -> dict[str, str] | None:
        node = child(self.first("sheetPr"), "tabColor")
        return None if node is None else dict(node.attrib)

    def images(self) -> list[dict[str, Any]]:
        """Drawn pictures by their anchor, then pictures placed in cells."""
        out = []
        for drawing in self.tree.get("drawing", ()):
            target = self.book.relations(self.path).get(drawing.get(_REL_ID, ""), {}).get("part")
            if not target or target not in self.book.names:
                continue
            rels = self.book.relations(target)
            for anchor in self.book.xml(target):
                at = child(anchor, "from")
                blip = next((n for n in anchor.iter() if local(n.tag) == "blip"), None)
                name = next((n.get("name") for n in anchor.iter() if local(n.tag) == "cNvPr"), None)
                if at is None or blip is None:
                    continue
                part = rels.get(next((v for k, v in blip.attrib.items() if local(k) == "embed"), ""), {}).get("part")
                if part:
                    row, col = (int((child(at, k).text or "0")) + 1 for k in ("row", "col"))
                    out.append(self.book.image(row, col, name, part))
        rich = self.book.rich_images
        if rich:
            for row, _, cells in self.rows():
                out += [self.book.image(row, c["col"], None, rich[c["vm"]]) for c in cells if c.get("vm") in rich]
        return out


class XlsxBook:
    """A package's catalogue. Parts are read when first asked for."""

    kind = "xlsx"

    def __init__(self, source: bytes | BinaryIO, prefixed: bool = False):
        self.prefixed = prefixed
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(source) if isinstance(source, bytes) else source)
        except zipfile.BadZipFile as e:
            raise SheetError(f"not a ZIP package: {e}") from e
        self.names = {n.lstrip("/"): n for n in self.zip.namelist()}
        self.lower = {n.lower(): n for n in self.names}
        top = self.relations("")
        book = next((r["part"] for r in top.values() if r["type"].endswith("/officeDocument")), "xl/workbook.xml")
        if book not in self.names or not book.startswith("xl/") and "xl/workbook.xml" not in self.names:
            other = next((k for p, k in (("word/", "DOCX"), ("ppt/", "PPTX")) if any(n.startswith(p) for n in self.names)), None)
            raise SheetError("not an XLSX workbook" + (f"; it looks like {other}" if other else ""))
        self.part = book
        self.sheets: list[XlsxSheet] = []
        self.defined_names: dict[str, str] = {}
        self.date1904 = False
        rels = self.relations(book)
        for node in self.xml(book):
            name = local(node.tag)
            if name == "workbookPr":
                self.date1904 = node.get("date1904") in ("1", "true")
            elif name == "sheets":
                for s in children(node, "sheet"):
                    part = rels.get(s.get(_REL_ID, ""), {}).get("part")
                    if part in self.names:
                        self.sheets.append(XlsxSheet(self, int(s.get("sheetId", 0)), s.get("name", ""), s.get("state", "visible"), part))
            elif name == "definedNames":
                self.defined_names |= {d.get("name", ""): d.text or "" for d in children(node, "definedName")}

    def open(self, part: str) -> BinaryIO:
        return self.zip.open(self.names[part])

    def xml(self, part: str) -> ElementTree.Element:
        with self.open(part) as f:
            return ElementTree.parse(f).getroot()

    def relations(self, part: str) -> dict[str, dict[str, str]]:
        """Relations of a part by id: type, target as written, and part, the package part it resolves to."""
        folder, name = posixpath.split(part)
        rels = posixpath.join(folder, "_rels", name + ".rels")
        if rels not in self.names:
            return {}
        out = {}
        for r in self.xml(rels):
            target = r.get("Target", "")
            path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            if path not in self.names:
                path = self.lower.get(path.lower(), path)
            out[r.get("Id", "")] = {"type": r.get("Type", ""), "target": target, "part": path}
        return out

    def _related(self, kind: str) -> str | None:
        return next((r["part"] for r in self.relations(self.part).values() if r["type"].endswith("/" + kind) and r["part"] in self.names), None)

    @cached_property
    def shared_strings(self) -> list[str]:
        part, out = self._related("sharedStrings"), []
        if part:
            with self.open(part) as f:
                for _, node in ElementTree.iterparse(f):
                    if local(node.tag) == "si":
                        out.append("".join(node.itertext()))
                        node.clear()
        return out

    def shared_string(self, k: int, default: str | None = None) -> str | None:
        return self.shared_strings[k] if 0 <= k < len(self.shared_strings) else default

    @cached_property
    def _styles(self) -> dict[str, list[ElementTree.Element]]:
        part = self._related("styles")
        return {local(n.tag): list(n) for n in self.xml(part)} if part else {}

    @cached_property
    def number_formats(self) -> dict[int, str]:
        return {int(n.get("numFmtId", 0)): n.get("formatCode", "") for n in self._styles.get("numFmts", ())}

    @cached_property
    def style_types(self) -> list[tuple[str, str]]:
        """(category, code) of each cell style."""
        out = []
        for xf in self._styles.get("cellXfs", ()):
            k = int(xf.get("numFmtId", 0))
            code = self.number_formats.get(k, "")
            out.append((format_category(code, k), format_code(code, k)))
        return out

    def style_type(self, s: int) -> tuple[str, str]:
        return self.style_types[s] if 0 <= s < len(self.style_types) else ("", "")

    @cached_property
    def theme(self) -> list[str]:
        part = self._related("theme")
        scheme = next((n for n in self.xml(part).iter() if local(n.tag) == "clrScheme"), ()) if part else ()
        out = []
        for slot in scheme:
            for c in slot:
                out.append(SYSTEM_COLORS.get(c.get("val", ""), "#" + c.get("lastClr", "000000").lower()) if local(c.tag) == "sysClr" else "#" + c.get("val", "000000"))
        return out

    def color(self, node: ElementTree.Element | None) -> str | None:
        """#RRGGBB of a colour node: its rgb, else its theme colour with tint, else its index."""
        if node is None:
            return None
        if rgb := node.get("rgb"):
            return "#" + rgb[-6:]
        if (theme := node.get("theme")) is not None and int(theme) < len(self.theme):
            return tinted(self.theme[int(theme)], float(node.get("tint", 0)))
        if (k := node.get("indexed")) is not None and int(k) < len(INDEXED_COLORS):
            return "#" + INDEXED_COLORS[int(k)]
        return None

    def style_tables(self) -> dict[str, list[dict[str, Any]]]:
        """formats, fonts, fills, borders and the cell style records (xfs and their parents)."""
        fonts = []
        for f in self._styles.get("fonts", ()):
            row: dict[str, Any] = {}
            for n in f:
                name, val = local(n.tag), n.get("val")
                if name in ("b", "i", "strike"):
                    row[{"b": "font-style-bold", "i": "font-style-italic", "strike": "font-style-strike"}[name]] = int(val not in ("0", "false"))
                elif name == "u":
                    row["font-style-underline"] = 2 if val == "double" else 1
                elif name == "color":
                    row["font-color"] = self.color(n)
                elif name in ("name", "sz", "family", "charset"):
                    row[{"sz": "font-size"}.get(name, "font-" + name)] = val
            fonts.append(row)
        fills = []
        for f in self._styles.get("fills", ()):
            p = child(f, "patternFill")
            row = {}
            if p is not None:
                row["fill-pattern"] = p.get("patternType")
                row["fill-color"] = self.color(child(p, "fgColor"))
            fills.append({k: v for k, v in row.items() if v is not None})
        borders = []
        for b in self._styles.get("borders", ()):
            row = {}
            for n in b:
                side = local(n.tag)
                if side in ("left", "right", "top", "bottom", "diagonal") and n.get("style"):
                    row[f"border-{side}-style"] = n.get("style")
                    row[f"border-{side}-color"] = self.color(child(n, "color")) or "#000000"
            borders.append(row)
        records = {}
        for kind in ("cellStyleXfs", "cellXfs"):
            records[kind] = []
            for xf in self._styles.get(kind, ()):
                align = child(xf, "alignment")
                row = {k: int(xf.get(k)) if xf.get(k) is not None else None for k in ("numFmtId", "fontId", "fillId", "borderId", "xfId")}
                row["align"] = {} if align is None else {"format-align-horizontal": align.get("horizontal"), "format-align-vertical": align.get("vertical"), "format-wrap-text": 1 if align.get("wrapText") in ("1", "true") else None}
                records[kind].append(row)
        formats = [{"format-num-id": k, "format-pattern": v, "format-category": "date" if is_date_format(v) else ""} for k, v in self.number_formats.items()]
        return {"formats": formats, "fonts": fonts, "fills": fills, "borders": borders, **records}

    def properties(self) -> dict[str, str]:
        out = {}
        for kind in ("core-properties", "extended-properties"):
            part = next((r["part"] for r in self.relations("").values() if r["type"].endswith("/" + kind) and r["part"] in self.names), None)
            for n in self.xml(part) if part else ():
                if (name := PROPERTY_NAMES.get(local(n.tag))) and n.text:
                    out[name] = n.text
        return out

    @cached_property
    def rich_images(self) -> dict[int, str]:
        """Image parts by the value-metadata index of a cell (from 1)."""
        meta = next((r["part"] for r in self.relations(self.part).values() if r["type"].endswith("/sheetMetadata") and r["part"] in self.names), None)
        values = next((n for n in self.names if re.search(r"richData/rdrichvalue\.xml$", n, re.I)), None)
        links = next((n for n in self.names if re.search(r"richData/richValueRel\.xml$", n, re.I)), None)
        if not meta or not values or not links:
            return {}
        root = self.xml(meta)
        future = [int(n.get("i", 0)) for f in root.iter() if local(f.tag) == "futureMetadata" for n in f.iter() if local(n.tag) == "rvb"]
        marks = [[int(rc.get("v", 0)) for rc in bk] for f in root.iter() if local(f.tag) == "valueMetadata" for bk in f]
        rich = [[v.text or "" for v in children(rv, "v")] for rv in self.xml(values)]
        targets = [next((v for k, v in r.attrib.items() if local(k) == "id"), "") for r in self.xml(links)]
        rels = self.relations(links)
        out = {}
        for k, mark in enumerate(marks, 1):
            try:
                out[k] = rels[targets[int(rich[future[mark[0]]][0])]]["part"]
            except (IndexError, KeyError, ValueError):
                continue
        return out

    def image(self, row: int, col: int, name: str | None, part: str) -> dict[str, Any]:
        content = self.open(part).read() if part in self.names else None
        return {"row": row, "col": col, "name": name, "file_name": posixpath.basename(part), "part": part, "mime": mime_type(content), "content": content}

    def media(self) -> list[str]:
        return sorted(n for n in self.names if n.startswith("xl/media/"))

    def entries(self) -> list[dict[str, Any]]:
        return [{"entry": n, "size": self.zip.getinfo(z).file_size} for n, z in self.names.items()]

    def validate(self) -> list[dict[str, Any]]:
        """Whether each XML part of the package is well formed."""
        out = []
        for name in self.names:
            if name.endswith((".xml", ".rels", ".vml")):
                try:
                    self.xml(name)
                    out.append({"entry": name, "ok": True, "message": None})
                except (ElementTree.ParseError, zipfile.BadZipFile) as e:
                    out.append({"entry": name, "ok": False, "message": str(e)})
        return out


def mime_type(content: bytes | None) -> str | None:
    """By the first bytes."""
    for magic, mime in ((b"\x89PNG", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF8", "image/gif"), (b"BM", "image/bmp"), (b"RIFF", "image/webp"), (b"<svg", "image/svg+xml"), (b"<?xml", "image/svg+xml"), (b"\xd7\xcd\xc6\x9a", "image/wmf"), (b"\x01\x00\x00\x00", "image/emf")):
        if content and content.startswith(magic):
            return mime
    return "application/octet-stream" if content else None


def tinted(color: str, tint: float) -> str:
    """A colour made lighter (tint above 0) or darker, in HLS space."""
    import colorsys

    if not tint:
        return color
    h, light, s = colorsys.rgb_to_hls(*(int(color[k : k + 2], 16) / 255 for k in (1, 3, 5)))
    light = light * (1 + tint) if tint < 0 else light * (1 - tint) + tint
    return "#" + "".join(f"{round(x * 255):02X}" for x in colorsys.hls_to_rgb(h, min(1, max(0, light)), s))


def declared_area(text: str) -> Area | None:
    box = parse_box(text) if text else None
    return Area(box.row1, box.row2, box.col1, box.col2, True) if box else None
