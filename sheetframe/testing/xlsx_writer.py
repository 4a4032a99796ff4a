"""A small XLSX writer: enough of the format to test a reader with."""

from __future__ import annotations

import io
import zipfile
from dataclasses import dataclass, field
from typing import Any
from xml.sax.saxutils import escape, quoteattr

from ..functions.addressing import col_letter

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006/relationships"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


@dataclass
class Cell:
    """A value with style index, formula, or a type attribute of its own; raw is the text of <v> as it is to stand."""

    value: Any = None
    style: int = 0
    formula: str | None = None
    formula_attrs: str = ""
    kind: str | None = None
    raw: str | None = None
    vm: int | None = None


@dataclass
class SheetSpec:
    name: str = "Sheet1"
    rows: dict[int, list[Any]] = field(default_factory=dict)  # row number to cells from column A on; None is no cell
    state: str = "visible"
    sheet_id: int | None = None
    dimension: str | None = "auto"
    merges: list[str] = field(default_factory=list)
    links: list[tuple[str, str | None, str | None]] = field(default_factory=list)  # ref, target, location
    before: str = ""  # XML before the rows (views, columns)
    after: str = ""  # XML after merges
    row_attrs: dict[int, str] = field(default_factory=dict)
    images: list[tuple[int, int, str, bytes]] = field(default_factory=list)  # row, column, file name, content
    path: str | None = None


@dataclass
class BookSpec:
    sheets: list[SheetSpec] = field(default_factory=list)
    styles: str = ""
    theme: str = ""
    names: dict[str, str] = field(default_factory=dict)
    shared: bool = False
    date1904: bool = False
    prefix: str = ""
    properties: str = ""
    parts: dict[str, bytes] = field(default_factory=dict)
    absolute: bool = False


def _cell_xml(ref: str, cell: Any, strings: dict[str, int] | None, p: str) -> str:
    c = cell if isinstance(cell, Cell) else Cell(cell)
    attrs = f' s="{c.style}"' * bool(c.style) + (f' vm="{c.vm}"' if c.vm is not None else "")
    f = f"<{p}f{c.formula_attrs}>{escape(c.formula or '')}</{p}f>" if c.formula is not None else ""
    v, value = c.raw, c.value
    kind = c.kind
    if v is None and value is not None:
        if isinstance(value, bool):
            kind, v = kind or "b", str(int(value))
        elif isinstance(value, int | float):
            v = repr(value)
        elif strings is not None:
            kind, v = kind or "s", str(strings.setdefault(str(value), len(strings)))
        else:
            text = f"<{p}is><{p}t xml:space=\"preserve\">{escape(str(value), {chr(13): '&#13;'})}</{p}t></{p}is>"
            return f'<{p}c r="{ref}"{attrs} t="inlineStr">{f}{text}</{p}c>'
    kind_attr = f' t="{kind}"' if kind else ""
    body = f + (f"<{p}v>{escape(v)}</{p}v>" if v is not None else "")
    return f'<{p}c r="{ref}"{attrs}{kind_attr}>{body}</{p}c>' if body else f'<{p}c r="{ref}"{attrs}{kind_attr}/>'


def _sheet_xml(spec: SheetSpec, strings: dict[str, int] | None, p: str) -> str:
    lines = []
    for row in sorted(spec.rows):
        cells = "".join(_cell_xml(f"{col_letter(k)}{row}", c, strings, p) for k, c in enumerate(spec.rows[row], 1) if c is not None)
        attrs = spec.row_attrs.get(row, "")
        lines.append(f'<{p}row r="{row}"{" " + attrs if attrs else ""}>{cells}</{p}row>' if cells else f'<{p}row r="{row}"{" " + attrs if attrs else ""}/>')
    dimension = spec.dimension
    if dimension == "auto":
        wide = max((len(r) for r in spec.rows.values()), default=0)
        dimension = f"A{min(spec.rows)}:{col_letter(wide)}{max(spec.rows)}" if spec.rows and wide else "A1"
    head = f'<{p}dimension ref="{dimension}"/>' if dimension else ""
    merges = f'<mergeCells count="{len(spec.merges)}">' + "".join(f'<mergeCell ref="{m}"/>' for m in spec.merges) + "</mergeCells>" if spec.merges else ""
    links = "<hyperlinks>" + "".join(f'<hyperlink ref="{r}"' + (f' r:id="link{k}"' if t else "") + (f" location={quoteattr(loc)}" if loc else "") + "/>" for k, (r, t, loc) in enumerate(spec.links)) + "</hyperlinks>" if spec.links else ""
    drawing = '<drawing r:id="drawing"/>' if spec.images else ""
    space = f' xmlns:x="{_MAIN}"' if p else f' xmlns="{_MAIN}"'
    return f'{_HEAD}<{p}worksheet{space} xmlns:r="{_REL}">{head}{spec.before}<{p}sheetData>{"".join(lines)}</{p}sheetData>{merges}{spec.after}{links}{drawing}</{p}worksheet>'


def _rels(items: list[tuple[str, str, str, bool]]) -> str:
    body = "".join(f'<Relationship Id="{i}" Type="{_REL}/{t}" Target={quoteattr(target)}{" TargetMode=" + quoteattr("External") if ext else ""}/>' for i, t, target, ext in items)
    return f'{_HEAD}<Relationships xmlns="{_PKG}">{body}</Relationships>'


def write_xlsx(spec: BookSpec | list[SheetSpec]) -> bytes:
    book = spec if isinstance(spec, BookSpec) else BookSpec(spec)
    out, p = io.BytesIO(), book.prefix
    strings: dict[str, int] | None = {} if book.shared else None
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        rels, sheets = [], []
        for k, s in enumerate(book.sheets, 1):
            part = s.path or f"worksheets/sheet{k}.xml"
            rels.append((f"sheet{k}", "worksheet", ("/xl/" if book.absolute else "") + part, False))
            state = f' state="{s.state}"' if s.state != "visible" else ""
            sheets.append(f'<sheet name={quoteattr(s.name)} sheetId="{s.sheet_id or k}"{state} r:id="sheet{k}"/>')
            z.writestr(f"xl/{part}", _sheet_xml(s, strings, p))
            own = [(f"link{n}", "hyperlink", t, True) for n, (_, t, _) in enumerate(s.links) if t]
            if s.images:
                own.append(("drawing", "drawing", f"../drawings/drawing{k}.xml", False))
                xdr, a = "http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing", "http://schemas.openxmlformats.org/drawingml/2006/main"
                anchors = "".join(
                    f'<xdr:oneCellAnchor><xdr:from><xdr:col>{col - 1}</xdr:col><xdr:colOff>0</xdr:colOff><xdr:row>{row - 1}</xdr:row><xdr:rowOff>0</xdr:rowOff></xdr:from><xdr:pic><xdr:nvPicPr><xdr:cNvPr id="{n}" name={quoteattr("Picture " + name)}/></xdr:nvPicPr><xdr:blipFill><a:blip r:embed="img{n}"/></xdr:blipFill></xdr:pic></xdr:oneCellAnchor>'
                    for n, (row, col, name, _) in enumerate(s.images)
                )
                z.writestr(f"xl/drawings/drawing{k}.xml", f'{_HEAD}<xdr:wsDr xmlns:xdr="{xdr}" xmlns:a="{a}" xmlns:r="{_REL}">{anchors}</xdr:wsDr>')
                z.writestr(f"xl/drawings/_rels/drawing{k}.xml.rels", _rels([(f"img{n}", "image", f"../media/{name}", False) for n, (_, _, name, _) in enumerate(s.images)]))
                for _, _, name, content in s.images:
                    if f"xl/media/{name}" not in z.namelist():
                        z.writestr(f"xl/media/{name}", content)
            if own:
                folder, _, name = part.rpartition("/")
                z.writestr(f"xl/{folder}/_rels/{name}.rels", _rels(own))
        names = "<definedNames>" + "".join(f"<definedName name={quoteattr(n)}>{escape(r)}</definedName>" for n, r in book.names.items()) + "</definedNames>" if book.names else ""
        mode = '<workbookPr date1904="1"/>' if book.date1904 else ""
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}">{mode}<sheets>{"".join(sheets)}</sheets>{names}</workbook>')
        if book.styles:
            z.writestr("xl/styles.xml", f'{_HEAD}<styleSheet xmlns="{_MAIN}">{book.styles}</styleSheet>')
            rels.append(("styles", "styles", "styles.xml", False))
        if book.theme:
            z.writestr("xl/theme/theme1.xml", f"{_HEAD}{book.theme}")
            rels.append(("theme", "theme", "theme/theme1.xml", False))
        if strings is not None:
            z.writestr("xl/sharedStrings.xml", f'{_HEAD}<sst xmlns="{_MAIN}">' + "".join(f'<si><t xml:space="preserve">{escape(t, {chr(13): "&#13;"})}</t></si>' for t in strings) + "</sst>")
            rels.append(("strings", "sharedStrings", "sharedStrings.xml", False))
        for name, content in book.parts.items():
            z.writestr(name, content)
        z.writestr("xl/_rels/workbook.xml.rels", _rels(rels))
        top = [("book", "officeDocument", "xl/workbook.xml", False)]
        if book.properties:
            z.writestr("docProps/app.xml", f"{_HEAD}<Properties>{book.properties}</Properties>")
            top.append(("app", "extended-properties", "docProps/app.xml", False))
        z.writestr("_rels/.rels", _rels(top))
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/></Types>')
    return out.getvalue()


def table_sheet(name: str, header: list[str] | None, rows: list[tuple], start_row: int = 1, **kw: Any) -> SheetSpec:
    """A table as a sheet, with its header in the first row."""
    lines = ([list(header)] if header else []) + [list(r) for r in rows]
    return SheetSpec(name, {start_row + k: line for k, line in enumerate(lines)}, **kw)


def style_sheet(codes: list[str | int]) -> str:
    """Style XML with a plain style 0 and one style per code: a number stands for a builtin id."""
    custom = {164 + k: c for k, c in enumerate(codes) if isinstance(c, str)}
    formats = f'<numFmts count="{len(custom)}">' + "".join(f'<numFmt numFmtId="{k}" formatCode={quoteattr(c)}/>' for k, c in custom.items()) + "</numFmts>" if custom else ""
    ids = [0] + [c if isinstance(c, int) else 164 + k for k, c in enumerate(codes)]
    xfs = "".join(f'<xf numFmtId="{k}" fontId="0" fillId="0" borderId="0" xfId="0"/>' for k in ids)
    return f'{formats}<fonts><font><sz val="11"/><name val="Calibri"/></font></fonts><fills><fill><patternFill patternType="none"/></fill></fills><borders><border/></borders><cellStyleXfs><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs><cellXfs>{xfs}</cellXfs>'
