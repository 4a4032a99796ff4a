"""Grids, books, styles and sources on generated workbooks."""

import io
import time

import pytest
from pyspark.sql import functions as F

from sheetframe.functions.addressing import AddressError
from sheetframe.functions.typing_rules import DateMode
from sheetframe.operators import grid as g
from sheetframe.plans.book import open_book, open_bytes, open_csv, open_stream
from sheetframe.sources.ooxml import SheetError
from sheetframe.sources.workbook import register
from sheetframe.testing.xls_writer import XlsCell, XlsSheetSpec, write_xls
from sheetframe.testing.xlsx_writer import BookSpec, Cell, SheetSpec, style_sheet, write_xlsx

PEOPLE = {
    1: ["#", "name", "birthday", "random_int"],
    2: [1, "Ada Novak", Cell(45, style=1), 4573],
    3: [2, "Lena Marie Ostrom", Cell(102128, style=1), 982630],
    4: [3, "Otto van Halm", Cell(-53682, style=1), 7239],
}
OFFSET = {2: [None, "Title"], 4: [None, "Name", "Date", "Color"], 5: [None, "Marta", Cell(25781, style=1), "Red"], 7: [None, "Jonas", Cell(24031, style=1), "Purple"]}
RAGGED = {2: ["aaa", "bbb", "ccc", "ddd"], 5: ["e", None, "", "  f "], 6: [6]}


@pytest.fixture(scope="module")
def xlsx():
    return write_xlsx(
        BookSpec(
            [SheetSpec("People", PEOPLE), SheetSpec("Offset", OFFSET, merges=["B2:D2"], sheet_id=9), SheetSpec("Ragged", RAGGED, state="hidden", row_attrs={5: 'ht="20"', 9: 'ht="33"'})],
            styles=style_sheet(["yyyy-mm-dd"]),
            names={"Values": "Offset!$B$5:$D$7"},
            shared=True,
        )
    )


@pytest.fixture(scope="module")
def book(spark, xlsx):
    return open_bytes(spark, xlsx)


def pulled(grid, *args, **kw):
    return dict(grid.next_row(*args, **kw))


def test_catalogue(book):
    assert book.sheet_names() == ["People", "Offset", "Ragged"]
    assert [s.name for s in book.visible_sheets()] == ["People", "Offset"]
    assert [s.name for s in book.hidden_sheets()] == ["Ragged"]
    assert book.sheet("OFFSET").id == 9 and book.sheet_by_id(9).name == "Offset"
    assert book.sheet("none") is None and not book.sheet_exists("none")
    assert book.first_sheet().name == "People" and book.count_sheets() == 3
    for bad in (lambda: book.get_sheet("none"), lambda: book.sheet_by_id(5)):
        with pytest.raises(SheetError):
            bad()


def test_key_modes_on_an_anchored_sheet(book):
    grid = book.sheet("People").grid()
    plain = pulled(grid)
    assert plain[2] == {"A": 1, "B": "Ada Novak", "C": -2205187200, "D": 4573}
    assert plain[3]["C"] == 6614697600 and list(plain) == [1, 2, 3, 4]
    assert pulled(grid, (), g.KEYS_RELATIVE) == plain
    assert list(pulled(grid, (), g.KEYS_ROW_ZERO_BASED)) == [0, 1, 2, 3]
    assert pulled(grid, (), g.KEYS_ZERO_BASED)[1] == {0: 1, 1: "Ada Novak", 2: -2205187200, 3: 4573}
    assert pulled(grid, (), g.KEYS_ONE_BASED)[2] == {1: 1, 2: "Ada Novak", 3: -2205187200, 4: 4573}
    first = pulled(grid, (), g.KEYS_FIRST_ROW)
    assert list(first) == [2, 3, 4] and first[2]["name"] == "Ada Novak"
    assert list(pulled(grid, (), g.KEYS_FIRST_ROW | g.KEYS_ROW_ZERO_BASED)) == [0, 1, 2]
    assert list(pulled(grid, (), g.KEYS_FIRST_ROW | g.KEYS_ROW_ONE_BASED)) == [1, 2, 3]


def test_key_modes_on_an_offset_sheet(book):
    grid = book.sheet("Offset").from_cell("B4")
    assert list(pulled(grid)) == [4, 5, 7]
    assert list(pulled(grid, (), g.KEYS_ROW_ZERO_BASED)) == [0, 1, 3]  # gaps stay
    assert pulled(grid, (), g.KEYS_COL_ZERO_BASED)[5] == {0: "Marta", 1: 18316800, 2: "Red"}
    bounded = book.sheet("Offset").set_read_area("A4:D7")
    assert pulled(bounded, (), g.KEYS_COL_ONE_BASED)[5] == {1: None, 2: "Marta", 3: 18316800, 4: "Red"}


def test_header_precedence(book):
    header, area = book.sheet("People").with_header(), book.sheet("People").grid()
    assert list(pulled(header)) == [2, 3, 4]
    assert list(pulled(header, None)) == list(pulled(header, False)) == [1, 2, 3, 4]
    assert list(pulled(area, True)) == [2, 3, 4]
    assert list(pulled(header, {"B": "who"})) == [1, 2, 3, 4]  # a map leaves the header to the mode
    named = pulled(area, {"b": "who"}, g.KEYS_FIRST_ROW)
    assert list(named[2]) == ["#", "who", "birthday", "random_int"]


def test_header_names(book):
    sheet = book.sheet("People")
    assert list(pulled(sheet.with_header(["no"]))[2]) == ["no", "name", "birthday", "random_int"]
    assert list(pulled(sheet.with_header(["a", "b", "c", "d", "e"]))[2]) == ["a", "b", "c", "d"]
    assert list(pulled(sheet.with_header([]))[2]) == ["#", "name", "birthday", "random_int"]


def test_wide_rows_and_types(book):
    rows = book.sheet("People").with_header().rows(types="infer")
    assert dict(rows.dtypes) == {"row": "int", "#": "bigint", "name": "string", "birthday": "timestamp", "random_int": "bigint"}
    plain = book.sheet("People").set_read_area("B2:C3").rows()
    assert [tuple(r) for r in plain.orderBy("row").collect()] == [(2, "Ada Novak", "-2205187200"), (3, "Lena Marie Ostrom", "6614697600")]
    renamed = book.sheet("People").grid().rows({"A": "row", "B": "who"})
    assert renamed.columns == ["_row", "row", "who", "C", "D"]


def test_duplicate_header_names_keep_the_last(spark):
    b = open_bytes(spark, write_xlsx([SheetSpec("S", {1: ["x", "y", "x"], 2: [1, 2, 3], 3: [4, 5, None]})]))
    assert [tuple(r) for r in b.first_sheet().with_header().rows(types="long").orderBy("row").collect()] == [(2, 3, 2), (3, 4, 5)]


def test_areas(book, spark):
    ragged = book.sheet("Ragged")
    assert ragged.grid().cells().count() == 8
    assert ragged.set_read_area("a:f").cells().count() == 18
    assert ragged.set_read_area("a5:d6").cells().count() == 8
    assert pulled(ragged.grid())[6] == {"A": 6}
    assert pulled(ragged.set_read_area("A:D"))[6] == {"A": 6, "B": None, "C": None, "D": None}
    assert pulled(ragged.set_read_area("B5"))[5] == {"C": "", "D": "  f "}
    assert list(pulled(ragged.grid().limit(2))) == [2, 5]
    assert pulled(book.set_read_area("values"), None) == pulled(book.sheet("Offset").set_read_area("Values"))
    assert pulled(book.set_read_area("Values"))[7]["B"] == "Jonas"
    for bad in (lambda: ragged.set_read_area("no such"), lambda: ragged.from_cell("A1:B2")):
        with pytest.raises((AddressError, ValueError)):
            bad()


def test_string_modes(book):
    ragged = book.sheet("Ragged").from_cell("A5")
    assert pulled(ragged, (), g.TRIM_STRINGS)[5] == {"A": "e", "C": "", "D": "f"}
    assert pulled(ragged, (), g.TRIM_STRINGS | g.TREAT_EMPTY_STRING_AS_EMPTY_CELL)[5] == {"A": "e", "D": "f"}
    bounded = book.sheet("Ragged").set_read_area("A5:D5")
    assert pulled(bounded, (), g.TREAT_EMPTY_STRING_AS_EMPTY_CELL)[5] == {"A": "e", "B": None, "C": None, "D": "  f "}


def test_row_mode(spark):
    b = open_bytes(spark, write_xlsx([SheetSpec("S", {1: ["a"], 2: []}, row_attrs={2: 'ht="33"'})]))
    found = pulled(b.first_sheet().grid(), (), g.RESULT_MODE_ROW)
    assert found[1]["__cells"] == {"A": "a"} and found[2] == {"__cells": {}, "__row": {"r": "2", "ht": "33"}}
    assert list(pulled(b.first_sheet().grid())) == [1]
    assert b.first_sheet().row_height(2) == 33.0 and b.first_sheet().row_height(1) == 15.0


def test_columns_cells_and_first_rows(book):
    turned = {r["col"]: {x["row"]: x["value"] for x in r["values"]} for r in book.sheet("Offset").from_cell("B4").columns().collect()}
    assert turned["B"] == {4: "Name", 5: "Marta", 7: "Jonas"} and turned["D"] == {4: "Color", 5: "Red", 7: "Purple"}
    headed = {r["col"]: [x["row"] for x in r["values"]] for r in book.sheet("People").grid().columns(True).collect()}
    assert headed == {k: [2, 3, 4] for k in ("#", "name", "birthday", "random_int")}
    cells = {r["address"]: r["value"] for r in book.sheet("Offset").grid().cells().collect()}
    assert cells["B2"] == "Title" and cells["D7"] == "Purple" and len(cells) == 10
    assert tuple(book.sheet("Offset").grid().first_row_number().first()) == (2, "B")
    assert tuple(book.sheet("Offset").from_cell("C3").first_row_number().first()) == (4, "C")
    assert [r["address"] for r in book.sheet("Offset").from_cell("B4").first_row_cells().orderBy("col").collect()] == ["B4", "C4", "D4"]
    assert tuple(book.sheet("People").with_header().first_row().first()) == (1, "#", "name", "birthday", "random_int")


def test_verbs_from_a_cell(book):
    sheet = book.sheet("Offset")
    assert sorted(r["Name"] for r in sheet.read_rows_from("B4", True).collect()) == ["Jonas", "Marta"]
    assert {r["col"] for r in sheet.read_columns_from("B4", True).collect()} == {"Name", "Date", "Color"}
    assert sheet.read_cells_from("C5").count() == 4
    assert sheet.read_first_row_from("B5").first()["B"] == "Marta"
    assert [r["address"] for r in sheet.read_first_row_cells_from("B5").orderBy("col").collect()] == ["B5", "C5", "D5"]
    styled = {r["address"]: r["format"]["format-pattern"] for r in sheet.read_first_row_with_styles("B5").collect()}
    assert styled == {"B5": "General", "C5": "yyyy-mm-dd", "D5": "General"}
    assert {r["key"] for r in sheet.read_rows_with_styles_from("B4", True).collect()} == {"Name", "Date", "Color"}
    assert not book.sheet("People").active


def test_cursor_and_callback(book):
    cursor = book.sheet("Offset").from_cell("B4").cursor(True)
    assert cursor.read_next_row()["Name"] == "Marta" and cursor.row_number == 5
    cursor.reset()
    assert cursor.row_number == 5
    assert [cursor.read_next_row()["Name"], cursor.read_next_row()["Name"], cursor.read_next_row()] == ["Marta", "Jonas", None]
    one, two = book.sheet("People").grid().next_row(), book.sheet("People").grid().next_row()
    assert next(one) == next(two) and next(one)[0] == 2 and next(two)[0] == 2
    seen = []
    book.read_callback(lambda row, col, value: seen.append((row, col, value)) or len(seen) == 3)
    assert seen == [(1, "A", "#"), (1, "B", "name"), (1, "C", "birthday")]


def test_typing(spark):
    cells = [Cell(raw="5"), Cell(raw="05"), Cell(raw="0.5"), Cell(raw="1.50"), Cell(raw="1e3"), Cell(raw="5."), Cell(raw="99999999999999999999"), True, Cell(kind="e", raw="#N/A"), Cell(kind="str", raw="12"), Cell(formula="B1", raw=None), Cell(formula='""', kind="str", raw=""), "a_x0041_b", Cell(raw=" 7 "), Cell(raw="-3"), Cell(), Cell(raw="x", style=1), Cell(raw="25569", style=1)]
    b = open_bytes(spark, write_xlsx(BookSpec([SheetSpec("S", {1: cells})], styles=style_sheet(["yyyy-mm-dd"]))))
    row = list(pulled(b.first_sheet().grid())[1].values())
    assert row == [5, "05", 0.5, 1.5, 1000.0, "5.", 1e20, True, "#N/A", 12, "=B1", "", "aAb", 7, -3, None, "x", "25569"]
    kinds = [r["t"] for r in b.first_sheet().grid().cells().orderBy("col").collect()]
    assert kinds[:3] == ["number", "", "number"] and kinds[7:10] == ["bool", "error", "number"] and kinds[12] == "string" and kinds[-2:] == ["date", "date"]


def test_shared_text_under_a_date_style_is_a_date(spark):
    b = open_bytes(spark, write_xlsx(BookSpec([SheetSpec("S", {1: [Cell("3.2", style=1), Cell("1985-12-31 05:21:03", style=1), Cell("text", style=1)]})], styles=style_sheet(["yyyy-mm-dd"]), shared=True)))
    assert list(pulled(b.first_sheet().grid())[1].values()) == [-2208798720, 504854463, "text"]


def test_dates(spark, xlsx):
    def shown(setup, cell="C2"):
        b = open_bytes(spark, xlsx)
        setup(b)
        return pulled(b.sheet("People").set_read_area(f"{cell}:{cell}"))[int(cell[1:])][cell[0]]

    assert shown(lambda b: None) == -2205187200
    assert shown(lambda b: b.date_formatter(None)) == "45"
    assert shown(lambda b: b.date_formatter(False)) == -2205187200
    assert shown(lambda b: b.date_formatter(True)) == "1900-02-14"
    assert shown(lambda b: b.set_date_format("d.m.Y")) == "14.2.1900".replace("14.2", "14.02")
    assert shown(lambda b: b.date_formatter("Y/m/d")) == "1900/02/14"
    assert shown(lambda b: b.date_formatter(lambda seconds, code, style: F.concat(code, F.lit(":"), seconds.cast("string")))) == "yyyy-mm-dd:-2205187200"
    early = write_xlsx(BookSpec([SheetSpec("S", {1: [Cell(0, style=1), Cell(0.5, style=1)]})], styles=style_sheet([14]), date1904=True))
    assert list(pulled(open_bytes(spark, early).first_sheet().grid())[1].values()) == [-2082844800, -2082844800 + 43200]
    builtin = write_xlsx(BookSpec([SheetSpec("S", {1: [Cell(31070, style=k) for k in (1, 2, 3, 4)]})], styles=style_sheet([14, 15, 16, 17])))
    assert list(pulled(open_bytes(spark, builtin).date_formatter(True).first_sheet().grid())[1].values()) == ["01-23-85", "23-Jan-85", "23-Jan", "Jan-85"]
    assert pulled(open_bytes(spark, builtin).use_locale_formats("ru_RU").first_sheet().grid())[1]["A"] == "23.01.1985"
    own = DateMode("pattern", "yyyy")
    assert pulled(open_bytes(spark, builtin).first_sheet().grid().with_dates(own))[1]["A"] == "1985"


def test_formats_agree(spark, tmp_path):
    table = [["ID", "Name", "City"], ["x1", "Alice", "Paris"], ["x2", "Bob", "Rome"]]
    rows = {k: r for k, r in enumerate(table, 1)}
    made = {"a.xlsx": write_xlsx([SheetSpec("S", rows)]), "a.xls": write_xls([XlsSheetSpec("S", rows)]), "a.csv": "\n".join(map(",".join, table)).encode()}
    found = []
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
        b = open_book(spark, str(tmp_path / name))
        found.append(sorted(map(tuple, b.first_sheet().with_header().rows().collect())))
    assert found[0] == found[1] == found[2] == [(2, "x1", "Alice", "Paris"), (3, "x2", "Bob", "Rome")]
    assert pulled(open_csv(spark, str(tmp_path / "a.csv"), delimiter=",").first_sheet().grid())[1] == {"A": "ID", "B": "Name", "C": "City"}
    stream = io.BytesIO(b"skip" + made["a.xlsx"])
    stream.read(4)
    assert open_stream(spark, stream).sheet_names() == ["S"]
    with pytest.raises(SheetError):
        open_bytes(spark, b"")


def test_csv_blank_lines_keep_their_number(spark):
    assert list(pulled(open_bytes(spark, b"a,b\n\n1,2\n", csv={"delimiter": ","}).first_sheet().grid())) == [1, 3]


def test_extents(spark, book):
    assert book.sheet("People").dimension() == "A1:D4"
    assert tuple(book.sheet("Offset").actual_dimension().select("dimension", "count_rows", "count_columns").first()) == ("B2:D7", 6, 3)
    stat = book.sheet("Ragged").stat().first()
    assert (stat["cells_total"], stat["cells_filled"], stat["min_row"], stat["max_row"]) == (8, 8, 2, 6)
    total = {r["sheet"]: r["cells_total"] for r in book.stat().collect()}
    assert total == {"People": 16, "Offset": 10, "Ragged": 8, None: 34}
    empty = open_bytes(spark, write_xlsx([SheetSpec("S", {1: [Cell(style=0)]})]))
    assert empty.first_sheet().stat().first()["cells_filled"] == 0
    none = open_bytes(spark, write_xlsx([SheetSpec("S", {})])).first_sheet()
    assert none.actual_dimension().first()["count_rows"] == 0 and none.grid().rows().collect() == []


def test_merged(book):
    sheet = book.sheet("Offset")
    assert sheet.merged_range(2, 3) == "B2:D2" and not sheet.is_merged(3, 3)
    found = sheet.merged_lookup(sheet.grid().cells().select("address", "row", "col")).where("merged")
    assert [r["address"] for r in found.collect()] == ["B2"]


def test_styles(spark):
    styles = (
        '<numFmts><numFmt numFmtId="164" formatCode="dd.mm.yyyy"/></numFmts><fonts><font><sz val="11"/><name val="Calibri"/></font><font><b/><i/><u val="double"/><color theme="0"/><sz val="14"/></font></fonts>'
        '<fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF9FC63C"/></patternFill></fill></fills>'
        '<borders><border/><border><left style="thick"><color indexed="10"/></left><bottom style="thin"/></border></borders>'
        '<cellStyleXfs><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs>'
        '<cellXfs><xf numFmtId="0" fontId="0" fillId="0" borderId="0" xfId="0"/><xf numFmtId="164" fontId="1" fillId="1" borderId="1" xfId="0"><alignment horizontal="center" wrapText="1"/></xf></cellXfs>'
    )
    theme = '<a:theme xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:themeElements><a:clrScheme name="x"><a:lt1><a:sysClr val="window" lastClr="FFFFFF"/></a:lt1></a:clrScheme></a:themeElements></a:theme>'
    b = open_bytes(spark, write_xlsx(BookSpec([SheetSpec("S", {1: [1, Cell(2, style=1)]})], styles=styles, theme=theme)))
    found = {r["s"]: r for r in b.styles().collect()}
    assert found[0]["font"] == {"font-size": "11", "font-name": "Calibri"} and found[0]["format"]["format-pattern"] == "General"
    assert found[1]["fill"] == {"fill-pattern": "solid", "fill-color": "#9FC63C"}
    assert found[1]["border"] == {"border-left-style": "thick", "border-left-color": "#FF0000", "border-bottom-style": "thin", "border-bottom-color": "#000000"}
    assert found[1]["font"] == {"font-size": "14", "font-name": "Calibri", "font-style-bold": "1", "font-style-italic": "1", "font-style-underline": "2", "font-color": "#202020"}
    assert found[1]["format"] == {"format-num-id": "164", "format-pattern": "dd.mm.yyyy", "format-category": "date", "format-align-horizontal": "center", "format-wrap-text": "1"}
    keyed = {r["address"]: r["style"] for r in b.read_cells_with_styles("fill-color").collect()}
    assert keyed["B1"] == "#9FC63C" and keyed["A1"].startswith("{")
    parts = {r["address"]: r["style"] for r in b.read_cell_styles(part="border").collect()}
    assert parts["A1"] == {} and parts["B1"]["border-left-style"] == "thick"
    flat = {r["address"]: r["style"] for r in b.read_cell_styles(True).collect()}
    assert flat["B1"]["fill-color"] == "#9FC63C" and flat["B1"]["font-size"] == "14"
    rows = {r["key"]: r["fill"] for r in b.read_rows_with_styles().collect()}
    assert rows["B"]["fill-color"] == "#9FC63C"


def test_text_dates(spark):
    cases = {
        "1985-12-31": 504835200, "1985-12-31 05:21": 504854460, "1985-12-31  05.21.03": 504854463, "1985/12/31": 504835200, "12/31/1985": 504835200, "12/31/85": 504835200,
        "31.12.1985": 504835200, "31-12-1985 5:21:03.5": 504854463, "31.12.85": 504835200, "85-12-31": 504835200, "1985-12": 502243200, "1985-02-31": 478656000, "1985-13-01": 0, "31.12.22 5:00": 0, "1985-12-32": 0, "text": 0, "1.2.3.4": 0, "": 0,
    }
    from sheetframe.functions.dates import text_seconds

    got = {r["t"]: r["s"] for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", text_seconds(F.col("t")).alias("s")).collect()}
    assert got == cases
    today = spark.range(1).select(F.unix_date(F.current_date()).alias("d"), text_seconds(F.lit("5:21")).alias("clock"), text_seconds(F.lit("12/31")).alias("day"), F.unix_date(F.make_date(F.year(F.current_date()), F.lit(12), F.lit(31))).alias("last")).first()
    assert (today["clock"], today["day"]) == (today["d"] * 86400 + 19260, today["last"] * 86400)


def test_locales(spark):
    from sheetframe.functions.dates import locale_codes

    assert [locale_codes(spark, name)["mm-dd-yy"] for name in ("ru_RU", "de_DE", "en_US", "fr_FR", "pl_PL", "ja_JP")] == ["dd.MM.yyyy", "dd.MM.yy", "M/d/yy", "dd/MM/yyyy", "dd.MM.yyyy", "yyyy/MM/dd"]
    assert locale_codes(spark, "de_DE")["d-mmm-yy"] == "d.MMM.yy" and locale_codes(spark, "de_DE")["h:mm"] == "H:mm"
    with pytest.raises(ValueError, match="no formats"):
        locale_codes(spark, "zz_ZZ")
    codes = spark.range(1).select(*(F.date_format(F.timestamp_seconds(F.lit(504854463)), p).alias(f"{name}{k}") for name in ("sv_SE", "en_US", "ar_EG", "zh_TW", "fr_CA", "hi_IN") for k, p in enumerate(locale_codes(spark, name).values())))
    assert all(codes.first())


def test_turned_rows(book):
    grid = book.sheet("Offset").from_cell("B4")
    turned = {r["col"]: [tuple(x) for x in r["values"]] for r in grid.rows(mode=g.KEYS_SWAP | g.KEYS_ROW_ZERO_BASED | g.KEYS_COL_ONE_BASED).collect()}
    assert turned == {"1": [(0, "Name"), (1, "Marta"), (3, "Jonas")], "2": [(0, "Date"), (1, "18316800"), (3, "-132883200")], "3": [(0, "Color"), (1, "Red"), (3, "Purple")]}
    headed = {r["col"]: len(r["values"]) for r in grid.rows(mode=g.KEYS_SWAP | g.KEYS_FIRST_ROW).collect()}
    assert headed == {"Name": 2, "Date": 2, "Color": 2}
    assert grid.long_rows().count() == 9


def test_a_book_of_files(spark):
    """Headers in another order, in another row, with other names; sheets under other ids; styles of their own."""
    one = write_xlsx(BookSpec([SheetSpec("Data", {1: ["id", "name"], 2: [1, "a"], 3: [2, "b"]})], styles=style_sheet(["0.00"])))
    two = write_xlsx(BookSpec([SheetSpec("Other", {1: ["x"]}), SheetSpec("data", {4: ["name", "id", "more"], 5: ["c", 3, "m"], 6: ["d", Cell(4, style=1), None]}, merges=["A5:B5"])], styles=style_sheet(["yyyy"])))
    three = b"id,name\n5,e\n"
    from sheetframe.plans.book import Book
    from sheetframe.sources.workbook import bytes_frame

    b = Book(spark, bytes_frame(spark, {"one": one, "two": two, "three": three}))
    assert sorted(b.sheet_names()) == ["CSV", "Data", "Other"]
    rows = b.sheet("DATA").with_header().rows(types="infer", book_name="book", mode=g.KEYS_ROW_ONE_BASED)
    assert rows.columns == ["book", "row", "id", "name", "more"] and dict(rows.dtypes)["id"] == "bigint" and dict(rows.dtypes)["name"] == "string"
    rows = b.sheet("DATA").with_header().rows(types={"id": "long"}, book_name="book", mode=g.KEYS_ROW_ONE_BASED)
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([("one", 1, 1, "a", None), ("one", 2, 2, "b", None), ("two", 1, 3, "c", "m"), ("two", 2, -2208729600, "d", None)], key=str)
    firsts = b.first_sheet().grid().first_row_number(book_name="book").collect()
    assert sorted(map(tuple, firsts)) == [("one", 1, "A"), ("three", 1, "A"), ("two", 1, "A")]
    assert {r["book"]: r["dimension"] for r in b.sheet("data").actual_dimension(("book",)).collect()} == {"one": "A1:B3", "two": "A4:C6"}
    assert [r["book"] for r in b.sheet("Data").merged_cells().collect()] == ["two"]
    found = b.sheet("Data").merged_lookup(b.sheet("Data").grid().cells(book_name="book").select("book", "row", "col")).where("merged").collect()
    assert sorted(map(tuple, found)) == [("two", 5, 1, True, "A5:B5"), ("two", 5, 2, True, "A5:B5")]
    patterns = {(r["book"], r["s"]): r["format"]["format-pattern"] for r in b.styles().collect()}
    assert patterns == {("one", 0): "General", ("one", 1): "0.00", ("two", 0): "General", ("two", 1): "yyyy"}
    assert dict(b.sheet("Data").grid().columns(True, book_name="book").groupBy("book").count().collect()) == {"one": 2, "two": 3}
    pulled_rows = list(b.sheet("Data").with_header().next_row())
    assert [(k, list(r)) for k, r in pulled_rows] == [(2, ["id", "name"]), (3, ["id", "name"]), (5, ["name", "id", "more"]), (6, ["name", "id"])]


def test_split_text_equals_the_reader(spark, tmp_path):
    """Files cut into splits of a few bytes: quoted line ends over many splits, carriage returns, comments, empty lines."""
    import random

    from sheetframe.plans.book import split_csv
    from sheetframe.sources.delimited import DelimitedReader
    from sheetframe.sources.split_text import split_records

    rng = random.Random(6)
    want = {}
    options = {"delimiter": ",", "encoding": "UTF-8", "comment_prefix": "#", "mode": "tolerant"}
    for n in range(6):
        fields = ["", "a", "é", "x y", '"q, ""r"" "', '"two\nlines"', '"' + "many\r\nlines,\n" * 30 + '"', 'st"ray', "\r"]
        ends = ["\n", "\r\n", "\n\n", "\n#no,\n"]
        text = ("\ufeff" if n % 2 else "") + "".join(",".join(rng.choice(fields[: 8 + n // 5]) for _ in range(rng.randrange(1, 5))) + rng.choice(ends) for _ in range(40))
        (tmp_path / f"{n}.csv").write_bytes(text.encode())
        want[f"{n}.csv"] = list(DelimitedReader(text.encode(), options).records())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for size in (97, 1000, 1 << 20):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        try:
            got = {}
            for r in split_records(spark, str(tmp_path), options).collect():
                got.setdefault(r["book"].rsplit("/", 1)[1], []).append((r["row"], r["fields"]))
            assert {k: sorted(v) for k, v in got.items()} == {k: [(a, list(b)) for a, b in v] for k, v in want.items()}
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "t.csv").write_bytes(b"id;name\n1;a\n2;b\n")
    rows = split_csv(spark, str(tmp_path / "sub")).with_header().rows(types="infer")
    assert rows.columns == ["row", "id", "name"] and sorted(map(tuple, rows.collect())) == [(2, "1", "a"), (3, "2", "b")]
    assert split_csv(spark, str(tmp_path / "sub")).limit(1).cells().count() == 2


def test_sheet_state_and_image_paths(spark, tmp_path):
    b = open_bytes(spark, write_xlsx([SheetSpec("S", {1: ["x"]}, images=[(2, 3, "image1.png", b"\x89PNG")])]))
    s = b.first_sheet()
    assert s.visible and s.set_state("hidden").hidden and s.state == "hidden"
    assert s.image_path(2, 3) == "bytes#xl/media/image1.png" and s.image_path(1, 1) is None
    assert s.save_image_to(2, 3, str(tmp_path)) == str(tmp_path / "image1.png") and s.save_image_to(9, 9, str(tmp_path)) is None
    assert b.read_columns_with_styles().count() == 1


def test_range_stats_of_columns(spark):
    from sheetframe.functions.addressing import range_stats, range_stats_expr

    texts = ["A1:D4", "$B$2:$XFD$1048576", "C7", "", "x", "A:B", None, "aa1:ab2"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", range_stats_expr(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["s"].asDict() for r in got} == {t: range_stats(t or "") for t in texts}


def test_numbered_rows(spark):
    from sheetframe.operators.grid import numbered

    for n, parts in ((0, 4), (3, 4), (5000, 7)):
        df = spark.range(n).select((F.col("id") * 37 % max(n, 1)).alias("a"), F.lit("x").alias("b")).repartition(5)
        for order in (["a"], ["b", "a"]):
            got = sorted((r["a"], r["row"]) for r in numbered(df, order, parts=parts).collect())
            assert got == [(k, k + 1) for k in range(n)]


def test_overlapping_merges(spark):
    from sheetframe.operators.merged import merged_lookup

    cells = spark.createDataFrame([(r, c) for r in (1, 2, 300, 700) for c in (1, 2)] + [(1, 1)], "row int, col int")
    ranges = spark.createDataFrame([(1, 1, 600, 1, "A1:A600", 1), (1, 1, 2, 2, "A1:B2", 0)], "row1 int, col1 int, row2 int, col2 int, ref string, position int")
    got = sorted((r["row"], r["col"], r["range"] or "") for r in merged_lookup(cells, ranges).collect())
    assert got == [(1, 1, "A1:B2"), (1, 1, "A1:B2"), (1, 2, "A1:B2"), (2, 1, "A1:B2"), (2, 2, "A1:B2"), (300, 1, "A1:A600"), (300, 2, ""), (700, 1, ""), (700, 2, "")]


def test_xls_styles_and_dates(spark):
    content = write_xls([XlsSheetSpec("S", {1: [XlsCell(45, style=1), XlsCell(1234.5, style=2), XlsCell(43, style=3)]})], {52: "dd.mm.yyyy", 57: '#,##0.00" pcs"', 58: "000"}, [0, 52, 57, 58])
    b = open_bytes(spark, content)
    assert list(pulled(b.first_sheet().grid())[1].values()) == [-2205187200, 1234.5, 43]
    assert pulled(b.date_formatter(True).first_sheet().grid())[1]["A"] == "14.02.1900"
    assert b.styles().where("s = 17").first()["format"]["format-pattern"] == '#,##0.00" pcs"'


def test_images(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\nrest"
    spec = BookSpec([SheetSpec("S", {1: ["x"]}, images=[(2, 3, "image1.png", png)])], parts={"xl/media/extra.png": png})
    b = open_bytes(spark, write_xlsx(spec))
    sheet = b.first_sheet()
    assert sheet.count_images() == b.count_images() == 1 and sheet.has_images()
    assert sheet.image(2, 3)["mime"] == "image/png" and sheet.image(1, 1) is None
    assert sheet.save_image(2, 3, str(tmp_path / "out.png")) and (tmp_path / "out.png").read_bytes() == png
    assert [r["part"] for r in b.extra_images().collect()] == ["xl/media/extra.png"]


def test_metadata_relations(spark):
    before = '<sheetPr><tabColor theme="2" tint="-0.5"/></sheetPr><sheetViews><sheetView><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><cols><col min="1" max="2" width="11.5"/></cols>'
    after = '<dataValidations><dataValidation type="list" sqref="A1"><formula1>"a,b"</formula1></dataValidation></dataValidations><conditionalFormatting sqref="A1"><cfRule type="cellIs" priority="1"/></conditionalFormatting>'
    b = open_bytes(spark, write_xlsx(BookSpec([SheetSpec("S", {1: ["a", "b"]}, before=before, after=after, links=[("A1", "https://x.example/", None)])], properties="<Application>Me</Application>")))
    s = b.first_sheet()
    assert s.column_width(2) == 11.5 and s.column_width(3) is None
    assert s.data_validations().first()["formula1"] == '"a,b"'
    assert s.conditional_formatting().first()["attributes"] == {"priority": "1"}
    assert s.hyperlinks().first()["link"] == "https://x.example/"
    view = s.sheet_view().first()
    assert (view["y_split"], view["top_left"], view["tab_theme"], view["tab_tint"]) == (1, "A2", 2, -0.5)
    assert b.properties() == {"application": "Me"} and b.validate().where("not ok").count() == 0
    assert b.entries().where("entry = 'xl/workbook.xml'").count() == 1
    assert s.column_attributes().count() == 2 and s.column_styles().count() >= 0 and s.row_attributes().count() == 1


def test_data_source(spark, xlsx, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(xlsx)
    register(spark)
    read = lambda **o: spark.read.format("workbook").options(**o).load(str(tmp_path / "b.xlsx"))
    assert read().count() == 16
    assert read(sheet="*").rdd.getNumPartitions() == 3
    assert read(sheet="offset", area="B5:C7").select("raw").where("raw is not null").count() == 4
    assert [r["sheet"] for r in read(part="sheets").orderBy("position").collect()] == ["People", "Offset", "Ragged"]
    assert read(part="merged_cells").first()["ref"] == "B2:D2"


def test_stream(spark, xlsx, tmp_path):
    from sheetframe.streaming.arrivals import stream_cells, stream_stat

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.xlsx").write_bytes(xlsx)
    run = stream_stat(stream_cells(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        run.processAllAvailable()
        (folder / "two.csv").write_bytes(b"a,b\n1,2\n3,4\n")
        run.processAllAvailable()
        assert sorted(r["cells_total"] for r in spark.table("arrivals").collect()) == [6, 16]
    finally:
        run.stop()


def test_large_sheet_streams(spark):
    rows = {k: [k, f"name{k}", f"city{k}"] for k in range(1, 20_001)}
    from sheetframe.sources.ooxml import XlsxBook

    book = XlsxBook(write_xlsx([SheetSpec("S", rows)]))
    began = time.time()
    assert len(list(book.sheets[0].rows(row_limit=10))) == 10
    assert time.time() - began < 1.0
    assert sum(len(c) for _, _, c in book.sheets[0].rows()) == 60_000


def _raw_cells(rows):
    schema = "array<struct<col:int,t:string,s:int,raw:string,f:string,text:string,fmt:string,code:string,base1904:boolean>>"
    return rows.select(F.array(F.struct(F.lit(1), F.lit("n"), F.lit(0), F.col("raw"), *[F.lit(None).cast("string")] * 2, F.lit(""), F.lit(""), F.lit(False))).cast(schema).alias("cells"))


def test_a_cell_is_typed_once(spark):
    """Patterns of numbers stand in the plan once for each branch that asks for them, of dates once."""
    from sheetframe.functions.typing_rules import typed_cell

    raw = _raw_cells(spark.createDataFrame([("12",), (" -3 ",), ("1.5",), ("007",), ("x",), (None,)], "raw string"))
    typed = raw.select(F.transform("cells", lambda c: typed_cell(c))[0].alias("c"))
    assert [(r["c"]["i"], r["c"]["d"], r["c"]["x"]) for r in typed.collect()] == [(12, None, None), (-3, None, None), (None, 1.5, None), (None, None, "007"), (None, None, "x"), (None, None, None)]
    plan = typed._jdf.queryExecution().analyzed().toString()
    assert plan.upper().count("RLIKE") <= 6 and plan.lower().count("translate(") == 1


def test_a_cell_of_wide_rows_is_looked_up_once(spark):
    """However often casts name a cell, the plan types the cells of a row in one place."""
    from sheetframe.operators.grid import Grid

    rows = _raw_cells(spark.createDataFrame([("12",)], "raw string")).select(F.lit("").alias("book"), *(F.lit(1).alias(n) for n in ("row", "first_row", "first_col")), F.lit(0).cast("long").alias("head"), F.create_map().cast("map<string,string>").alias("attrs"), "cells")
    found = Grid(lambda area, limit, mode: rows).set_read_area("A:B").rows(types={"A": "double", "B": "double"})
    assert [tuple(r) for r in found.collect()] == [(1, 12.0, None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("translate(") == 1


@pytest.mark.parametrize("area, first", [("A5", 5), ("A:B", 1)])
def test_a_table_has_more_rows_than_a_sheet(spark, area, first):
    from sheetframe.operators.extents import stat
    from sheetframe.operators.grid import Grid, table_scan

    n = 1_048_576 + 7
    grid = Grid(table_scan(spark.range(n).select("id", F.lit("x").alias("name")), ["id"])).set_read_area(area)
    last = grid.rows(None, types={"A": "long"}).agg(F.count("*").alias("n"), F.max("row").alias("row"), F.max("A").alias("a")).first()
    assert tuple(last) == (n - first + 1, n, n - 1)
    assert stat(grid.cell_relation()).first()["cells_total"] == 2 * (n - first + 1)


def test_columns_of_a_table_are_known_without_reading(spark):
    from sheetframe.operators.grid import Grid

    def scan(area, row_limit, row_mode):
        raise AssertionError("read")

    scan.columns = lambda area: [2, 3]
    assert Grid(scan).layout().columns == {None: [(2, "B"), (3, "C")]}
    assert Grid(scan).layout(mode=g.KEYS_COL_ZERO_BASED).columns == {None: [(1, 0), (2, 1)]}


def test_workbooks_are_dealt_out_to_many_tasks(spark):
    """By their bytes, the rows of a table that become files would go to a task or two."""
    from sheetframe.queries import as_files

    files = as_files(spark.range(640), "id", lambda rows: str(len(rows)).encode(), 10)
    assert files.rdd.getNumPartitions() == 8 * spark.sparkContext.defaultParallelism
    assert sorted((r["path"], bytes(r["content"])) for r in files.collect()) == sorted((f"bucket-{k}", b"10") for k in range(64))
    files.unpersist()
