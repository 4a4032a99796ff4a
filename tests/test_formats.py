"""Parsers and scalar rules without Spark."""

import io
import struct
import zipfile

import pytest

from sheetframe.functions import addressing as a
from sheetframe.functions.dates import format_category, is_date_format, is_number_format, letters_pattern, spark_pattern
from sheetframe.functions.typing_rules import unescape
from sheetframe.sources import escher
from sheetframe.sources.biff import XlsBook, decode_rk, shared_strings
from sheetframe.sources.delimited import DelimitedError, DelimitedOptions, DelimitedReader, RecordParser
from sheetframe.sources.formula import decompile
from sheetframe.sources.ole import OleError, OleFile
from sheetframe.sources.ooxml import SheetError, XlsxBook, shift_formula, tinted
from sheetframe.sources.sniff import detect_bom, detect_delimiter, detect_encoding, looks_binary
from sheetframe.sources.workbook import ScanOptions, open_content
from sheetframe.testing.xls_writer import XlsCell, XlsSheetSpec, record, sst_records, write_xls
from sheetframe.testing.xlsx_writer import BookSpec, Cell, SheetSpec, style_sheet, write_xlsx


def test_letters_round_trip():
    assert [a.col_letter(n) for n in (1, 26, 27, 52, 702, 703, 16384)] == ["A", "Z", "AA", "AZ", "ZZ", "AAA", "XFD"]
    assert all(a.col_number(a.col_letter(n)) == n for n in range(1, 16385))
    assert a.col_number("XFE") == a.col_number("A1") == 0


def test_areas():
    assert a.parse_area("B2") == a.Area(2, a.MAX_ROW, 2, a.MAX_COL, False)
    assert a.parse_area("$b$4:$D$11") == a.Area(4, 11, 2, 4, True)
    assert a.parse_area("C:E").columns == [3, 4, 5]
    assert a.parse_area("C") == a.Area(1, a.MAX_ROW, 3, a.MAX_COL, False)
    for bad in ("", "1A", "A1:B", "A0", "Sheet1!A1", "ZZZZ1"):
        with pytest.raises(a.AddressError):
            a.parse_area(bad)
    assert a.range_stats("A1:D4") == {"count_rows": 4, "count_columns": 4, "min_row": 1, "max_row": 4, "min_column": 1, "max_column": 4}
    assert a.range_stats("")["count_rows"] == 0
    assert a.split_sheet_ref("'It''s'!$A$1:$B$2") == ("It's", "$A$1:$B$2")


def test_number_format_categories():
    assert [format_category("", k) for k in (0, 1, 14, 22, 27, 49, 50, 100)] == ["", "number", "date", "date", "date", "string", "date", ""]
    assert format_category("000", 51) == "number"
    assert format_category("dd\\.mm\\.yyyy", 52) == "date"
    assert format_category("[$-419]d mmm", 164) == "date"
    assert format_category('#,##0.00" pcs"', 57) == ""
    assert format_category("@", 164) == "" and format_category("@", 164, True) == "string"


def test_date_and_number_formats():
    dates = ["yy", "mm:ss", "h", "dd", "d/m", "d.m.", "d\\.m", "[h]", "[mm]:ss", "[$-409]general", "[$-FC19]0", "0 AM/PM", "[Red]yyyy", "MM", 'd"/"m/d']
    others = ["", "0", "0.00", "General", "@", "#,##0", "[Red]0", '"days"0', '0" h"', "[$-409]", "[$€-407] 0", "d-m", "m", "s", "\\h0", "# ?/?"]
    assert [c for c in dates if not is_date_format(c)] == [] and [c for c in others if is_date_format(c)] == []
    assert [is_number_format(c) for c in ("0", "000", "0.00", "0.", "", ".0", "#0", "0.0.0", "0%")] == [True, True, True, False, False, False, False, False, False]


def test_date_patterns():
    cases = {"mm-dd-yy": "MM-dd-yy", "d-mmm-yy": "d-MMM-yy", "h:mm AM/PM": "h:mm a", "h:mm:ss": "H:mm:ss", "mm:ss": "mm:ss", "m/d/yy h:mm": "M/d/yy H:mm", "[$-419]dd\\.mm\\.yyyy;@": "dd.MM.yyyy", "dddd, mmmm d": "EEEE, MMMM d", "[h]:mm:ss": "H:mm:ss", "yyyy-mm-dd hh:mm": "yyyy-MM-dd HH:mm"}
    assert {c: spark_pattern(c) for c in cases} == cases
    assert spark_pattern("0.00") is None
    assert letters_pattern("Y-m-d H:i:s") == "yyyy-MM-dd HH:mm:ss"


def test_unescape():
    assert unescape("line 1_x000D_line 2") == "line 1\rline 2"
    assert unescape("_x0000__x001F__x007F_") == "\0\x1f\x7f"
    assert [unescape(t) for t in ("_x0041_", "_x005F_x000D_", "_x005F_x005F_x0041_", "_x005F_x0041__x000D_")] == ["A", "_x000D_", "_x005F_x0041_", "_x0041_\r"]


# Delimited text

RECORDS = [
    ("a,b,c\n", ["a", "b", "c"], True),
    ("a,,c\n", ["a", "", "c"], True),
    (",b,\n", ["", "b", ""], True),
    ('"a","b","c"\n', ["a", "b", "c"], True),
    ('"a,b",c\n', ["a,b", "c"], True),
    ('"a""b",c\n', ['a"b', "c"], True),
    ('1,"line1\nline2",X\n', ["1", "line1\nline2", "X"], True),
    ('1,"line1\nline2,X', ["1", "line1\nline2,X"], False),
    ('"ok" ,X\n', ["ok", "X"], True),
    ('"ok"zzz,X\n', ["okzzz", "X"], False),
    ('a"b"c,X\n', ['a"b"c', "X"], False),
    ('a""b,X\n', ['a""b', "X"], False),
    ('"abc,X\n', ["abc,X\n"], False),
    ('"""",X\n', ['"', "X"], True),
    ('"""""",X\n', ['""', "X"], True),
    ("a,b\n", ["a", "b"], True),
    ("\n", [], True),
    ("a,b,c\r\n", ["a", "b", "c"], True),
    ("a,b,c\r", ["a", "b", "c"], True),
    ('"x"', ["x"], True),
    (" a , b \n", ["a", "b"], True),
    ("a, b ", ["a", " b "], True),
]


@pytest.mark.parametrize(("text", "fields", "strict_ok"), RECORDS)
@pytest.mark.parametrize("step", [1, 2, 1000])
def test_records(text, fields, strict_ok, step):
    chunks = [text[k : k + step] for k in range(0, len(text), step)]
    tolerant = RecordParser(DelimitedOptions(strict=False, delimiter=","))
    assert [f for _, _, f in tolerant.records(chunks)] == [fields]
    strict = RecordParser(DelimitedOptions(delimiter=","))
    if strict_ok:
        assert [f for _, _, f in strict.records(chunks)] == [fields]
    else:
        with pytest.raises(DelimitedError):
            list(strict.records(chunks))


def test_errors_can_be_collected():
    found = []
    reader = DelimitedReader(b'a,b\nx"y,1\n"z"q,2\n', {"delimiter": ","}, found.append)
    assert [f for _, f in reader.records()] == [["a", "b"], ["x", "1"], ["z", "2"]]
    assert [(e.code, e.record) for e in found] == [(1001, 2), (1003, 3)]


def test_escape_comment_empty_lines_and_ends():
    text = b'a\\,b,c\r\n\r\n# no\r1,"x\\"y"\n2,3'
    reader = DelimitedReader(text, {"delimiter": ",", "escape": "\\", "commentPrefix": "#", "mode": "tolerant"})
    assert list(reader.records()) == [(1, ["a,b", "c"]), (2, []), (4, ["1", 'x"y']), (5, ["2", "3"])]
    reader = DelimitedReader(text, {"delimiter": ",", "escape": "\\", "comment_prefix": "#", "skip_empty_lines": True})
    assert [n for n, _ in reader.records()] == [1, 4, 5]


def test_engine_keys():
    data = b"Name,Age,City\nJohn,30,New York\nJane,25,London\n"
    make = lambda: DelimitedReader(data, {"delimiter": ","})
    assert dict(make().rows())[2] == {0: "John", 1: "30", 2: "New York"}
    assert list(make().rows(True)) == [(2, {"Name": "John", "Age": "30", "City": "New York"}), (3, {"Name": "Jane", "Age": "25", "City": "London"})]
    assert next(make().rows(None, 128)) == (1, {"A": "Name", "B": "Age", "C": "City"})
    assert next(make().rows(None, 8 | 16)) == (2, {1: "Name", 2: "Age", 3: "City"})
    assert next(make().rows(None, 2))[0] == 0
    assert next(make().with_header(["n"]).rows())[1] == {"n": "John", "Age": "30", "City": "New York"}
    assert list(make().from_row(3).from_col(2).rows()) == [(3, {0: "25", 1: "London"})]
    assert list(make().from_row(2).with_header().rows())[0] == (2, {0: "John", 1: "30", 2: "New York"})
    assert len(list(make().rows(True, 0, 1))) == 1
    ragged = DelimitedReader(b"a,b\nc,d,e\n", {"delimiter": ","})
    assert list(ragged.rows()) == [(1, {0: "a", 1: "b"}), (2, {0: "c", 1: "d", 2: "e"})]


RUSSIAN = "Номер,Название,Город,Примечание\r\n1,Привет,Москва,столица нашей страны\r\n2,Санкт-Петербург,Нева,город на реке\r\n"
JAPANESE = "番号,名前,都市,備考\r\n1,田中さん,東京,これは日本の首都です\r\n2,すずき,大阪,たこやきがおいしい\r\n"


@pytest.mark.parametrize(("text", "codec"), [(RUSSIAN, c) for c in ("utf-8", "cp1251", "koi8-r", "cp866", "iso8859-5")] + [(JAPANESE, c) for c in ("utf-8", "cp932", "euc-jp", "shift_jis")] + [("id,name\r\n1,Müller\r\n2,Café crème\r\n", "latin-1")])
def test_encodings_are_found(text, codec):
    reader = DelimitedReader(text.encode(codec))
    assert [f for _, f in reader.records()] == [line.split(",") for line in text.strip().split("\r\n")]


@pytest.mark.parametrize(("mark", "codec"), [(b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe\0\0", "utf-32-le"), (b"\0\0\xfe\xff", "utf-32-be")])
def test_byte_order_marks(mark, codec):
    data = mark + "имя,b\r\n1,2\r\n3,4\r\n".encode(codec)
    assert detect_bom(data).lower().replace("-", "") in codec.replace("-", "").replace("utf8", "utf8")
    assert [f for _, f in DelimitedReader(data).records()] == [["имя", "b"], ["1", "2"], ["3", "4"]]


@pytest.mark.parametrize("codec", ["Windows-1250", "ISO-8859-2", "Windows-1254", "Windows-1256", "GB18030", "CP932"])
def test_named_encodings(codec):
    text = {"Windows-1256": "سلام,x\n", "GB18030": "你好,x\n", "CP932": "髙橋,x\n"}.get(codec, "Üç,x\n")
    data = text.encode("cp932" if codec == "CP932" else codec)
    assert [f for _, f in DelimitedReader(data, {"encoding": codec, "delimiter": ","}).records()] == [text.strip().split(",")]
    with pytest.raises(DelimitedError):
        DelimitedReader(data, {"encoding": "no-such"})


def test_delimiters():
    assert detect_delimiter("a;b\n1;2,5\n2;3,5\n3;4,5\n")[0] == ";"
    assert detect_delimiter("a\tb\n1\t2\n2\t3\n")[0] == "\t"
    assert detect_delimiter('a|b|c\n1|"x|y"|2\n2|3|4\n3|4|5\n')[0] == "|"
    assert detect_delimiter("a;b\n1;2\n") == (";", 0.0)
    assert detect_delimiter("plain\ntext\nonly\n") == (",", 0.0)
    assert DelimitedReader(b"ID;Name;City\n").options.delimiter == ","  # too short to tell


@pytest.mark.parametrize("mark", [",", ";", "\t", "|", ":"])
def test_delimiters_of_tables(mark):
    """Ragged rows, line ends in quotes, prose with commas, decimal commas, times and URLs beside the true delimiter."""
    other = "; " if mark == "," else ", "
    rows = [["id", "note", "when"], ["1", f'"one{mark} two\nthree{mark}"', "ten"], ["2", f"plain{other}prose", "six"], ["3", "", "two", "more"], ["4", "text", "one"], ["5", "x", "y"]]
    text = "\r\n".join(mark.join(r) for r in rows)
    assert detect_delimiter(text)[0] == mark and detect_delimiter(text)[1] >= 0.6
    if mark not in ",:":
        assert detect_delimiter("\n".join(f"{k},5{mark}1{k}:30{mark}http://h{k}/" for k in range(5)))[0] == mark
    assert DelimitedReader(text.encode()).options.delimiter == mark


def test_prose_has_no_delimiter():
    text = "One line here.\nAnother, with a comma, or two, or three.\nNone here: just this.\nAnd the end.\nOf it all\n"
    assert detect_delimiter(text)[1] < 0.6


def test_stream_filters_and_raw_rows():
    import base64
    import zlib

    plain = b"a,b\n\n#no\n1,2\n"
    raw = zlib.compressobj(wbits=-15)
    for data, name in ((raw.compress(plain) + raw.flush(), "zlib.inflate"), (base64.b64encode(plain), "convert.base64-decode"), (plain[::-1], lambda d: d[::-1]), (plain.decode().encode("utf-16-le"), "convert.iconv.UTF-16LE/UTF-8")):
        reader = DelimitedReader(data, {"delimiter": ",", "streamFilter": name, "comment_prefix": "#", "skip_empty_lines": True})
        assert [(reader.next_raw_row(), reader.line_no) for _ in range(3)] == [(["a", "b"], 1), (["1", "2"], 4), (None, 4)]
        assert reader.next_raw_row() == ["a", "b"]
    with pytest.raises(DelimitedError):
        DelimitedReader(plain, {"stream_filter": "no.such"})


def test_well_formed_records_take_the_short_way():
    """The pattern for well-formed records and the character by character scan agree."""
    import random

    rng = random.Random(4)
    for _ in range(4000):
        body = "".join(rng.choice(['"', '""', ",", "a", " ", "b c", "\t", "'"]) for _ in range(rng.randrange(1, 12)))
        for trim in (True, False):
            parser = RecordParser(DelimitedOptions(strict=False, delimiter=",", trim_fields=trim))
            for at_end in (True, False):
                short = parser._well_formed(body, at_end)
                if short is not None:
                    strict = RecordParser(DelimitedOptions(delimiter=",", trim_fields=trim))
                    assert (short, False) == strict._scan(body, True, at_end) and not strict.errors, body


def test_binary_is_rejected():
    assert looks_binary(b"ab\0c") and looks_binary(bytes(range(1, 9))) and not looks_binary("é\t\n".encode())
    with pytest.raises(DelimitedError):
        DelimitedReader(b"\x89PNG\r\n\x1a\n\0\0")
    assert detect_encoding(b"") == "UTF-8"
    with pytest.raises(SheetError):
        open_content(b"")


# XLSX


def book(**kw):
    rows = {1: ["#", "name", "birthday", "random_int"], 2: [1, "Ada Novak", Cell(45, style=1), 4573], 3: [2, "Lena Marie Ostrom", Cell(102128, style=1), 982630], 5: []}
    return BookSpec([SheetSpec("Sheet1", rows, merges=["A1:B1"]), SheetSpec("Other", {1: ["x"]}, state="hidden", sheet_id=7)], styles=style_sheet(["dd.mm.yyyy"]), names={"Head": "Sheet1!$A$1:$D$1"}, **kw)


@pytest.mark.parametrize("shared", [True, False])
def test_xlsx_catalogue_and_rows(shared):
    b = XlsxBook(write_xlsx(book(shared=shared)))
    assert [(s.name, s.id, s.state, s.dimension) for s in b.sheets] == [("Sheet1", 1, "visible", "A1:D5"), ("Other", 7, "hidden", "A1:A1")]
    assert b.defined_names == {"Head": "Sheet1!$A$1:$D$1"}
    rows = list(b.sheets[0].rows())
    assert [r for r, _, _ in rows] == [1, 2, 3]
    assert [c["raw"] if c["text"] is None else c["text"] for c in rows[1][2]] == ["1", "Ada Novak", "45", "4573"]
    assert [r for r, _, _ in b.sheets[0].rows(row_mode=True)] == [1, 2, 3, 5]
    assert [c["col"] for _, _, cells in b.sheets[0].rows(a.parse_area("B2:C2")) for c in cells] == [2, 3]
    assert len(list(b.sheets[0].rows(row_limit=2))) == 2
    assert b.sheets[0].merged_cells() == ["A1:B1"]


def test_xlsx_prefixed_and_absolute():
    prefixed = write_xlsx(BookSpec([SheetSpec("S", {1: [1, 2]})], prefix="x:"))
    assert list(XlsxBook(prefixed).sheets[0].rows()) == []
    assert [c["raw"] for _, _, cells in XlsxBook(prefixed, True).sheets[0].rows() for c in cells] == ["1", "2"]
    assert len(list(XlsxBook(write_xlsx(book(absolute=True))).sheets[0].rows())) == 3


def test_xlsx_metadata():
    before = '<sheetPr><tabColor theme="2" tint="-0.5"/></sheetPr><sheetViews><sheetView tabSelected="1"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><cols><col min="2" max="3" width="11.5" style="1"/></cols>'
    after = '<dataValidations><dataValidation type="decimal" sqref="G2:G5"><formula1>0</formula1><formula2>9</formula2></dataValidation></dataValidations><conditionalFormatting sqref="A1:A3"><cfRule type="cellIs" operator="greaterThan" priority="1"/></conditionalFormatting><extLst><ext><x14:dataValidation xmlns:x14="u" type="list"><x14:formula1><f>S!$A$1</f></x14:formula1><sqref>E2</sqref></x14:dataValidation></ext></extLst>'
    spec = SheetSpec("S", {1: ["a"], 2: ["b"]}, before=before, after=after, links=[("A1", "https://x.example/", None), ("A2", None, "S!A1")], row_attrs={2: 'ht="35.25"'})
    sheet = XlsxBook(write_xlsx([spec])).sheets[0]
    assert sheet.tab_color() == {"theme": "2", "tint": "-0.5"}
    assert sheet.freeze_pane() == {"x_split": 0, "y_split": 1, "top_left": "A2"}
    assert [(c["col"], c["width"], c["style"]) for c in sheet.columns()] == [(2, 11.5, 1), (3, 11.5, 1)]
    assert [(v["type"], v["sqref"], v["formula1"], v["formula2"]) for v in sheet.validations()] == [("decimal", "G2:G5", "0", "9"), ("list", "E2", "S!$A$1", None)]
    assert sheet.conditional_formats() == [{"type": "cellIs", "sqref": "A1:A3", "attributes": {"operator": "greaterThan", "priority": "1"}}]
    assert [(h["ref"], h["link"], h["location"]) for h in sheet.hyperlinks()] == [("A1", "https://x.example/", None), ("A2", None, "S!A1")]
    assert sheet.active and sheet.default_height == 15.0


def test_xlsx_images_and_media():
    png = b"\x89PNG\r\n\x1a\nrest"
    b = XlsxBook(write_xlsx([SheetSpec("S", {1: ["x"]}, images=[(2, 3, "image1.png", png), (4, 1, "image1.png", png)])]))
    assert [(i["row"], i["col"], i["file_name"], i["mime"], i["content"]) for i in b.sheets[0].images()] == [(2, 3, "image1.png", "image/png", png), (4, 1, "image1.png", "image/png", png)]
    assert b.media() == ["xl/media/image1.png"]


def test_xlsx_rejects():
    with pytest.raises(SheetError):
        XlsxBook(b"PK\x03\x04junk")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<x/>")
    with pytest.raises(SheetError, match="DOCX"):
        XlsxBook(out.getvalue())


def test_validate_and_properties():
    b = XlsxBook(write_xlsx(BookSpec([SheetSpec("S", {1: [1]})], properties="<Application>Made here</Application><Company>None</Company>", parts={"xl/bad.xml": b"<a>"})))
    assert [v["entry"] for v in b.validate() if not v["ok"]] == ["xl/bad.xml"]
    assert b.properties() == {"application": "Made here", "company": "None"}


def test_shifted_formulas():
    assert shift_formula("=SUM(A1:$B$2)+LOG10(C3)&\"A1\"", 1, 1) == "=SUM(B2:$B$2)+LOG10(D4)&\"A1\""
    assert shift_formula("=$A1+A$1", 2, 3) == "=$A3+D$1"
    assert shift_formula("=A1", -1, 0) == "=#REF!"


def test_colours():
    assert tinted("#808080", 0) == "#808080"
    assert tinted("#000000", 0.5) == "#808080"
    assert tinted("#FFFFFF", -0.5) == "#808080"


# XLS


def test_rk():
    assert [decode_rk(x) for x in (1000 << 2 | 2, 1234 << 2 | 3, ((-5) << 2 | 2) & 0xFFFFFFFF)] == [1000, 12.34, -5]
    assert decode_rk(struct.unpack("<II", struct.pack("<d", 1.5))[1]) == 1.5


def test_sst_over_continuations():
    strings = ["plain", "я" * 20_000, "x" * 9000, "", "mixed é", "日本" * 5000]
    blocks, data, at = [], sst_records(strings), 0
    while at < len(data):
        size = struct.unpack_from("<H", data, at + 2)[0]
        blocks.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    assert len(blocks) > 3
    assert shared_strings(blocks) == strings


def xls_book():
    tokens, shared = bytes.fromhex("1E02001E030005"), bytes.fromhex("01") + struct.pack("<HH", 6, 0)
    rows = {
        1: ["id", "имя", "when", "ok"],
        2: [1, "Ada", XlsCell(45, style=1), True],
        4: [2.5, XlsCell(None), XlsCell(30681.222951388889, style=1), "#ERR:07"],
        5: [XlsCell(6, tokens=tokens), XlsCell("text", tokens=tokens), XlsCell(43, style=2), XlsCell(43, style=3)],
        7: [XlsCell(1, tokens=shared)],
    }
    body = struct.pack("<HHBBBB", 6, 6, 0, 0, 0, 1) + struct.pack("<H", 5) + b"\x2c" + struct.pack("<HH", 0xFFFF, 0xC000)
    return write_xls([XlsSheetSpec("First", rows, merges=[(0, 1, 0, 1)], extra=record(0x04BC, body)), XlsSheetSpec("Hid", {1: ["z"]}, state=1)], {51: "000", 165: "@"}, [0, 14, 51, 165])


def test_xls_cells():
    b = XlsBook(xls_book())
    assert [(s.name, s.state, s.dimension) for s in b.sheets] == [("First", "visible", "A1:D7"), ("Hid", "hidden", "A1")]
    rows = {r: [(c["t"], c["raw"], c["fmt"], c["f"]) for c in cells] for r, _, cells in b.sheets[0].rows()}
    assert rows[1][1] == ("s", "имя", "", None)
    assert rows[2] == [("n", "1", "", None), ("s", "Ada", "", None), ("n", "45", "date", None), ("b", "1", "", None)]
    assert rows[4] == [("n", "2.5", "", None), ("", None, "", None), ("n", "30681.22295138889", "date", None), ("e", "#DIV/0!", "", None)]
    assert rows[5] == [("n", "6", "", "=2*3"), ("s", "text", "", "=2*3"), ("n", "43", "number", None), ("n", "43", "string", None)]
    assert rows[7][0][3] == "=A6"
    assert b.sheets[0].merged_cells() == ["A1:B2"]
    assert b.style_tables()["fonts"][0]["font-name"] == "Arial"


def test_xls_rejects():
    with pytest.raises(SheetError):
        XlsBook(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 10)
    good = xls_book()
    with pytest.raises((SheetError, OleError)):
        XlsBook(good[:700])
    assert OleFile(good).has("workbook") and not OleFile(good).has("Book")


@pytest.mark.parametrize(("tokens", "text"), [("1E02001E030005", "2*3"), ("1E010013", "-1"), ("2400000000", "$A$1"), ("FF", None), ("1E02", None)])
def test_decompile(tokens, text):
    assert decompile(bytes.fromhex(tokens)) == text


def test_function_names_by_index():
    from sheetframe.sources.formula import _ARGUMENTS, FUNCTIONS

    assert len(FUNCTIONS) == len(set(FUNCTIONS.values())) == 247 and set(_ARGUMENTS) <= set(FUNCTIONS)
    spots = {0: "COUNT", 74: "NOW", 102: "VLOOKUP", 169: "COUNTA", 211: "LENB", 277: "CONFIDENCE", 293: "NORMDIST", 300: "POISSON", 308: "COVAR", 309: "FORECAST", 310: "FTEST", 311: "INTERCEPT", 312: "PEARSON", 313: "RSQ", 315: "SLOPE", 329: "PERCENTRANK", 351: "DATEDIF", 367: "VARA"}
    assert {k: FUNCTIONS[k] for k in spots} == spots
    for k, name in FUNCTIONS.items():
        n = _ARGUMENTS.get(k, 2)
        numbers = b"".join(b"\x1e" + struct.pack("<H", i) for i in range(n))
        token = b"\x21" + struct.pack("<H", k) if k in _ARGUMENTS else b"\x22" + struct.pack("<BH", n, k)
        assert decompile(numbers + token) == f"{name}({','.join(map(str, range(n)))})"


def test_decompile_functions_and_references():
    area = b"\x25" + struct.pack("<HHHH", 1, 1, 0xC000, 0xC003)
    assert decompile(area + b"\x19\x10\x00\x00") == "SUM(A2:D2)"
    assert decompile(area + b"\x22\x01" + struct.pack("<H", 7)) == "MAX(A2:D2)"
    assert decompile(b"\x1f" + struct.pack("<d", 2.5) + b"\x1e\x01\x00\x21" + struct.pack("<H", 27)) == "ROUND(2.5,1)"
    assert decompile(b"\x17\x02\x00a\"" + b"\x17\x01\x00b\x08") == '"a"""&"b"'
    assert decompile(b"\x3a" + struct.pack("<HHH", 0, 0, 0xC000), sheets=["My sheet"]) == "'My sheet'!A1"
    assert decompile(b"\x21" + struct.pack("<H", 999), functions={999: ("MINE", 0)}) == "MINE()"
    assert decompile(b"\x1d\x01") == "TRUE" and decompile(b"\x1c\x2a") == "#N/A"


def test_escher():
    def rec(kind, body, instance=0, container=False):
        return struct.pack("<HHI", instance << 4 | (15 if container else 0), kind, len(body)) + body

    png = b"\x89PNG data"
    blip = rec(0xF01E, b"\0" * 17 + png, 0x6E0)
    group = rec(0xF000, rec(0xF001, rec(0xF007, b"\0" * 36 + blip), 1, True), 0, True)
    assert escher.blip_store(group) == [("png", png)]
    name = "Pic\0".encode("utf-16-le")
    opt = rec(0xF00B, struct.pack("<HI", 0x4104, 1) + struct.pack("<HI", 0xC380, len(name)) + name, 2)
    shape = rec(0xF004, rec(0xF00A, b"\0" * 8) + opt + rec(0xF010, struct.pack("<HHHH", 0, 2, 0, 5) + b"\0" * 10), 0, True)
    assert escher.shapes(rec(0xF002, shape, 0, True)) == [(1, 5, 2, "Pic")]


def test_dispatch_by_content():
    assert open_content(write_xlsx(book())).kind == "xlsx"
    assert open_content(xls_book()).kind == "xls"
    assert open_content(b"a,b\n1,2\n").kind == "csv"
    assert open_content(b"PK\x03\x04,x\n1,2\n", ScanOptions(kind="csv")).kind == "csv"


@pytest.mark.parametrize("prefix", ["", "x:"])
def test_a_catalogue_leaves_rows_unread(prefix):
    """What stands before and after the rows of a sheet is the same with the rows left out."""
    rows = {k: [k, "text"] for k in range(1, 5001)}
    spec = SheetSpec("S", rows, merges=["A1:B2"], before="" if prefix else '<sheetViews><sheetView tabSelected="1"/></sheetViews>')
    sheet = XlsxBook(write_xlsx(BookSpec([spec], prefix=prefix)), bool(prefix)).sheets[0]
    assert len(sheet._without_rows()) < 2000
    left = (sheet.dimension, sheet.active, sheet.merged_cells())
    sheet = XlsxBook(write_xlsx(BookSpec([spec], prefix=prefix)), bool(prefix)).sheets[0]
    sheet._without_rows = lambda: None
    assert left == (sheet.dimension, sheet.active, sheet.merged_cells()) == ("A1:B5000", not prefix, ["A1:B2"])


def test_rows_are_left_out_only_where_bytes_tell_their_end():
    of = lambda rows, **kw: XlsxBook(write_xlsx([SheetSpec("S", rows, **kw)])).sheets[0]
    assert of({}, merges=["A1:B2"]).merged_cells() == ["A1:B2"]
    odd = of({1: [1]}, before="<!-- </sheetData> -->", merges=["A1:B2"])
    assert odd._without_rows() is None and odd.merged_cells() == ["A1:B2"]


def test_strings_of_an_xls_are_read_when_asked_for():
    book = XlsBook(write_xls([XlsSheetSpec("S", {1: ["a", "b"]})]))
    assert book.sheets[0].dimension == "A1:B1" and "strings" not in vars(book)
    assert [c["raw"] for _, _, cells in book.sheets[0].rows() for c in cells] == ["a", "b"]
