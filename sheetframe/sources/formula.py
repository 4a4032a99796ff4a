"""BIFF8 formula tokens as formula text. Formulas are never evaluated."""

from __future__ import annotations

import struct

from ..functions.addressing import col_letter

#: Worksheet functions by their index in a formula (fixed values of the format).
FUNCTIONS: dict[int, str] = {
    0: "COUNT", 1: "IF", 2: "ISNA", 3: "ISERROR", 4: "SUM", 5: "AVERAGE", 6: "MIN", 7: "MAX", 8: "ROW", 9: "COLUMN",
    10: "NA", 11: "NPV", 12: "STDEV", 13: "DOLLAR", 14: "FIXED", 15: "SIN", 16: "COS", 17: "TAN", 18: "ATAN", 19: "PI",
    20: "SQRT", 21: "EXP", 22: "LN", 23: "LOG10", 24: "ABS", 25: "INT", 26: "SIGN", 27: "ROUND", 28: "LOOKUP", 29: "INDEX",
    30: "REPT", 31: "MID", 32: "LEN", 33: "VALUE", 34: "TRUE", 35: "FALSE", 36: "AND", 37: "OR", 38: "NOT", 39: "MOD",
    40: "DCOUNT", 41: "DSUM", 42: "DAVERAGE", 43: "DMIN", 44: "DMAX", 45: "DSTDEV", 46: "VAR", 47: "DVAR", 48: "TEXT",
    49: "LINEST", 50: "TREND", 51: "LOGEST", 52: "GROWTH", 56: "PV", 57: "FV", 58: "NPER", 59: "PMT", 60: "RATE",
    61: "MIRR", 62: "IRR", 63: "RAND", 64: "MATCH", 65: "DATE", 66: "TIME", 67: "DAY", 68: "MONTH", 69: "YEAR",
    70: "WEEKDAY", 71: "HOUR", 72: "MINUTE", 73: "SECOND", 74: "NOW", 75: "AREAS", 76: "ROWS", 77: "COLUMNS", 78: "OFFSET",
    82: "SEARCH", 83: "TRANSPOSE", 86: "TYPE", 97: "ATAN2", 98: "ASIN", 99: "ACOS", 100: "CHOOSE", 101: "HLOOKUP",
    102: "VLOOKUP", 105: "ISREF", 109: "LOG", 111: "CHAR", 112: "LOWER", 113: "UPPER", 114: "PROPER", 115: "LEFT",
    116: "RIGHT", 117: "EXACT", 118: "TRIM", 119: "REPLACE", 120: "SUBSTITUTE", 121: "CODE", 124: "FIND", 125: "CELL",
    126: "ISERR", 127: "ISTEXT", 128: "ISNUMBER", 129: "ISBLANK", 130: "T", 131: "N", 140: "DATEVALUE", 141: "TIMEVALUE",
    142: "SLN", 143: "SYD", 144: "DDB", 148: "INDIRECT", 162: "CLEAN", 163: "MDETERM", 164: "MINVERSE", 165: "MMULT",
    167: "IPMT", 168: "PPMT", 169: "COUNTA", 183: "PRODUCT", 184: "FACT", 189: "DPRODUCT", 190: "ISNONTEXT", 193: "STDEVP",
    194: "VARP", 195: "DSTDEVP", 196: "DVARP", 197: "TRUNC", 198: "ISLOGICAL", 199: "DCOUNTA", 204: "USDOLLAR",
    205: "FINDB", 206: "SEARCHB", 207: "REPLACEB", 208: "LEFTB", 209: "RIGHTB", 210: "MIDB", 211: "LENB", 212: "ROUNDUP",
    213: "ROUNDDOWN", 214: "ASC", 215: "DBCS", 216: "RANK", 219: "ADDRESS", 220: "DAYS360", 221: "TODAY", 222: "VDB",
    227: "MEDIAN", 228: "SUMPRODUCT", 229: "SINH", 230: "COSH", 231: "TANH", 232: "ASINH", 233: "ACOSH", 234: "ATANH",
    235: "DGET", 244: "INFO", 247: "DB", 252: "FREQUENCY", 261: "ERROR.TYPE", 269: "AVEDEV", 270: "BETADIST",
    271: "GAMMALN", 272: "BETAINV", 273: "BINOMDIST", 274: "CHIDIST", 275: "CHIINV", 276: "COMBIN", 277: "CONFIDENCE",
    278: "CRITBINOM", 279: "EVEN", 280: "EXPONDIST", 281: "FDIST", 282: "FINV", 283: "FISHER", 284: "FISHERINV",
    285: "FLOOR", 286: "GAMMADIST", 287: "GAMMAINV", 288: "CEILING", 289: "HYPGEOMDIST", 290: "LOGNORMDIST", 291: "LOGINV",
    292: "NEGBINOMDIST", 293: "NORMDIST", 294: "NORMSDIST", 295: "NORMINV", 296: "NORMSINV", 297: "STANDARDIZE", 298: "ODD",
    299: "PERMUT", 300: "POISSON", 301: "TDIST", 302: "WEIBULL", 303: "SUMXMY2", 304: "SUMX2MY2", 305: "SUMX2PY2",
    306: "CHITEST", 307: "CORREL", 308: "COVAR", 309: "FORECAST", 310: "FTEST", 311: "INTERCEPT", 312: "PEARSON",
    313: "RSQ", 314: "STEYX", 315: "SLOPE", 316: "TTEST", 317: "PROB", 318: "DEVSQ", 319: "GEOMEAN", 320: "HARMEAN",
    321: "SUMSQ", 322: "KURT", 323: "SKEW", 324: "ZTEST", 325: "LARGE", 326: "SMALL", 327: "QUARTILE", 328: "PERCENTILE",
    329: "PERCENTRANK", 330: "MODE", 331: "TRIMMEAN", 332: "TINV", 336: "CONCATENATE", 337: "POWER", 342: "RADIANS",
    343: "DEGREES", 344: "SUBTOTAL", 345: "SUMIF", 346: "COUNTIF", 347: "COUNTBLANK", 350: "ISPMT", 351: "DATEDIF",
    352: "DATESTRING", 353: "NUMBERSTRING", 354: "ROMAN", 358: "GETPIVOTDATA", 359: "HYPERLINK", 360: "PHONETIC",
    361: "AVERAGEA", 362: "MAXA", 363: "MINA", 364: "STDEVPA", 365: "VARPA", 366: "STDEVA", 367: "VARA",
}

#: Those whose tokens carry no number of arguments, by the number that they take (fixed values).
_FIXED: dict[int, tuple[int, ...]] = {
    0: (
        10, 19, 34, 35, 63, 74, 221,
    ),
    1: (
        2, 3, 15, 16, 17, 18, 20, 21, 22, 23, 24, 25, 26, 32, 33, 38, 67, 68, 69, 71, 72, 73, 75, 76, 77, 83, 86, 98, 99, 105,
        111, 112, 113, 114, 118, 121, 126, 127, 128, 129, 130, 131, 140, 141, 162, 163, 164, 184, 190, 198, 211, 214, 215, 229,
        230, 231, 232, 233, 234, 244, 261, 271, 279, 283, 284, 294, 296, 298, 342, 343, 347, 352, 360,
    ),
    2: (
        27, 30, 39, 48, 97, 117, 165, 212, 213, 252, 274, 275, 276, 285, 288, 299, 303, 304, 305, 306, 307, 308, 310, 311, 312,
        313, 314, 315, 325, 326, 327, 328, 331, 332, 337, 346, 353,
    ),
    3: (
        31, 40, 41, 42, 43, 44, 45, 47, 61, 65, 66, 142, 189, 195, 196, 199, 210, 235, 277, 278, 280, 281, 282, 287, 290, 291,
        292, 295, 297, 300, 301, 309, 351,
    ),
    4: (
        119, 143, 207, 273, 286, 289, 293, 302, 316, 350,
    ),
}
_ARGUMENTS = {k: n for n, indexes in _FIXED.items() for k in indexes}

ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}
_BINARY = {0x03: "+", 0x04: "-", 0x05: "*", 0x06: "/", 0x07: "^", 0x08: "&", 0x09: "<", 0x0A: "<=", 0x0B: "=", 0x0C: ">=", 0x0D: ">", 0x0E: "<>", 0x0F: " ", 0x10: ",", 0x11: ":"}


class _Unknown(Exception):
    pass


def number_text(value: float) -> str:
    """A whole number without a point, any other as its shortest decimal."""
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def _cell(row: int, col: int, base: tuple[int, int] | None) -> str:
    """A reference; with base, relative parts are offsets from it."""
    row_rel, col_rel, c = bool(col & 0x8000), bool(col & 0x4000), col & 0xFF
    if base is not None:
        row = (base[0] + struct.unpack("<h", struct.pack("<H", row))[0]) % 65536 if row_rel else row
        c = (base[1] + struct.unpack("<b", bytes([c]))[0]) % 256 if col_rel else c
    return f"{'' if col_rel else '$'}{col_letter(c + 1)}{'' if row_rel else '$'}{row + 1}"


def decompile(tokens: bytes, base: tuple[int, int] | None = None, sheets: list[str] | None = None, names: list[str] | None = None, functions: dict[int, tuple[str, int | None]] | None = None) -> str | None:
    """Formula text without the equals sign; None for a token that isn't known or tokens that don't add up. base (row and
    column from 0) is the cell of a shared formula; sheets are the names behind external-sheet indexes; functions adds or
    replaces functions, with the number of arguments where it is fixed."""
    try:
        return _walk(tokens, base, sheets or [], names or [], functions or {})
    except (_Unknown, IndexError, struct.error):
        return None


def _walk(data: bytes, base, sheets: list[str], names: list[str], functions) -> str:
    stack: list[str] = []
    at = 0

    def read(fmt: str):
        nonlocal at
        out = struct.unpack_from("<" + fmt, data, at)
        at += struct.calcsize("<" + fmt)
        return out

    def function(k: int) -> tuple[str | None, int | None]:
        return functions.get(k) or (FUNCTIONS.get(k), _ARGUMENTS.get(k))

    def call(name: str, n: int) -> None:
        if n > len(stack):
            raise _Unknown
        args = stack[len(stack) - n :]
        del stack[len(stack) - n :]
        stack.append(f"{name}({','.join(args)})")

    def sheet(k: int) -> str:
        if k >= len(sheets):
            raise _Unknown
        name = sheets[k]
        return (name if name.replace("_", "a").isalnum() and not name[0].isdigit() else "'" + name.replace("'", "''") + "'") + "!"

    while at < len(data):
        token = data[at]
        at += 1
        kind = (token & 0x1F) | 0x20 if token >= 0x40 else token
        if token in _BINARY:
            right, left = stack.pop(), stack.pop()
            stack.append(left + _BINARY[token] + right)
        elif token == 0x12:
            stack.append("+" + stack.pop())
        elif token == 0x13:
            stack.append("-" + stack.pop())
        elif token == 0x14:
            stack.append(stack.pop() + "%")
        elif token == 0x15:
            stack.append(f"({stack.pop()})")
        elif token == 0x16:
            stack.append("")
        elif token == 0x17:
            n, wide = read("BB")
            size = n * 2 if wide & 1 else n
            if at + size > len(data):
                raise _Unknown
            text = data[at : at + size].decode("utf-16-le" if wide & 1 else "latin-1")
            at += size
            stack.append('"' + text.replace('"', '""') + '"')
        elif token == 0x19:
            flags, more = read("BH")
            if flags & 0x04:  # a jump table of CHOOSE
                at += 2 * (more + 1)
            elif flags & 0x10:
                call("SUM", 1)
        elif token == 0x1C:
            stack.append(ERRORS.get(read("B")[0], "#N/A"))
        elif token == 0x1D:
            stack.append("TRUE" if read("B")[0] else "FALSE")
        elif token == 0x1E:
            stack.append(str(read("H")[0]))
        elif token == 0x1F:
            stack.append(number_text(read("d")[0]))
        elif kind == 0x21:
            name, n = function(read("H")[0])
            if name is None or n is None:
                raise _Unknown
            call(name, n)
        elif kind == 0x22:
            n, k = read("BH")
            name = function(k & 0x7FFF)[0]
            if name is None:
                raise _Unknown
            call(name, n & 0x7F)
        elif kind == 0x23:
            k = read("HH")[0]
            if not 0 < k <= len(names):
                raise _Unknown
            stack.append(names[k - 1])
        elif kind in (0x24, 0x2C):
            row, col = read("HH")
            stack.append(_cell(row, col, base if kind == 0x2C else None))
        elif kind in (0x25, 0x2D):
            r1, r2, c1, c2 = read("HHHH")
            b = base if kind == 0x2D else None
            stack.append(f"{_cell(r1, c1, b)}:{_cell(r2, c2, b)}")
        elif kind == 0x2A:
            read("HH")
            stack.append("#REF!")
        elif kind == 0x2B:
            read("HHHH")
            stack.append("#REF!")
        elif kind == 0x3A:
            k, row, col = read("HHH")
            stack.append(sheet(k) + _cell(row, col, None))
        elif kind == 0x3B:
            k, r1, r2, c1, c2 = read("HHHHH")
            stack.append(f"{sheet(k)}{_cell(r1, c1, None)}:{_cell(r2, c2, None)}")
        else:
            raise _Unknown
    if len(stack) != 1:
        raise _Unknown
    return stack[0]
