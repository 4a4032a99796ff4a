"""Serial dates and date patterns.

Serial arithmetic is plain Column arithmetic, so it stays in generated code. Patterns of workbooks are translated once, at
plan time, to the patterns of Spark's date_format.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .typing_rules import let

EPOCH_SERIAL = 25569  # 1970-01-01
DATE_1904_SHIFT = 1462

#: Builtin number formats (fixed values): id, code and category.
BUILTIN_FORMATS: dict[int, tuple[str, str]] = {
    0: ("General", "general"),
    1: ("0", "number"),
    2: ("0.00", "number"),
    3: ("#,##0", "number"),
    4: ("#,##0.00", "number"),
    9: ("0%", "number"),
    10: ("0.00%", "number"),
    11: ("0.00E+00", "number"),
    12: ("# ?/?", "general"),
    13: ("# ??/??", "general"),
    14: ("mm-dd-yy", "date"),
    15: ("d-mmm-yy", "date"),
    16: ("d-mmm", "date"),
    17: ("mmm-yy", "date"),
    18: ("h:mm AM/PM", "date"),
    19: ("h:mm:ss AM/PM", "date"),
    20: ("h:mm", "date"),
    21: ("h:mm:ss", "date"),
    22: ("m/d/yy h:mm", "date"),
    37: ("#,##0 ;(#,##0)", "number"),
    38: ("#,##0 ;[Red](#,##0)", "number"),
    39: ("#,##0.00;(#,##0.00)", "number"),
    40: ("#,##0.00;[Red](#,##0.00)", "number"),
    45: ("mm:ss", "date"),
    46: ("[h]:mm:ss", "date"),
    47: ("mmss.0", "date"),
    48: ("##0.0E+0", "number"),
    49: ("@", "string"),
}
#: Builtin ids that stand for dates, localized ones among them (fixed values).
DATE_IDS = ((14, 22), (27, 36), (45, 47), (50, 58), (71, 81))

#: Builtin ids that a locale writes its own way (fixed values): short date, day with month and year, times, date with time.
LOCALE_IDS = (14, 15, 16, 17, 20, 21, 22)

#: A part of a number format: quoted text, an escaped character, brackets, a half-day mark, a run of a date letter, anything else.
_PART = re.compile(r'"([^"]*)"?|\\(.)|\[([^\]]*)\]|(AM/PM|am/pm|A/P)|([ymdhsYMDHS])\5*|(.)', re.S)


def _parts(code: str) -> list[tuple[str, str]]:
    """(kind, text) of the parts of a format: text, mark (an escaped or plain character), bracket, ampm, or a date letter with
    its run."""
    out = []
    for m in _PART.finditer(code):
        quoted, escaped, bracket, half, letter, other = m.groups()
        if quoted is not None:
            out.append(("text", quoted))
        elif bracket is not None:
            out.append(("bracket", bracket))
        elif half:
            out.append(("ampm", half))
        elif letter:
            out.append((letter, m[0]))
        else:
            out.append(("mark", escaped if escaped is not None else other or ""))
    return out


def is_date_format(code: str, format_id: int | None = None) -> bool:
    """By a date id, by a locale in front, or by a part that only dates have: two letters for year, month, day or second, any
    hour, a half-day mark, elapsed time in brackets, or a single day or month after a slash or point."""
    if format_id and any(a <= format_id <= b for a, b in DATE_IDS):
        return True
    parts = _parts(code or "")
    if len(parts) > 1 and parts[0][0] == "bracket" and _is_locale(parts[0][1]):
        return True
    for (before, mark), (kind, run) in zip([("", ""), *parts], parts, strict=False):
        if kind == "h" or kind in ("y", "m", "d", "s", "M") and len(run) > 1 or kind == "ampm":
            return True
        if kind == "bracket" and run and set(run.lower()) <= set("hms") and len(set(run.lower())) == 1:
            return True
        if kind in ("d", "m") and before == "mark" and mark in ("/", "."):
            return True
    return False


def _is_locale(text: str) -> bool:
    """$-409 and the like: three or four hexadecimal digits."""
    return text.startswith("$-") and len(text) in (5, 6) and set(text[2:]) <= set("0123456789ABCDEF")


def is_number_format(code: str) -> bool:
    """Zeros, and perhaps a point with zeros after it."""
    whole, point, part = code.partition(".")
    return bool(whole) and set(whole) == {"0"} and (not point or set(part) == {"0"})


def locale_codes(spark: SparkSession, locale: str) -> dict[str, str]:
    """date_format patterns of the builtin codes LOCALE_IDS as a locale (ru_RU) writes them, from the JVM's own tables. Short
    dates have four digits of the year where the locale doesn't say two, hours no leading zero; day and month names go with the
    separator of the short date."""
    time, util = spark._jvm.java.time, spark._jvm.java.util
    of = util.Locale.forLanguageTag(locale.replace("_", "-"))
    if of.getLanguage() not in set(util.Locale.getISOLanguages()):
        raise ValueError(f"no formats for locale {locale}")
    style, iso = time.format.FormatStyle, time.chrono.IsoChronology.INSTANCE

    def pattern(date, clock) -> str:
        return time.format.DateTimeFormatterBuilder.getLocalizedDateTimePattern(date, clock, iso, of)

    day = re.sub(r"(?<!y)y(?!y)", "yyyy", pattern(style.SHORT, None))
    mark = next((c for c in day if not c.isalpha()), "-")
    mark = "''" if mark == "'" else mark
    short, medium = (re.sub("HH", "H", pattern(None, s)).replace("B", "a") for s in (style.SHORT, style.MEDIUM))
    shown = (day, f"d{mark}MMM{mark}yy", f"d{mark}MMM", f"MMM{mark}yy", short, medium, f"{day} {short}")
    return {BUILTIN_FORMATS[k][0]: p for k, p in zip(LOCALE_IDS, shown, strict=True)}


def format_category(code: str, format_id: int, from_xls: bool = False) -> str:
    """date, number, general, string, or empty where nothing is known. A code that the file declares beats the builtin meaning
    of its id; only XLS then looks its code up among the builtin ones."""
    if is_date_format(code, None if code else format_id):
        return "date"
    if code:
        if is_number_format(code):
            return "number"
        return next((kind for text, kind in BUILTIN_FORMATS.values() if text == code), "") if from_xls else ""
    return BUILTIN_FORMATS[format_id][1] if format_id > 0 and format_id in BUILTIN_FORMATS else ""


def format_code(code: str, format_id: int) -> str:
    return code or BUILTIN_FORMATS.get(format_id, ("", ""))[0]


def serial_seconds(serial: Column, date1904: Column | bool = False) -> Column:
    """Unix seconds of a serial number. 1900 counts as a leap year up to serial 59, as spreadsheets have it."""
    whole = F.floor(serial).cast("double")
    part = F.floor((serial - whole) * 86400 + 0.5)
    shifted = whole + F.when(F.lit(date1904) if isinstance(date1904, bool) else date1904, DATE_1904_SHIFT).otherwise(0)
    day = F.when(shifted <= 59, shifted + 1).otherwise(shifted)
    return F.when(day == 0, part).otherwise((day - EPOCH_SERIAL) * 86400 + part).cast("long")


#: How each form of a text date is put as year-month-day, in order: pattern and replacement. YEAR and DAY stand for today's.
_FORMS = (
    (r"^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})(?= |$)", "$1-$2-$3"),
    (r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}|[0-9]{2})(?= |$)", "$3-$1-$2"),
    (r"^([0-9]{1,2})/([0-9]{1,2})(?= |$)", "YEAR-$1-$2"),
    (r"^([0-9]{1,2})[.-]([0-9]{1,2})[.-]([0-9]{4})(?= |$)", "$3-$2-$1"),
    (r"^([0-9]{1,2})\.([0-9]{1,2})\.(6[1-9]|[7-9][0-9])(?= |$)", "$3-$2-$1"),
    (r"^([0-9]{1,2}[:.][0-9]{2}(?:[:.][0-9]{2}(?:[:.][0-9]+)?)?)$", "DAY $1"),
    (r"^([0-9]{4}-[0-9]{1,2})(?= |$)", "$1-1"),
    (r"^([0-6][0-9])-", "20$1-"),
    (r"^([7-9][0-9])-", "19$1-"),
)
_DATE_TIME = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})(?: +([0-9]{1,2})[:.]([0-9]{2})(?:[:.]([0-9]{2})(?:[:.][0-9]+)?)?)?$"


def text_seconds(text: Column) -> Column:
    """Unix seconds of a date or time written with digits and separators: year first with hyphens or slashes, month first with
    slashes, day first with points or hyphens, each perhaps with a time after it. Years of two digits are 1970 to 2069; a year
    that isn't said is this one, a time alone is today's, a day beyond the month's end is in the next month. 0 for other text."""
    plain = F.trim(F.translate(text, "\t\n\r\x0b\f", "     "))
    today = F.current_date()
    for pattern, to in _FORMS:
        if "YEAR" in to or "DAY" in to:
            word = "YEAR" if "YEAR" in to else "DAY"
            now = F.year(today).cast("string") if word == "YEAR" else today.cast("string")
            plain = F.regexp_replace(plain, F.lit(pattern), F.concat(now, F.lit(to[len(word) :])))
        else:
            plain = F.regexp_replace(plain, pattern, to)

    def seconds(written: Column) -> Column:
        parts = F.transform(F.split(F.regexp_replace(written, _DATE_TIME, "$1,$2,$3,$4,$5,$6"), ","), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))
        return let(parts, of_parts)

    def of_parts(p: Column) -> Column:
        year, month, day, hour, minute, second = (F.get(p, k) for k in range(6))
        good = month.between(1, 12) & day.between(1, 31) & (hour <= 24) & (minute < 60) & (second < 60)
        start = F.unix_date(F.make_date(year, F.when(good, month).otherwise(1), F.lit(1))) + day - 1
        return F.when(good, start.cast("long") * 86400 + hour * 3600 + minute * 60 + second).otherwise(F.lit(0).cast("long"))

    found = let(plain, lambda w: F.when(w.rlike(_DATE_TIME), seconds(w)).otherwise(F.lit(0).cast("long")))
    return F.when(F.trim(text).rlike(r"^[0-9.\-/:\s]+$"), found).otherwise(F.lit(0).cast("long"))


@lru_cache(4096)
def spark_pattern(code: str) -> str | None:
    """A workbook's date code as a date_format pattern, None if it is no date code. m is a minute next to hours or seconds,
    else a month; colours, conditions, elapsed-time brackets and sections after the first are left out."""
    if not is_date_format(code):
        return None
    parts: list[tuple[str, str]] = []
    for kind, text in _parts(code):
        if kind == "mark" and text == ";":
            break  # sections after the first are for other signs
        if kind == "bracket":
            if text and set(text.lower()) <= set("hms"):  # elapsed time
                parts.append((text[0].lower(), text.lower()))
        elif kind == "mark":
            if text not in "*_@":
                parts.append(("text", text))
        else:
            parts.append((kind.lower(), text if kind in ("text", "ampm") else text.lower()))
    kinds = [k for k, _ in parts]
    half = "ampm" in kinds
    out = []
    for k, (kind, text) in enumerate(parts):
        before = next((x for x in reversed(kinds[:k]) if x != "text"), "")
        after = next((x for x in kinds[k + 1 :] if x != "text"), "")
        n = len(text)
        if kind == "text":
            out.append("".join(f"'{c}'" if c.isalpha() else "''" if c == "'" else f"'{c}'" if c in "[]{}#" else c for c in text))
        elif kind == "ampm":
            out.append("a")
        elif kind == "y":
            out.append("yyyy" if n > 2 else "yy")
        elif kind == "m" and n < 3 and (before == "h" or after == "s"):
            out.append("mm" if n > 1 else "m")
        elif kind == "m":
            out.append({1: "M", 2: "MM", 3: "MMM", 4: "MMMM"}.get(n, "MMM"))
        elif kind == "d":
            out.append({1: "d", 2: "dd", 3: "EEE"}.get(n, "EEEE"))
        elif kind == "h":
            out.append(("h" if half else "H") * min(n, 2))
        else:
            out.append("s" * min(n, 2))
    return "".join(out)


#: Letters of gmdate-style formats and their date_format patterns (fixed values).
_LETTERS = {"d": "dd", "j": "d", "D": "EEE", "l": "EEEE", "m": "MM", "n": "M", "M": "MMM", "F": "MMMM", "Y": "yyyy", "y": "yy", "H": "HH", "G": "H", "h": "hh", "g": "h", "i": "mm", "s": "ss", "A": "a", "a": "a", "z": "D", "N": "e", "c": "yyyy-MM-dd'T'HH:mm:ssXXX"}


def letters_pattern(fmt: str) -> str:
    """A gmdate-style format (Y-m-d) as a date_format pattern; a backslash quotes the next letter."""
    out, k = [], 0
    while k < len(fmt):
        c = fmt[k]
        if c == "\\" and k + 1 < len(fmt):
            out.append(f"'{fmt[k + 1]}'")
            k += 1
        else:
            out.append(_LETTERS.get(c, f"'{c}'" if c.isalpha() else "''" if c == "'" else c))
        k += 1
    return "".join(out)


def format_seconds(seconds: Column, pattern: str) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), pattern)
