"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus-digit pairs, digit pairs, dotted digits, URL schemes, account
countries and credential cues. A deterministic parser expands each anchor to its span and validates it, so a text without anchors costs
one automaton walk and nothing else. Rows are independent: no shuffle, whole texts, bounded memory per batch.

Base kinds, leftmost and non-overlapping within a kind: email, ip, card, phone. Added kinds: url (scheme anchors), account
(IBANs with a valid check number, after a cue or by their country), secret (key, password and token cues). A null text counts as empty and has no spans.
"""

from __future__ import annotations

import hashlib
import string
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, text_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "secret")

_DIGITS = frozenset("0123456789")
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_LABEL = frozenset(string.ascii_letters + string.digits + "-")
_PHONE = frozenset("0123456789 ().-")
_ALNUM = frozenset(string.ascii_letters + string.digits)
_UPPER = frozenset(string.ascii_uppercase + string.digits)
_BLANKS = frozenset(" \t")
_ASCII_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_HEXISH = frozenset(string.ascii_letters + string.digits + "+/_-.~")
#: Cue, in any case, and the least length of the value after it; between them blanks, a colon or equals sign, and quotes.
SECRET_CUES = {"password": 6, "passwd": 6, "token": 16, "api_key": 12, "api-key": 12, "apikey": 12, "access_key": 12, "secret": 12, "bearer": 16}
#: Cues that need neither colon nor equals sign.
OPEN_CUES = {"bearer"}
ACCOUNT_CUE = "iban"
KEY_CUES = {"AKIA": 20, "ASIA": 20}

#: Characters of an IBAN by country.
_LENGTHS = (
    "NO15 BE16 DK18 FI18 FK18 FO18 GL18 NL18 SD18 MK19 SI19 AT20 BA20 EE20 KZ20 LT20 LU20 MN20 XK20 CH21 CR21 HR21 LI21 LV21 BG22 "
    "BH22 DE22 GB22 GE22 IE22 ME22 RS22 VA22 AE23 GI23 IL23 IQ23 OM23 SO23 TL23 AD24 CZ24 ES24 MD24 PK24 RO24 SA24 SE24 SK24 TN24 "
    "VG24 LY25 PT25 ST25 IS26 TR26 AZ28 CY28 DO28 GT28 HU28 LB28 NI28 PL28 SV28 AL28 BY28 FR27 GR27 IT27 MC27 MR27 SM27 BI27 DJ27 "
    "BR29 EG29 PS29 QA29 UA29 HN28 JO30 KW30 MU30 YE30 MT31 SC31 LC32 RU33"
)
IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in _LENGTHS.split()}

Span = tuple[int, int]


@lru_cache(1)
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    found.add_word("://", ("url", 3))
    for a in "0123456789":
        found.add_word("+" + a, ("phone", 2))
        for b in "0123456789":
            found.add_word(f"{a}.{b}", ("ip", 3))
            for gap in ("", " ", "-"):
                found.add_word(f"{a}{gap}{b}", ("card", 2 + len(gap)))
    for cue in SECRET_CUES:
        found.add_word(cue, ("secret", len(cue)))
    for cue in KEY_CUES:
        found.add_word(cue.lower(), ("key", len(cue)))
    found.add_word(ACCOUNT_CUE, ("account", len(ACCOUNT_CUE)))
    for country in IBAN_LENGTHS:
        for a in "0123456789":
            found.add_word(country.lower() + a, ("iban", 3))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _run(text: str, at: int, allowed: frozenset[str]) -> int:
    """The first position from at on that isn't in allowed."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _email(text: str, at: int, least: int) -> Span | None:
    """Around the at-sign at `at`; the local part doesn't reach below least."""
    start = at
    while start > least and text[start - 1] in _LOCAL:
        start -= 1
    if start == at:
        return None
    end = _run(text, at + 1, _LABEL)
    if end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == "." and (more := _run(text, end + 1, _LABEL)) > end + 1:
        end, dots = more, dots + 1
    return (start, end) if dots else None


def _ip(text: str, first: int, least: int) -> tuple[Span | None, int]:
    """From a digit before a dot: the match, and where the next one may start. Four parts or nothing."""
    start = first
    while start > least and text[start - 1] in _DIGITS:
        start -= 1
    end, parts = start, []
    while True:
        stop = _run(text, end, _DIGITS)
        parts.append(text[end:stop])
        end = stop
        if len(parts) == 4 or end + 1 >= len(text) or text[end] != "." or text[end + 1] not in _DIGITS:
            break
        end += 1
    if len(parts) < 4:
        return None, least
    return ((start, end) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts) else None), end


def _card(text: str, start: int) -> tuple[Span | None, int]:
    """The chain of digits with single blanks or hyphens between that starts here, and its end."""
    n, end, digits = len(text), start + 1, [text[start]]
    while end < n:
        if text[end] in _DIGITS:
            digits.append(text[end])
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in _DIGITS:
            digits.append(text[end + 1])
            end += 2
        else:
            break
    return ((start, end) if 14 <= len(digits) <= 19 and luhn("".join(digits)) else None), end


def _phone(text: str, plus: int) -> tuple[Span | None, int]:
    end = _run(text, plus + 2, _PHONE)
    while end > plus + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    if end <= plus + 3 or text[end - 1] not in _DIGITS:
        return None, plus + 1
    digits = sum(c in _DIGITS for c in text[plus:end])
    return ((plus, end) if 10 <= digits <= 15 else None), end


def _url(text: str, colon: int, least: int) -> Span | None:
    start = colon
    while start > least and text[start - 1] in _ALNUM:
        start -= 1
    end, n = colon + 3, len(text)
    while end < n and text[end] > " " and text[end] not in "\"'<>`{}|\\^":
        end += 1
    while end > colon + 3 and text[end - 1] in ".,;:!?)]":
        end -= 1
    return (start, end) if start < colon and end > colon + 3 else None


def _after_cue(text: str, at: int) -> tuple[int, bool]:
    """Where the value after a cue that ends before `at` begins, and whether a colon or equals sign leads to it."""
    if at < len(text) and text[at] in "\"'":  # the end of a quoted name
        at += 1
    at = _run(text, at, _BLANKS)
    marked = at < len(text) and text[at] in ":="
    if marked:
        at = _run(text, at + 1, _BLANKS)
    if at < len(text) and text[at] in "\"'":
        at += 1
    return at, marked


def _iban(text: str, start: int) -> Span | None:
    """The country's length of characters, in groups with single blanks between; of a country without a known length, the
    longest that has a valid check number. A letter or digit after it makes it something else."""
    n, end, kept, ends = len(text), start, [], []
    length = IBAN_LENGTHS.get(text[start : start + 2])
    while end < n and len(kept) < (length or 34) and (text[end] in _UPPER or text[end] == " " and end + 1 < n and text[end + 1] in _UPPER):
        if text[end] != " ":
            kept.append(text[end])
            if len(kept) >= 15 and (end + 1 == n or text[end + 1] not in _ALNUM):
                ends.append((len(kept), end + 1))
        end += 1
    code = "".join(kept)
    if not code[:2].isalpha() or not code[2:4].isdigit():
        return None
    for size, end in reversed(ends):
        if size == (length or size) and int("".join(str(int(c, 36)) for c in code[4:size] + code[:4])) % 97 == 1:
            return start, end
    return None


def _lower(text: str) -> str:
    """Lower-cased, character for character."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_ASCII_LOWER)


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """All spans as (start, kind's place in KINDS, end), in order. Offsets are code points, ends exclusive."""
    out: list[tuple[int, int, int]] = []
    free = dict.fromkeys(("email", "ip", "card", "phone", "url", "account", "secret"), 0)  # where a kind may go on
    for last, (what, size) in _anchors().iter(_lower(text)):
        at = last - size + 1
        if what == "card":
            if at >= free["card"]:
                span, free["card"] = _card(text, at)
                if span:
                    out.append((span[0], 2, span[1]))
        elif what == "ip":
            if at >= free["ip"]:
                span, free["ip"] = _ip(text, at, free["ip"])
                if span:
                    out.append((span[0], 1, span[1]))
        elif what == "email":
            if at >= free["email"] and (span := _email(text, at, free["email"])):
                free["email"] = span[1]
                out.append((span[0], 0, span[1]))
        elif what == "phone":
            if at >= free["phone"]:
                span, free["phone"] = _phone(text, at)
                if span:
                    out.append((span[0], 3, span[1]))
        elif what == "url":
            if at >= free["url"] and (span := _url(text, at, free["url"])):
                free["url"] = span[1]
                out.append((span[0], 4, span[1]))
        elif what == "account":
            if last + 1 >= free["account"] and (span := _iban(text, _after_cue(text, last + 1)[0])):
                free["account"] = span[1]
                out.append((span[0], 5, span[1]))
        elif what == "iban":
            if at >= free["account"] and (at == 0 or text[at - 1] not in _ALNUM) and (span := _iban(text, at)):
                free["account"] = span[1]
                out.append((span[0], 5, span[1]))
        else:
            if at < free["secret"]:
                continue
            if what == "key":
                end = _run(text, at, _UPPER)
                good = end - at == KEY_CUES.get(text[at : last + 1]) and (at == 0 or text[at - 1] not in _ALNUM)
                span = (at, end) if good else None
            else:
                start, marked = _after_cue(text, last + 1)
                end = _run(text, start, _HEXISH)
                span = (start, end) if (marked or _lower(text[at : last + 1]) in OPEN_CUES) and end - start >= SECRET_CUES[_lower(text[at : last + 1])] else None
            if span:
                free["secret"] = span[1]
                out.append((span[0], 6, span[1]))
    out.sort()
    return [(start, end, KINDS[kind]) for start, kind, end in out]


def _join(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the counts of the base kinds, the digest of their spans, and all spans. Repeated rows give
    repeated rows; a null id stays null; a null or empty text has no span, and a text of any length is read whole; spans that
    begin at one place come in the order of KINDS; an empty table gives an empty result; other columns of docs aren't read."""

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: list[list[int]] = [[], [], [], []]
        digests, spans = [], []
        empty = hashlib.sha256(b"").hexdigest()
        for text in batch.column(1).to_pylist():
            found = find_spans(text)
            base = [s for s in found if s[2] in BASE_KINDS]
            for k, kind in enumerate(BASE_KINDS):
                counts[k].append(sum(s[2] == kind for s in base))
            digests.append(hashlib.sha256(_join(base).encode()).hexdigest() if base else empty)
            spans.append(_join(found))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
            names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        )

    return map_arrow(docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text")), scan, SCHEMA)
