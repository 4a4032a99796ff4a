"""Guesses about delimited text from a sample: byte order mark, encoding, delimiter, and whether it is text at all."""

from __future__ import annotations

import codecs
import math
import re
from collections import Counter

SAMPLE_BYTES = 65_536
CANDIDATES = (",", ";", "\t", "|", ":")

#: Byte order marks (fixed values), the longer ones first.
BOMS = ((b"\xff\xfe\x00\x00", "UTF-32LE"), (b"\x00\x00\xfe\xff", "UTF-32BE"), (b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE"))

#: Single-byte encodings that Cyrillic text comes in, and multi-byte ones of Japanese.
CYRILLIC = ("Windows-1251", "KOI8-R", "CP866", "ISO-8859-5")
JAPANESE = ("SJIS-win", "EUC-JP")
_CODECS = {"sjis-win": "cp932", "cp866": "cp866", "windows-31j": "cp932"}

#: The most frequent letters and letter pairs of Russian (fixed values).
_FREQUENT = "оеаинтсрвлкмдпу"
_PAIRS = ("ст", "но", "то", "на", "ен", "ов", "ни", "ра", "во", "ко", "ро", "ли", "пр", "го", "ер", "ан", "ть", "ка")


def detect_bom(sample: bytes) -> str | None:
    return next((name for mark, name in BOMS if sample.startswith(mark)), None)


def bom_size(sample: bytes) -> int:
    return next((len(mark) for mark, _ in BOMS if sample.startswith(mark)), 0)


def codec_of(name: str) -> str | None:
    """The Python codec of an encoding name, None if there is none."""
    try:
        return codecs.lookup(_CODECS.get(name.lower(), name)).name
    except LookupError:
        return None


def is_utf8(sample: bytes) -> bool:
    """Valid but for a character that the sample's end may cut."""
    try:
        codecs.getincrementaldecoder("utf-8")().decode(sample)
    except UnicodeDecodeError:
        return False
    return True


def _cyrillic_score(text: str) -> float:
    """Frequent letters and pairs for it; case changes within words, box drawing, and rare capitals against it."""
    words = re.findall(r"[А-Яа-яЁё]+", text)
    letters = sum(map(len, words))
    if not letters:
        return 0.0
    lower = "".join(words).lower()
    good = sum(lower.count(c) for c in _FREQUENT) + 2 * sum(lower.count(p) for p in _PAIRS)
    odd = sum(any(a.islower() and b.isupper() for a, b in zip(w, w[1:], strict=False)) * len(w) for w in words)
    boxes = sum("─" <= c <= "▟" for c in text)
    foreign = sum(c > "\x7f" and not ("А" <= c <= "я" or c in "Ёё№«»—–…“”") for c in text)
    return 100.0 * (good - 2 * odd - 3 * boxes - 2 * foreign) / (letters + foreign + boxes)


def _japanese_score(sample: bytes, name: str) -> float:
    text = sample.decode(codec_of(name), "replace")
    wide = [c for c in text if c > "\x7f"]
    if not wide:
        return 0.0
    kana = sum("぀" <= c <= "ヿ" for c in wide)
    kanji = sum("一" <= c <= "鿿" for c in wide)
    bad = sum(c == "�" or "｡" <= c <= "ﾟ" or "" <= c <= "" for c in wide)
    return 100.0 * (kana + 0.6 * kanji - 2 * bad) / len(wide)


def detect_encoding(sample: bytes) -> str:
    """The byte order mark's encoding, UTF-8 if it is valid, else the likeliest Japanese or Cyrillic one where one stands out,
    else ISO-8859-1."""
    if bom := detect_bom(sample):
        return bom
    if is_utf8(sample):
        return "UTF-8"
    scores = {name: _japanese_score(sample, name) for name in JAPANESE}
    for name in CYRILLIC:
        text = sample.decode(codec_of(name), "replace")
        high = sum(b > 0x7F for b in sample)
        scores[name] = _cyrillic_score(text) if high >= 3 else 0.0
    best = max(scores, key=scores.get)
    rest = max(v for k, v in scores.items() if k != best)
    return best if scores[best] >= 40 and scores[best] - rest >= 6 else "ISO-8859-1"


def looks_binary(sample: bytes, share: float = 0.3) -> bool:
    """A NUL, or more than so large a share of control characters other than tab and line ends."""
    if not sample:
        return False
    return b"\0" in sample or sum(b < 32 and b not in (9, 10, 13) or b == 127 for b in sample) > share * len(sample)


#: A record: quoted parts, which may hold line ends, and anything else up to a line end.
_RECORD = re.compile(r'((?:"[^"]*"?|[^"\r\n])*)(?:\r\n|\r|\n|\Z)')
_QUOTED = re.compile(r'"[^"]*"?')
#: Marks that stand within values: decimal commas, times, and the colon of a URL.
_INNER = {",": re.compile(r"(?<=[0-9]),(?=[0-9])"), ":": re.compile(r"(?<=[0-9]):(?=[0-9])|:(?=//)")}
#: How often a record of a table has the usual number of fields, and how much rarer each field more or less is.
_USUAL, _RARER = 0.9, 0.5


def sample_records(text: str) -> list[str]:
    """The records of a sample that aren't blank, with what is in quotes taken out."""
    found = (_QUOTED.sub("", m[1]) for m in _RECORD.finditer(text))
    return [r for r in found if r.strip()]


def _evidence(counts: list[int]) -> float:
    """The log likelihood ratio of two models of how often a mark occurs in each record: as the delimiter of a table, nearly
    always the same number of times; or at random, at its mean rate."""
    usual, times = Counter(counts).most_common(1)[0]
    usual = max(c for c, n in Counter(counts).items() if n == times)
    if not usual:
        return -math.inf
    rate = sum(counts) / len(counts)

    def ratio(n: int) -> float:
        table = math.log(_USUAL) if n == usual else math.log(1 - _USUAL) + abs(n - usual) * math.log(_RARER)
        return table - (n * math.log(rate) - rate - math.lgamma(n + 1))

    return sum(map(ratio, counts))


def detect_delimiter(text: str, guess: str = ",") -> tuple[str, float]:
    """(delimiter, its probability among the candidates and no delimiter at all), by the evidence of a sample's records. Marks
    that all stand within values count half as likely in records that another candidate splits too. Fewer than three records
    tell nothing: probability 0."""
    records = sample_records(text)
    counts = {d: [r.count(d) for r in records] for d in CANDIDATES}
    scores = {}
    for d, own in counts.items():
        if any(own):
            scores[d] = _evidence(own)
            if d in _INNER:
                others = [any(counts[e][k] for e in CANDIDATES if e != d) for k in range(len(records))]
                scores[d] -= math.log(2) * sum(n > 0 and o and len(_INNER[d].findall(r)) == n for n, o, r in zip(own, others, records, strict=True))
    best = max(scores, key=scores.get, default=None)
    if best is None or scores[best] == -math.inf:
        return guess, 0.0
    weights = [math.exp(min(s, 700) - min(scores[best], 700)) for s in scores.values()] + [math.exp(-min(scores[best], 700))]
    return best, 1 / sum(weights) if len(records) >= 3 else 0.0
