"""Substring dedup by repeated-phrase automata.

A window is WINDOW consecutive words. Its anchor is the GRAM-word phrase in it with the least hash, leftmost of equals, so
equal windows have equal anchors. Three passes over narrow or routed rows find what repeats:

1. Anchors (hash, document, place) of all documents are range-partitioned and sorted; those that occur once drop out.
2. Documents meet their recurring anchors, and the words around each (all windows that have it as their anchor) go to the
   shard of the anchor. A shard confirms the windows that recur, word for word, compiles them into an Aho-Corasick automaton
   and streams its segments through it, which locates every occurrence but the first.
3. Anchor groups that a shard's edge cuts, such as the phrase that a third of all documents share, are open: each shard also
   gives the first place of each of their windows, once per shard, and an aggregate over those finds which is first of all.

So an automaton is compiled once, sees only words that could match it, and its size is bounded by SHARD_SEGMENTS; streaming
work grows with the recurring text. Shuffle files of a finished step are let go before the next one.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collect_garbage, map_arrow, release, saved, shuffle_partitions, text_of

WINDOW = 20
GRAM = 8
#: Segments of at most 2 x WINDOW - GRAM words that one automaton is compiled from.
SHARD_SEGMENTS = 12_000

#: Bits of an anchor's place that say how many further windows have it.
_MORE = 20

_ODD = np.array([0x9E3779B97F4A7C15], np.uint64)
#: Words are numbered to characters from here on: past the surrogates, room for 900,000 in a shard.
_FIRST_SYMBOL = 0x10000


def gram_hashes(words: list[bytes], gram: int) -> np.ndarray:
    """A mixed 64-bit hash of each `gram` consecutive words."""
    of = xxhash.xxh64_intdigest
    hashes = np.array([of(w) for w in words], np.uint64)
    out, odd, size = hashes, _ODD, 1
    while size * 2 <= gram:  # pairs of pairs, then what is left word by word
        out = out[:-size] * odd + out[size:]
        odd, size = odd * odd, size * 2
    for k in range(size, gram):
        out = out[: len(hashes) - k] * _ODD + hashes[k:]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def anchors(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window) of each anchor of a document, in order of place."""
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = gram_hashes(words, gram)
    place = np.lib.stride_tricks.sliding_window_view(hashes, window - gram + 1).argmin(1) + np.arange(len(words) - window + 1)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(place) - 1]])
    return hashes[place[first]], first, last


def _anchor_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            hashes, first, last = anchors(text.split(), window, gram)
            if len(hashes):
                found.append((hashes.view(np.int64), np.full(len(hashes), doc), first << _MORE | (last - first)))
        if not found:
            found = [(np.zeros(0, np.int64),) * 3]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found, strict=True)], names=["a", "doc", "at"])

    return map_arrow(docs, scan, "a long, doc long, at long")


def recurring_anchors(rows: DataFrame) -> DataFrame:
    """Anchors (a, doc, at; a written table, since splitters are sampled from it) to those that occur more than once, and those
    at the edge of a partition, which might; at is first window << _MORE | further windows."""
    n = shuffle_partitions(rows.sparkSession)
    placed = rows.repartitionByRange(n, "a", "doc", "at").sortWithinPartitions("a", "doc", "at")

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, head = None, None  # the last row so far, and whether it equals the one before
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy() for c in batch.columns]
            if held is None:
                head, before = cols[0][0], True
            else:
                cols, before = [np.concatenate([h, c]) for h, c in zip(held[0], cols, strict=True)], held[1]
            same = cols[0][1:] == cols[0][:-1]
            keep = np.concatenate([[before], same]) | np.concatenate([same, [False]]) | (cols[0] == head)
            held = [c[-1:] for c in cols], bool(same[-1]) if len(same) else before
            own = np.flatnonzero(keep[:-1])
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(c[:-1][own]) for c in cols], names=["a", "doc", "at"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names=["a", "doc", "at"])

    return placed.mapInArrow(walk, "a long, doc long, at long")


class Shard:
    """Segments of some anchor groups, in order of (anchor, document, place); confirms and locates what recurs in them.

    Equal segments are one line with several places. The automaton holds the lines that have more than one place, and the
    windows that different lines share; a match counts where the first place of its phrase is an earlier one."""

    def __init__(self, window: int):
        self.window = window
        self.places: list[tuple[int, int, int, bool]] = []  # (document, first word, line, open group)
        self.numbers: dict[str, int] = {}
        self.lines: list[str] = []
        self.firsts: list[int] = []
        self.repeated: set[int] = set()
        self.symbols: dict[str, str] = {}

    def add(self, doc: int, first: int, text: str, is_open: bool) -> None:
        line = self.numbers.setdefault(text, len(self.lines))
        if line == len(self.lines):
            symbols = self.symbols
            self.lines.append("".join([symbols.get(w) or symbols.setdefault(w, chr(_FIRST_SYMBOL + len(symbols))) for w in text.split(" ")]))
            self.firsts.append(len(self.places))
        elif self.places[self.firsts[line]][:2] != (doc, first):
            self.repeated.add(line)
        self.places.append((doc, first, line, is_open))

    def run(self) -> Iterator[tuple]:
        """(doc, first word, end word, None, None) of what repeats an earlier place of the shard; and (doc, first, end, key,
        key) of the first place of each window of an open group."""
        w, seen, shared = self.window, {}, {}
        texts = list(self.numbers)
        for number, line in enumerate(self.lines):
            doc, first, _, is_open = self.places[self.firsts[number]]
            for i in range(len(line) - w + 1):
                key = line[i : i + w]
                here = (doc, first + i)
                at = seen.setdefault(key, here)
                if at is not here:
                    if at != here:
                        shared[key] = at
                elif is_open:
                    text = " ".join(texts[number].split(" ")[i : i + w]).encode("utf-8", "surrogatepass")
                    yield doc, first + i, first + i + w, xxhash.xxh3_64_intdigest(text, 1) - 2**63, xxhash.xxh64_intdigest(text, 2) - 2**63
        if not shared and not self.repeated:
            return
        automaton = ahocorasick.Automaton()
        for key, at in shared.items():
            automaton.add_word(key, (w, *at))
        for number in self.repeated:
            line = self.lines[number]
            if line not in shared:
                automaton.add_word(line, (len(line), *self.places[self.firsts[number]][:2]))
        automaton.make_automaton()
        for doc, first, number, _ in self.places:
            begin = end = -1
            for last, (size, at_doc, at_first) in automaton.iter(self.lines[number]):
                start = first + last - size + 1
                if (at_doc, at_first) < (doc, start):
                    if begin < 0:
                        begin, end = start, start + size
                    else:  # all matches have the anchor in common, so they make one span
                        begin, end = min(begin, start), max(end, start + size)
            if begin >= 0:
                yield doc, begin, end, None, None


_FOUND = "doc long, first long, end long, k1 long, k2 long"


def _emit(rows: Iterable[tuple], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def give() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names=["doc", "first", "end", "k1", "k2"])

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield give()
            held.clear()
    if held:
        yield give()


def _splitters(found: DataFrame, n: int) -> list[tuple[int, int, int]]:
    """Keys (a, document, first window) that part the anchors into n ranges of about equal size, from a sample of some dozens
    for each range."""
    total = found.count()
    sample = sorted((r["a"], r["doc"], r["at"] >> _MORE) for r in found.sample(fraction=min(1.0, 50.0 * n / max(total, 1)), seed=5).collect())
    return sorted({sample[len(sample) * k // n] for k in range(1, n)}) if sample else []


def locate(docs: DataFrame, found: DataFrame, window: int = WINDOW, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """docs (doc, text) and their recurring anchors, a written table, to _FOUND rows, as Shard.run() gives them. Segments are
    placed by splitters taken from the anchors, so that the texts are cut once."""
    n = shuffle_partitions(docs.sparkSession)
    edges = _splitters(found, n)
    lists = found.groupBy(F.col("doc").alias("of")).agg(F.collect_set(F.struct("a", "at")).alias("anchors"))
    joined = docs.join(lists, docs["doc"] == lists["of"]).select("doc", "text", F.col("anchors.a").alias("a"), F.col("anchors.at").alias("at"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[], [], [], [], []]

        def give() -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["part", "a", "doc", "first", "words"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                words = row[1].encode("utf-8", "surrogatepass").split()
                for a, at in zip(row[2], row[3], strict=True):
                    first, more = at >> _MORE, at & ((1 << _MORE) - 1)
                    for to, value in zip(cols, (bisect_right(edges, (a, row[0], first)), a, row[0], first, b" ".join(words[first : first + more + window]).decode("utf-8", "surrogatepass")), strict=True):
                        to.append(value)
                if len(cols[0]) >= 20_000:
                    yield give()
                    cols = [[], [], [], [], []]
        if cols[0]:
            yield give()

    segments = joined.mapInArrow(cut, "part int, a long, doc long, first long, words string")
    placed = segments.repartitionById(n, F.col("part")).sortWithinPartitions("a", "doc", "first").select("a", "doc", "first", "words")

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        rows: list[tuple] = []  # whole groups, then the current one, which began at `begun`
        begun, cut_before = 0, True

        def flush(to: int, last_open: bool) -> Iterator[tuple]:
            shard, first_a, last_a = Shard(window), rows[0][0], rows[to - 1][0]
            for a, doc, first, words in rows[:to]:
                shard.add(doc, first, words, cut_before and a == first_a or last_open and a == last_a)
            yield from shard.run()

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if rows and row[0] != rows[-1][0]:
                    begun = len(rows)
                rows.append(row)
                if len(rows) > shard_segments:
                    if begun:
                        yield from flush(begun, False)
                        rows, begun, cut_before = rows[begun:], 0, False
                    else:
                        yield from flush(len(rows) - 1, True)
                        rows, cut_before = rows[-1:], True
        if rows:
            yield from flush(len(rows), True)

    return placed.mapInArrow(lambda batches: _emit(shards(batches)), _FOUND)


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, first, end): word spans that a window covers whose words also start earlier, in a smaller id or in the same one
    further left; spans of a document may overlap. A written table."""
    if not 0 < gram <= window <= 1 << _MORE:
        raise ValueError(f"a window of 1 to {1 << _MORE} words and an anchor of no more are asked for")
    own = docs.select(docs[id_col].cast("long").alias("doc"), text_of(docs, text_col).alias("text")).where("doc is not null")
    rows = saved(_anchor_rows(own, window, gram))
    found = saved(recurring_anchors(rows))
    release(rows)
    collect_garbage(docs.sparkSession)
    located = saved(locate(own, found, window))
    release(found)
    collect_garbage(docs.sparkSession)
    places = located.where("k1 is not null")
    firsts = saved(places.groupBy(F.col("k1").alias("f1"), F.col("k2").alias("f2")).agg(F.min(F.struct("doc", "first")).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"))
    late = places.join(firsts, (places["k1"] == firsts["f1"]) & (places["k2"] == firsts["f2"])).where(F.struct("doc", "first") != F.col("least"))
    spans = saved(located.where("k1 is null").select("doc", "first", "end").union(late.select("doc", "first", "end")))
    release(located, firsts)
    collect_garbage(docs.sparkSession)
    return spans


def strip_repeats(text: str, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Words, words in spans, and the words left, joined by one space."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not spans:
        return len(words), 0, b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for first, end in spans:
        gone[min(first, len(words))] += 1
        gone[min(end, len(words))] -= 1
    covered = np.cumsum(gone[:-1]) > 0
    return len(words), int(covered.sum()), b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c])


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 and, with_text, kept. Words are split at the six ASCII
    white-space characters and taken as they are; a null text has none. A row without id takes no part: nothing is removed
    from it or for it. Rows of one id are one document: they aren't removed for each other, and what is found in one of them
    goes, by place, from all. An empty table gives an empty result; columns of docs other than id and text aren't read."""
    spans = repeated_spans(docs, window, gram, id_col, text_col)
    lists = spans.groupBy(F.col("doc").alias("of")).agg(F.collect_set(F.struct("first", "end")).alias("spans"))
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    joined = own.join(lists, own["doc_id"] == lists["of"], "left").select("doc_id", "text", F.col("spans.first").alias("first"), F.col("spans.end").alias("end"))

    def strip(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [strip_repeats(t, list(zip(a, b, strict=True)) if a else []) for t, a, b in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
        cols = [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in out], pa.string())]
        cols += [pa.array([x[2].decode("utf-8", "surrogatepass") for x in out], pa.string())] * with_text
        return pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + with_text])

    return map_arrow(joined, strip, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
