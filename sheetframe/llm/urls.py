"""URL filter: fixed host and path rules first, then words in the host.

Host names are often words written together. A unigram Viterbi cuts each label of a host into its likeliest words, by word
counts over the pages themselves; multinomial naive Bayes then scores the words of host and path. It learns from the pages
that a rule decides, without the words that the rules themselves are made of, which would only repeat them.

Nothing is cut off or passes through the driver but 2 x BUCKETS sums: the counts of all words are a written table, and so are
the distinct hosts; the substrings of their labels are joined with the counts, so that Viterbi has every count that it can ask
for. Each host is cut once, however many pages it has.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, release, saved

BUCKETS = 1 << 15
#: A label of a host name has 63 characters at most (fixed value of the DNS); what is longer is no label and stays one word.
LABEL = 63

_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_TAG = re.compile(r"<[^>]*>")
_WORD = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r"[0-9]+|[^\W\d_]+")


def _is_number(part: str) -> bool:
    return part[0] in "0123456789"


@dataclass(frozen=True)
class Rule:
    """A host with its subdomains, and what the path starts with."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: str, path: str) -> bool:
        return (host == self.host or host.endswith("." + self.host)) and path.startswith(self.path)


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ://."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    at = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:at], rest[at:]
    at = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    return host.translate(_ASCII_LOWER), rest[:at]


def longest_rule(host: str, path: str, rules: tuple[Rule, ...] = RULES) -> Rule | None:
    return max((r for r in rules if r.fits(host, path)), key=lambda r: len(r.name), default=None)


def rule_words(rules: tuple[Rule, ...]) -> frozenset[str]:
    """The parts that hosts and paths of the rules consist of."""
    return frozenset(w for r in rules for w in _PARTS.findall(f"{r.host} {r.path}".lower()))


@dataclass
class Segmenter:
    """Unigram Viterbi over word counts; total is the number of words counted."""

    counts: dict[str, int]
    total: int

    def score(self, word: str) -> float:
        n = self.counts.get(word, 0)
        # An unknown word costs as one occurrence, and ten times less for each letter.
        return math.log(n / self.total) if n else -math.log(self.total) - 2.303 * len(word)

    def words(self, label: str) -> list[str]:
        """The likeliest words that make up the label; of equal ways the one whose last words are longest."""
        if len(label) > LABEL:
            return [label]
        best, back = [0.0], [0]
        for end in range(1, len(label) + 1):
            score, start = max(((best[k] + self.score(label[k:end]), k) for k in range(end)), key=lambda x: (x[0], -x[1]))
            best.append(score)
            back.append(start)
        cut, end = [], len(label)
        while end:
            cut.append(label[back[end] : end])
            end = back[end]
        return cut[::-1]


def host_tokens(host: str, segmenter: Segmenter) -> list[str]:
    """Words of the host; a number counts as one word."""
    return [t for part in _PARTS.findall(host.lower()) for t in (["h:#"] if _is_number(part) else ["h:" + w for w in segmenter.words(part)])]


def path_tokens(path: str) -> list[str]:
    return ["p:#" if _is_number(part) else "p:" + part for part in _PARTS.findall(path.lower())]


def bucket(token: str) -> int:
    return xxhash.xxh64_intdigest(token) % BUCKETS


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """word, n: how often each word occurs in the text of all pages, lower-cased; no word is left out."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for html in batch.column(0).to_pylist():
                if html:
                    seen.update(_WORD.findall(_TAG.sub(" ", html).lower()))
            if len(seen) > 200_000:
                yield give()
                seen.clear()
        if seen:
            yield give()

    return pages.select(pages[html_col].alias("html")).mapInArrow(scan, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def cut_hosts(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """hosts (host, distinct) and counts (word, n), both written tables, to host, tokens array<string>."""
    total = max(2, counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])

    def parts(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = {p for host in batch.column(0).to_pylist() for p in _PARTS.findall(host.lower()) if not _is_number(p) and len(p) <= LABEL}
        return pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["label"])

    labels = saved(map_arrow(hosts.select("host"), parts, "label string").distinct())
    n = F.length("label")
    starts = labels.select("label", F.explode(F.sequence(F.lit(1), n)).alias("at"))
    pieces = starts.select("label", F.explode(F.transform(F.sequence(F.lit(1), n - F.col("at") + 1), lambda size: F.substring("label", F.col("at"), size))).alias("piece")).distinct()
    known = saved(pieces.join(counts, pieces["piece"] == counts["word"]).groupBy("label").agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("ns")))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [Segmenter(dict(zip(words or [], ns or [], strict=True)), total).words(label) for label, words, ns in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["label", "cut"])

    of = known.withColumnRenamed("label", "of")
    cuts = saved(map_arrow(labels.join(of, labels["label"] == of["of"], "left").select("label", "words", "ns"), cut, "label string, cut array<string>"))

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(host, k, p) for host in batch.column(0).to_pylist() for k, p in enumerate(_PARTS.findall(host.lower()))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.string(), pa.int32(), pa.string()), strict=True)], names=["host", "k", "part"])

    each = map_arrow(hosts.select("host"), spread, "host string, k int, part string")
    of_part = F.when(F.col("part").rlike("^[0-9]+$"), F.array(F.lit("#"))).otherwise(F.coalesce("cut", F.array("part")))
    words = each.join(cuts, each["part"] == cuts["label"], "left").select("host", F.struct("k", of_part.alias("words")).alias("x"))
    tokens = words.groupBy("host").agg(F.array_sort(F.collect_list("x")).alias("x")).select("host", F.transform(F.flatten("x.words"), lambda w: F.concat(F.lit("h:"), w)).alias("tokens"))
    out = saved(tokens)
    release(labels, known, cuts)
    return out


def _counted(parts: DataFrame, left_out: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """parts (rule_verdict, path, tokens) of the pages that a rule decides to pages (2) and hashed token counts (2 x BUCKETS) of
    the classes allow and block."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for verdict, path, host in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k = int(verdict == "block")
                n[k] += 1
                for token in [*(host or []), *path_tokens(path)]:
                    if token[2:] not in left_out:
                        seen[k, bucket(token)] += 1
        at = np.flatnonzero(seen.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-2, -1]]).astype(np.int32)), pa.array(np.concatenate([seen.ravel()[at], n]))], names=["at", "n"])

    counts, n = np.zeros(2 * BUCKETS), np.zeros(2)
    for r in parts.mapInArrow(scan, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        (n if r["at"] < 0 else counts)[r["at"]] = r["n"]
    return n, counts.reshape(2, BUCKETS)


SCHEMA = "page_id long, host string, path string, rule string, verdict string, words string"


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, seeds: dict[str, dict[str, int]] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, host, path, the longest rule that fits (null if none; of equally long ones the first),
    the verdict (the rule's, else naive Bayes', ties to allow) and the words that were scored. seeds adds observations of
    words: class to word to number. A null or empty url has neither host nor path, and no words: the prior decides. Without a
    page that a rule decides all others are allowed, unless seeds say otherwise. Null html has no words; repeated rows are
    judged alike and each count; an empty table gives an empty result; other columns of pages aren't read."""
    own = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"))
    left_out = rule_words(rules)

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], []]
        for url in batch.column(1).to_pylist():
            host, path = split_url(url)
            rule = longest_rule(host, path, rules)
            for to, value in zip(cols, (host, path, rule and rule.name, rule and rule.verdict), strict=True):
                to.append(value)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in cols)], names=["page_id", "host", "path", "rule", "rule_verdict"])

    parts = saved(map_arrow(own, split, "page_id long, host string, path string, rule string, rule_verdict string"))
    counts = saved(word_counts(pages, html_col))
    hosts = saved(parts.select("host").distinct())
    cut = cut_hosts(hosts, counts).withColumnRenamed("host", "of")
    joined = saved(parts.join(cut, parts["host"] == cut["of"], "left").select("page_id", "host", "path", "rule", "rule_verdict", "tokens"))
    release(parts, counts, hosts)
    n, seen = _counted(joined.where("rule is not null").select("rule_verdict", "path", "tokens"), left_out)
    for k, verdict in enumerate(("allow", "block")):
        for word, times in (seeds or {}).get(verdict, {}).items():
            for token in ("h:" + word, "p:" + word):
                seen[k, bucket(token)] += times
    prior = np.log((n + 1) / (n.sum() + 2))
    weight = np.log((seen + 1) / (seen.sum(1, keepdims=True) + BUCKETS))
    offset, log_ratio = float(prior[1] - prior[0]), weight[1] - weight[0]
    if not n.sum():
        offset = 0.0

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, verdicts = [], []
        for path, given, host in zip(*(batch.column(c).to_pylist() for c in (2, 4, 5)), strict=True):
            tokens = [t for t in [*(host or []), *path_tokens(path)] if t[2:] not in left_out]
            score = offset + sum(log_ratio[bucket(t)] for t in tokens)
            verdicts.append(given or ("block" if score > 0 else "allow"))
            words.append(" ".join(tokens))
        return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdicts, pa.string()), pa.array(words, pa.string())], names=["page_id", "host", "path", "rule", "verdict", "words"])

    return map_arrow(joined, judge, SCHEMA)
