"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2h bits exactly when some value lies within h bits of both. So every distinct fingerprint
emits all values within h bits, values are shuffled, and fingerprints that meet at a value are linked. With h = 2 there are
2081 values for each fingerprint; they are sent by their leading bits only: a fingerprint goes once to each leading pattern
that its values have, and the task that owns the pattern makes the values' remaining bits itself. All fingerprints that
meet at a value are within 2h bits of each other, so linking each to its neighbour in sorted order links them all without
forming pairs; a task gives back a star per group it has found. Equal fingerprints count once, however many rows have them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collect_garbage, map_arrow, release, saved, text_of, without
from .components import connected_components


def fingerprint(text: bytes, words: int = 4, seed: int = 42, tables: int = 1) -> list[int]:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 if it has no word. Further tables hash the shingles'
    hashes once more, each its own way."""
    tokens = text.lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    if not tokens:
        return [0] * tables
    line = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    else:
        ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
        starts = np.concatenate([[0], ends[:-words] + 1])
        of = xxhash.xxh64_intdigest
        hashes = np.array([of(line[i:j], seed) for i, j in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)
    return [_majority(hashes if not t else _mixed(hashes, t)) for t in range(tables)]


def _mixed(hashes: np.ndarray, table: int) -> np.ndarray:
    x = hashes + np.uint64((table * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _majority(hashes: np.ndarray) -> int:
    # A byte per bit; rows are summed eight bits to a word, 255 at a time so that no byte overflows.
    lanes = np.unpackbits(hashes.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
    sums = np.zeros(64, np.int64)
    for k in range(0, len(lanes), 255):
        sums += lanes[k : k + 255].sum(0, dtype=np.uint64).view(np.uint8)
    return int(np.packbits(sums * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, tables: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long), more array<long> (those of further tables), one row per row."""

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(t, words, seed, tables) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints[:, 0]), pa.array(prints[:, 1:].tolist(), pa.list_(pa.int64()))], names=["doc_id", "fp", "more"])

    return map_arrow(docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text")), scan, "doc_id long, fp long, more array<long>")


@lru_cache(256)
def _masks(low: int, high: int, flips: int) -> np.ndarray:
    """All values with at most `flips` bits set, among bits low to high - 1."""
    return np.array([sum(1 << b for b in c) for k in range(flips + 1) for c in combinations(range(low, high), k)], np.uint64)


def _meetings(prints: np.ndarray, left: np.ndarray, free: int, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Neighbours (by place in prints) at every value whose bits above `free` are the task's own; left: the flips that each
    print may still make. More than `most` values are made a few leading bits at a time."""
    counts = np.array([sum(math.comb(free, k) for k in range(r + 1)) for r in range(int(left.max(initial=0)) + 1)])
    if len(prints) < 2:
        return []
    if counts[left].sum() > most and free > 4:
        out, top = [], (prints >> np.uint64(free - 4)) & np.uint64(15)
        for v in range(16):
            rest = left - np.bitwise_count(top ^ np.uint64(v)).astype(np.int64)
            own = np.flatnonzero(rest >= 0)
            out += [(own[a], own[b]) for a, b in _meetings(prints[own], rest[own], free - 4, most)]
        return out
    low = prints & np.uint64((1 << free) - 1)
    values, places = [], []
    for r in range(len(counts)):
        own = np.flatnonzero(left == r)
        if len(own):
            masks = _masks(0, free, r)
            values.append((low[own][:, None] ^ masks[None, :]).ravel())
            places.append(np.repeat(own, len(masks)))
    value, place = np.concatenate(values), np.concatenate(places)
    order = np.argsort(value)
    value, place = value[order], place[order]
    same = np.flatnonzero(value[1:] == value[:-1])
    return [(place[same], place[same + 1])]


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place of each place's group, given links between places."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _bucket_pairs(prints: np.ndarray, key: int, bits: int, radius: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs a < b (by place in prints, which are sorted) that are neighbours at a value with the leading bits `key`."""
    left = radius // 2 - np.bitwise_count((prints >> np.uint64(64 - bits)) ^ np.uint64(key % 2**64)).astype(np.int64)
    found = _meetings(prints, left, 64 - bits, most)
    a = np.concatenate([x for x, _ in found] or [np.zeros(0, np.int64)])
    b = np.concatenate([x for _, x in found] or [np.zeros(0, np.int64)])
    near = np.bitwise_count(prints[a] ^ prints[b]) <= radius
    pairs = np.unique(np.minimum(a, b)[near] * len(prints) + np.maximum(a, b)[near])
    return pairs // max(len(prints), 1), pairs % max(len(prints), 1)


def bucket_links(prints: np.ndarray, key: int, bits: int, radius: int, most: int = 2_000_000) -> np.ndarray:
    """Pairs (print, least print of its group) of distinct prints that meet at a value with the leading `bits` bits `key`."""
    prints = np.sort(prints)
    root = _stars(len(prints), *_bucket_pairs(prints, key, bits, radius, most))
    own = np.flatnonzero(root != np.arange(len(prints)))
    return np.stack([prints[own], prints[root[own]]])


def bucket_candidates(prints: np.ndarray, key: int, bits: int, radius: int, most: int = 500_000) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As bucket_links, but with what a check of the texts needs, for each print that meets another: (print, least print of its
    group, nearest print that it meets, its group's middle: the print nearest to the majority of the group's bits)."""
    prints = np.sort(prints)
    a, b = _bucket_pairs(prints, key, bits, radius, most)
    group = _stars(len(prints), a, b)
    one, two = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((two, np.bitwise_count(prints[one] ^ prints[two]), one))
    one, two = one[order], two[order]
    first = np.flatnonzero(np.r_[True, one[1:] != one[:-1]]) if len(one) else np.zeros(0, np.int64)
    own, near = one[first], two[first]
    size = np.bincount(group, minlength=len(prints))
    ones = np.stack([np.bincount(group, (prints >> np.uint64(k) & np.uint64(1)).astype(float), len(prints)) for k in range(64)], 1) * 2 > size[:, None]
    majority = np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()
    order = np.lexsort((np.arange(len(prints)), np.bitwise_count(prints ^ majority[group]), group))
    middle = np.zeros(len(prints), np.int64)
    start = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]]) if len(order) else np.zeros(0, np.int64)
    middle[group[order[start]]] = order[start]
    return prints[own], prints[group[own]], prints[near], prints[middle[group[own]]]


def leading_bits(n: int) -> int:
    """So many leading bits that about 2048 of n prints share a pattern; from 6 to 32."""
    return min(32, max(6, math.ceil(math.log2(max(n, 2))) - 11))


#: Prints that one task takes at most under a leading pattern; a pattern that has more is told apart by further bits.
MOST_PRINTS = 500_000
_FURTHER = 8


def _sent(prints: DataFrame, radius: int, most: int = MOST_PRINTS) -> DataFrame:
    """table, fp, key, bits, left: each print under each leading pattern (key, of so many bits) that its ball has, and the flips
    that it may still make in the other bits. Patterns of more than `most` prints, as templated texts make them, are split by
    further bits until none is left or all bits are used; what meets at a value still meets under its pattern."""
    if radius % 2:
        raise ValueError("an even radius is asked for")
    bits = leading_bits(prints.groupBy("table").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0])

    def lead(rows: DataFrame, low: int, high: int) -> DataFrame:
        return rows.withColumn("own", F.shiftrightunsigned("fp", 64 - high).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("long")))

    def spread(rows: DataFrame, low: int, high: int, what: str) -> DataFrame:
        """rows with their keys prolonged from the leading `low` to the leading `high` bits."""
        masks = F.array(*(F.lit(int(m)).cast("long") for m in _masks(0, high - low, flips)))
        longer = rows.withColumn("mask", F.explode(masks)).where(F.bit_count("mask") <= F.col("left"))
        key = F.shiftleft("key", high - low).bitwiseOR(F.col("own").bitwiseXOR(F.col("mask")))
        return longer.select("table", what, key.alias("key"), F.lit(high).alias("bits"), (F.col("left") - F.bit_count("mask")).alias("left"))

    flips, low, high, out = radius // 2, 0, bits, None
    rows = prints.select("table", "fp", F.lit(0).cast("long").alias("key"), F.lit(flips).alias("left"))
    while True:
        own = lead(rows, low, high)
        sent = spread(own, low, high, "fp")
        # How many prints a pattern gets follows from how many have each pattern themselves, a far smaller table.
        alike = own.groupBy("table", "key", "left", "own").agg(F.count("*").alias("n"))
        totals = spread(alike, low, high, "n").groupBy(F.col("table").alias("_t"), F.col("key").alias("_k")).agg(F.sum("n").alias("n"))
        crowded = saved(totals.where(F.col("n") > most).select("_t", "_k"))
        if high == 64 or crowded.isEmpty():
            return sent if out is None else out.unionByName(sent)
        at = (F.col("table") == F.col("_t")) & (F.col("key") == F.col("_k"))
        light = sent.join(crowded, at, "left_anti")
        out = light if out is None else out.unionByName(light)
        rows = saved(sent.join(crowded, at, "left_semi").select("table", "fp", "key", "left"))
        low, high = high, min(64, high + _FURTHER)


def ball_candidates(prints: DataFrame, radius: int = 4, most: int = MOST_PRINTS) -> DataFrame:
    """table, bits, key, root, a, near, hub: for each print that has others within radius, and each leading pattern (key, of so
    many bits) under which it meets one, its group's least print, and the nearest and the middle of bucket_candidates. Any two
    prints within radius are in one group under some pattern. prints as for ball_links."""
    sent = _sent(prints, radius, most)

    def meet(group: pa.Table) -> pa.Table:
        table, bits, key = (group.column(c)[0].as_py() for c in ("table", "bits", "key"))
        found = bucket_candidates(group.column("fp").to_numpy().view(np.uint64), key, bits, radius)
        n = len(found[0])
        of = {"table": np.full(n, table, np.int32), "bits": np.full(n, bits, np.int32), "key": np.full(n, key, np.int64)}
        return pa.table(of | {name: x.view(np.int64) for name, x in zip(("root", "a", "near", "hub"), (found[1], found[0], *found[2:]), strict=True)})

    return sent.groupBy("table", "bits", "key").applyInArrow(meet, "table int, bits int, key long, root long, a long, near long, hub long")


def _proposals(found: DataFrame) -> DataFrame:
    """table, a, b: of several patterns' the nearest of either kind of ball_candidates, so two for a print and table."""
    best = lambda b: F.min(F.when(F.col("a") != F.col(b), F.struct(F.bit_count(F.col("a").bitwiseXOR(F.col(b))).alias("bits"), F.col(b).alias("b"))))
    ends = found.groupBy("table", "a").agg(best("near").alias("near"), best("hub").alias("hub"))
    return ends.select("table", "a", F.explode(F.array("near.b", "hub.b")).alias("b")).where("b is not null").distinct()


def ball_links(prints: DataFrame, radius: int = 4, most: int = MOST_PRINTS) -> DataFrame:
    """Links (a, b) that join all fingerprints of one table within radius, an even number, of each other into one component.
    prints: table int, fp long, distinct, a written table."""
    sent = _sent(prints, radius, most)

    def meet(group: pa.Table) -> pa.Table:
        links = bucket_links(group.column("fp").to_numpy().view(np.uint64), group.column("key")[0].as_py(), group.column("bits")[0].as_py(), radius)
        return pa.table({"a": links[0].view(np.int64), "b": links[1].view(np.int64)})

    links = sent.groupBy("table", "bits", "key").applyInArrow(meet, "a long, b long")
    # A print has a root for each pattern it is found under, a bounded number. It keeps the least; the others are linked to
    # that, so that a large group gives a link per print and a few among its roots.
    roots = links.groupBy("a").agg(F.collect_set("b").alias("roots")).select("a", "roots", F.array_min("roots").alias("least"))
    pair = lambda x: F.struct(x.alias("a"), F.col("least").alias("b"))
    others = F.transform(F.filter("roots", lambda x: x != F.col("least")), pair)
    return roots.select(F.explode(F.concat(F.array(pair(F.col("a"))), others)).alias("link")).select("link.a", "link.b").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, seed: int = 42, tables: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (the least doc_id of all documents reachable by links of at most
    radius differing bits, in any table). Texts without words have fingerprint 0 and are linked like any other. A null text
    is empty; a null id takes its component's least id, null if no row there has one."""
    each = saved(fingerprints(docs, words, seed, tables, id_col, text_col))
    nodes = saved(each.groupBy("fp").agg(F.min("doc_id").alias("least")))
    prints = saved(each.select(F.posexplode(F.concat(F.array("fp"), "more")).alias("table", "fp")).distinct()) if tables > 1 else nodes.select(F.lit(0).alias("table"), "fp")
    links = saved(ball_links(prints, radius))
    edges = links
    if tables > 1:  # a linked fingerprint of a further table stands for the documents that have it
        ends = saved(links.select(F.explode(F.array("a", "b")).alias("end")).distinct())
        own = each.select("fp", F.explode("more").alias("other"))
        edges = saved(links.union(own.join(ends, own["other"] == ends["end"]).select("fp", "other").distinct()))
        release(prints, ends)
    out = _named(each, nodes, connected_components(edges))
    release(nodes, links, edges)
    return out.select("doc_id", "fp", "component_id")


def _named(each: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """each with component_id. nodes: the first column of each's nodes and least, the least id that a node has. labels: node,
    label, a written table that isn't needed after; a node without one is its own."""
    node = nodes.columns[0]
    rooted = saved(nodes.join(labels.withColumnRenamed("node", "_node"), nodes[node] == F.col("_node"), "left").select(node, "least", F.coalesce("label", node).alias("root")))
    roots = saved(rooted.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("component_id")))
    named = saved(rooted.join(roots, rooted["root"] == roots["of"]).select(F.col(node).alias("_named"), "component_id"))
    release(labels, rooted, roots)
    return each.join(named, each[node] == named["_named"]).drop("_named")


def shingle_similarity(a: str, b: str, words: int = 5) -> float:
    """Jaccard similarity of the sets of word shingles; a text of fewer words is one shingle, and none if it has no word."""
    x, y = _shingles(a, words), _shingles(b, words)
    return len(x & y) / len(x | y) if x or y else 1.0


def _shingles(text: str, words: int) -> set[tuple[bytes, ...]]:
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if len(tokens) <= words:
        return {tuple(tokens)} if tokens else set()
    return set(zip(*(tokens[k:] for k in range(words)), strict=False))


#: Bits of a text's sketch: each bit says whether an odd number of the text's distinct shingles hash to it.
SKETCH = 1024
#: Texts of a group that are compared with each other in one task; those of a larger group are compared block by block.
MOST_COMPARED = 8192


def sketch(text: str, words: int = 5) -> tuple[int, bytes]:
    """How many distinct shingles a text has, and the parities of their hashes. Two texts' sketches differ in no more bits than
    there are shingles that only one of them has."""
    shingles = _shingles(text, words)
    places = np.array([xxhash.xxh64_intdigest(b" ".join(s)) % SKETCH for s in shingles], np.int64)
    return len(shingles), np.packbits(np.bincount(places, minlength=SKETCH) & 1, bitorder="little").tobytes()


def _within(group: dict[str, np.ndarray], key: int, bits: int, radius: int, most: int = 250_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (by place) of a group's rows with prints (fp) within radius that don't have the one same label (low and high, the
    least and the greatest label of a row); if there are blocks, those within the one block or across the two. bits 0: all
    prints are equal. Else equal prints are left to such a group, and of the patterns that two prints have in common only that
    of one value between them gives their pair. About `most` pairs are looked at a time."""
    order = np.argsort(group["fp"], kind="stable")
    fp, low, high, block = (group[c][order] for c in ("fp", "low", "high", "block"))
    across, several = len(np.unique(block)) > 1, low != high
    step = max(1, most // max(len(fp), 1))
    for k in range(0, len(fp), step):
        x = slice(k, k + step)
        other = (low[x, None] != low[None, k:]) | (high[x, None] != high[None, k:]) | several[x, None]
        if across:
            other &= block[x, None] != block[None, k:]
        if bits:
            other &= np.bitwise_count(fp[x, None] ^ fp[None, k:]) <= radius
        a, b = np.nonzero(np.triu(other, 1))  # row k and column k are the same
        a, b = a + k, b + k
        if bits:
            rest, value = fp[a] ^ fp[b], fp[a].copy()
            good = rest != 0
            for _ in range(radius // 2):
                lowest = rest & (~rest + np.uint64(1))
                value ^= lowest
                rest ^= lowest
            good &= value >> np.uint64(64 - bits) == np.uint64(key % 2**64)
            a, b = a[good], b[good]
        yield order[a], order[b]


def crossing_pairs(group: dict[str, np.ndarray], key: int, bits: int, radius: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those pairs of _within whose similarity can be least or more by the texts' sizes and sketches, which are bounds."""
    size, sketches = group["size"], group["sketch"]
    for a, b in _within(group, key, bits, radius):
        good = np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b]) - 1e-6
        a, b = a[good], b[good]
        for j in range(0, len(a), 20_000):  # the similarity is (s - d) / (s + d): s shingles in both sets' sizes, d in one only
            one, two = a[j : j + 20_000], b[j : j + 20_000]
            apart = np.bitwise_count(sketches[one] ^ sketches[two]).sum(1, dtype=np.int64)
            good = apart * (1 + least) <= (size[one] + size[two]) * (1 - least) + 1e-6
            yield one[good], two[good]


def _crossings(met: DataFrame, held: DataFrame, labels: DataFrame, texts: DataFrame, radius: int, least: float, most: int = MOST_COMPARED) -> DataFrame | None:
    """Pairs a < b of nodes with prints within radius in a table that labels (node, label; a node without one is its own) keep
    apart and that can be alike; none if there is no group with several labels. met: groups (table, bits, key, root) and their
    prints a; held: table, fp, node; all written tables."""
    group = ["table", "bits", "key", "root"]
    parts = labels.select(F.col("node").alias("_node"), "label")
    tagged = saved(held.join(parts, held["node"] == F.col("_node"), "left").select("table", "fp", "node", F.coalesce("label", "node").alias("label")))
    spans = tagged.groupBy(F.col("table").alias("_table"), F.col("fp").alias("_fp")).agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"))
    each = met.join(spans, (F.col("table") == F.col("_table")) & (F.col("a") == F.col("_fp")))
    mixed = saved(each.groupBy(*group).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).where("low <> high").select(*group, F.ceil(F.col("n") / most).cast("int").alias("blocks")))
    if mixed.isEmpty():
        release(tagged, mixed)
        return None
    by = [*group, "one", "two"]

    def dealt(rows: DataFrame, what: str) -> DataFrame:
        """rows once for each pair of blocks that theirs is in."""
        rows = rows.withColumn("block", F.pmod(F.xxhash64(what), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return rows.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))

    def of(rows: pa.Table, *columns: str) -> tuple[dict[str, np.ndarray], int, int]:
        own = {c: rows.column(c).to_numpy() for c in ("block", *columns)} | {"fp": rows.column("fp").to_numpy().view(np.uint64)}
        return own, rows.column("key")[0].as_py(), rows.column("bits")[0].as_py()

    def partnered(rows: pa.Table) -> pa.Table:
        own, key, bits = of(rows, "low", "high")
        good = np.full(len(rows), bits == 0)
        if bits:
            for a, b in _within(own, key, bits, radius):
                good[a] = good[b] = True
        return rows.select([*group, "fp", "blocks"]).filter(pa.array(good))

    # Most patterns that a print is met under have none of its pairs; only where it has one are its texts fetched.
    prints = saved(each.select(*group, F.col("a").alias("fp"), F.col("low"), F.col("high")).join(mixed, group))
    paired = saved(dealt(prints, "fp").select(*by, "fp", "low", "high", "block", "blocks").groupBy(*by).applyInArrow(partnered, "table int, bits int, key long, root long, fp long, blocks int").distinct())
    nodes = saved(paired.join(tagged, ["table", "fp"]))
    wanted = nodes.select("node").distinct()

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sketch(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], names=["node", "size", "sketch"])

    sketches = saved(map_arrow(texts.join(wanted, "node", "left_semi").select("node", "text"), scan, "node long, size long, sketch binary"))
    rows = dealt(nodes.join(sketches, "node"), "node").select(*by, "fp", "node", "label", "block", "size", "sketch")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        own, key, bits = of(rows, "node", "label", "size")
        own |= {"low": own["label"], "high": own["label"], "sketch": np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(len(rows), -1)}
        for a, b in crossing_pairs(own, key, bits, radius, least):
            one, two = own["node"][a], own["node"][b]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], names=["a", "b"])

    out = saved(rows.groupBy(*by).applyInArrow(compare, "a long, b long").distinct())
    release(tagged, mixed, prints, paired, nodes, sketches)
    return out


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label; a node without one is its own) as further links (a, b) change them, both written tables. Components are
    linked by their labels, so that the links within them aren't gone through again."""
    of = lambda end: labels.select(F.col("node").alias(f"{end}_node"), F.col("label").alias(f"{end}_label"))
    one = saved(links.join(of("a"), F.col("a") == F.col("a_node"), "left").select(F.coalesce("a_label", "a").alias("a"), "b"))
    edges = saved(one.join(of("b"), F.col("b") == F.col("b_node"), "left").select("a", F.coalesce("b_label", "b").alias("b")).distinct())
    over = connected_components(edges)
    lifted = labels.join(over.select(F.col("node").alias("over_node"), F.col("label").alias("over")), F.col("label") == F.col("over_node"), "left")
    alone = over.join(labels.select("node"), "node", "left_anti")
    out = saved(lifted.select("node", F.coalesce("over", "label").alias("label")).union(alone.select("node", "label")))
    release(one, edges, over, labels)
    return out


def _alike(links: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Of links (a, b) between texts (node, text), both written tables, those with a five-word similarity of least or more.
    Both joins read written tables, so that adaptive execution can split the partition of a node with very many links."""
    one = saved(links.join(texts, links["a"] == texts["node"]).select("a", "b", F.col("text").alias("one")))
    both = one.join(texts, one["b"] == texts["node"]).select("a", "b", "one", "text")

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = [shingle_similarity(x, y) >= least for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    out = saved(map_arrow(both, scan, "a long, b long"))
    release(one)
    return out


def alike_documents(docs: DataFrame, words: int = 2, radius: int = 4, tables: int = 12, least: float = 0.8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, component_id (the least doc_id of all documents reachable by links). Fingerprints
    within radius bits in any table propose links; a link counts if the texts' five-word similarity is least or more. First, for
    each fingerprint and table, the nearest one met and its group's middle are compared, by a text of each, and the texts of
    equal fingerprints with one of them; then all further pairs of texts within radius that these links leave in different
    components, so that no link is lost. Nulls are as in near_duplicates."""
    text = text_of(docs, text_col)
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("node"), text.alias("text"))

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = [np.array(fingerprint(t, words, seed, tables), np.uint64).view(np.int64) for t in batch.column(2).cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.list_(pa.int64()))], names=["doc_id", "node", "fps"])

    each = saved(map_arrow(own, scan, "doc_id long, node long, fps array<long>"))
    nodes = saved(each.groupBy("node").agg(F.min("doc_id").alias("least")))
    parts, met, held = [], [], []  # met: groups and their prints; held: the texts that have these
    for first in range(0, tables, 4):  # a few tables at a time, so that their shuffles needn't be on disk together
        some = F.slice("fps", first + 1, 4)
        members = saved(each.select("node", F.posexplode(some).alias("table", "fp")).distinct())
        stands = saved(members.groupBy("table", "fp").agg(F.min("node").alias("stand"), F.count("*").alias("n")))
        found = saved(ball_candidates(stands.select("table", "fp"), radius))
        same = members.join(stands.drop("n"), ["table", "fp"]).select(F.col("node").alias("a"), F.col("stand").alias("b"))
        of = lambda end: stands.select(F.col("table").alias("_table"), F.col("fp").alias("_fp"), F.col("stand").alias(f"{end}_node"))
        ends = _proposals(found)
        for end in ("a", "b"):
            ends = ends.join(of(end), (F.col("table") == F.col("_table")) & (F.col(end) == F.col("_fp"))).drop("_table", "_fp")
        pairs = same.union(ends.select("a_node", "b_node")).where("a <> b")
        parts.append(saved(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
        equal = stands.where("n > 1").select("table", F.lit(0).alias("bits"), *(F.col("fp").alias(c) for c in ("key", "root", "a")))
        groups = found.select(*equal.columns).union(equal)
        own_table = (F.col("table") + first).alias("table")
        near = members.join(groups.select("table", F.col("a").alias("fp")).distinct(), ["table", "fp"], "left_semi")
        held.append(saved(near.select(own_table, "fp", "node")))
        met.append(saved(groups.select(own_table, "bits", "key", "root", "a")))
        release(members, stands, found)
        collect_garbage(docs.sparkSession)
    links = saved(reduce(DataFrame.union, parts).distinct())
    ends = saved(links.select(F.explode(F.array("a", "b")).alias("end")).distinct())
    texts = saved(own.join(ends, own["node"] == ends["end"], "left_semi").groupBy("node").agg(F.first("text").alias("text")))
    edges = _alike(links, texts, least)
    release(*parts, ends)
    labels = connected_components(edges)
    crossings = _crossings(reduce(DataFrame.union, met), reduce(DataFrame.union, held), labels, texts, radius, least)
    if crossings is not None:  # whatever has groups or equal prints has been an end of a link, so its text is in texts
        further = saved(crossings.join(links, ["a", "b"], "left_anti"))
        more = _alike(further, texts, least)
        labels = _merged(labels, more)
        release(crossings, further, more)
    release(*met, *held, edges, links, texts)
    collect_garbage(docs.sparkSession)
    out = _named(each, nodes, labels)
    release(nodes)
    return out.select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 2, radius: int = 4, tables: int = 12, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the one document of each component of alike_documents that has its least id (of rows with that id, all),
    columns as they are, whatever their names. Rows without id stay together unless one of them is like a document that has
    one. Null and empty texts are alike; an empty table gives an empty one."""
    found = alike_documents(docs, words, radius, tables, least, id_col=id_col, text_col=text_col)
    return without(docs, id_col, saved(found.where("not (doc_id <=> component_id)").select("doc_id").distinct()))
