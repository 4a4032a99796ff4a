"""Operators do the whole job: recall and precision of near copies, targets met, toxic rows rejected, spans in every form."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sheetframe.llm import common, mixing, pii, quality, simhash


def edited(rng, words, changes):
    out = list(words)
    for at in rng.sample(range(len(words)), changes):
        out[at] = f"edit{rng.randrange(10**6)}"
    return " ".join(out)


def near_pairs(low, high, n=40, seed=8):
    """Texts in pairs (ids 2k and 2k + 1) whose five-word similarity is from low to under high."""
    rng, rows = random.Random(seed), []
    while len(rows) < 2 * n:
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(150, 400))]
        other = edited(rng, words, rng.randrange(3, 20))
        if low <= simhash.shingle_similarity(" ".join(words), other) < high:
            rows += [(len(rows), " ".join(words), "en"), (len(rows) + 1, other, "en")]
    return rows


def test_near_stage_keeps_documents_under_the_threshold(spark):
    rows = near_pairs(0.65, 0.79)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert simhash.drop_near_duplicates(docs).count() == len(rows)


def test_near_stage_finds_documents_over_the_threshold(spark):
    rows = near_pairs(0.8, 0.86)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept >= set(range(0, len(rows), 2))
    assert len(kept) <= 1.1 * len(rows) / 2


def test_mixing_meets_targets_of_a_rare_domain_by_default(spark):
    docs = [(k, 100, [0.0, 1.0] if k % 1000 == 0 else [1.0, 0.0]) for k in range(4000)]
    members = spark.createDataFrame(docs, "doc_id long, tokens long, p array<double>")
    targets = np.array([0.86, 0.14]) * 400_000
    got = mixing.fit_rates(members, targets).toPandas()
    reached = (got.rate * got.tokens).to_numpy() @ np.stack(got.p)
    assert np.allclose(reached / targets, 1, atol=mixing.TOLERANCE)


def test_toxic_rows_are_rejected_and_clean_ones_kept(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(600):
        text = [rng.choice(words) for _ in range(150)]
        if k % 6 == 0:
            for at in rng.sample(range(150), 3):
                text[at] = rng.choice(["vile", "nasty", "awful"])
        if k % 6 == 1:
            text = ["###"] * 150
        rows.append((k, " ".join(text), "en"))
        if k % 12 < 6:
            labels.append((k, int(k % 6 != 1), int(k % 6 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.keep_good(docs, marks).collect()}
    held = [k for k in range(600) if k % 12 >= 6]
    assert sum(k in kept for k in held if k % 6 == 0) <= 0.1 * len(held) / 6
    assert sum(k in kept for k in held if k % 6 > 1) >= 0.95 * len(held) * 4 / 6


def test_accounts_and_secrets_in_every_form():
    def spans(text):
        return [(kind, text[start:end]) for start, end, kind in pii.find_spans(text) if kind in ("account", "secret")]

    iban, grouped = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    for text in (f"IBAN {iban} BIC COBADEFFXXX", f"IBAN:{iban}", f"Iban {iban}.", f"iban = {iban} 12 EUR", f"IBAN: {iban}"):
        assert spans(text) == [("account", iban)], text
    assert spans(f"IBAN {grouped} BIC COBADEFFXXX") == [("account", grouped)]
    assert spans(f"IBAN {iban[:-1]}1 BIC") == [] and spans(f"IBAN {iban}7") == []
    key = "abcd1234efgh5678"
    for text in (f'token="{key}"', f"token: {key}", f'token = "{key}"', f"TOKEN={key}", f'{{"token": "{key}"}}', f"Password={key}", f"İ Secret : {key}"):
        assert spans(text) == [("secret", key)], text
    for text in (f"Authorization: Bearer {key}", f"api-key: {key}", f"apiKey={key}", f"ACCESS_KEY = '{key}'"):
        assert spans(text) == [("secret", key)], text
    assert spans(f"pay to {iban}, or {grouped}; not x{iban} or {iban.lower()}") == [("account", iban), ("account", grouped)]
    assert spans("the token of a password, secret to all, bearer of news") == []


def families(rng, equal, n=8):
    """Rows (id, text) in pairs that are alike, 2k and 2k + 1, of texts that all have the same two-word shingles or, if not
    equal, nearly the same, since each has two words of its own: short pieces between one and the same word, in any order."""
    pieces = [f"a{k} b{k} c{k}" for k in range(120)]
    rows = []
    for _ in range(n):
        rng.shuffle(pieces)
        for _ in range(2):
            at = rng.randrange(len(pieces) - 1)
            own = list(pieces)
            own[at], own[at + 1] = own[at + 1], own[at]
            words = " pivot ".join(["", *own, ""]).split()
            rows.append((len(rows), " ".join(words) if equal else edited(rng, words, 2)))
    return rows


@pytest.mark.parametrize("equal", [True, False])
def test_near_stage_loses_no_pair_of_a_large_group(spark, equal):
    rows = families(random.Random(5), equal, 8 if equal else 40)
    alike = {(a, b) for a, x in rows for b, y in rows if a < b and simhash.shingle_similarity(x, y) >= 0.8}
    assert alike == {(k, k + 1) for k in range(0, len(rows), 2)}
    prints = {d: simhash.fingerprint(t.encode(), 2, tables=12) for d, t in rows}
    assert all(any((x ^ y).bit_count() <= 4 for x, y in zip(prints[a], prints[b], strict=True)) for a, b in alike)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.alike_documents(docs).collect()}
    assert got == {d: d // 2 * 2 for d, _ in rows}


@pytest.mark.parametrize("most", [8192, 5])
def test_pairs_between_parts_of_groups_equal_brute_force(spark, most):
    rng = random.Random(2)
    texts = families(rng, True, 6) + families(rng, False, 6)
    rows, tables, seen = [], 3, {}
    for node, (_, text) in enumerate(texts):
        seen[node] = text, simhash.fingerprint(text.encode(), 2, tables=tables)
        rows += [(t, p - 2**64 if p >= 2**63 else p, node) for t, p in enumerate(seen[node][1])]
    saved = simhash.saved
    held = saved(spark.createDataFrame(rows, "table int, fp long, node long"))
    found = simhash.ball_candidates(saved(held.select("table", "fp").distinct())).select("table", "bits", "key", "root", "a")
    equal = held.groupBy("table", "fp").count().where("count > 1").selectExpr("table", "0 as bits", "fp as key", "fp as root", "fp as a")
    label = {node: node // 5 * 5 for node in seen}
    labels = saved(spark.createDataFrame(list(label.items()), "node long, label long"))
    named = saved(spark.createDataFrame([(n, t) for n, (t, _) in seen.items()], "node long, text string"))
    got = {tuple(r) for r in simhash._crossings(saved(found.union(equal)), held, labels, named, 4, 0.8, most).collect()}
    within = {(a, b) for a in seen for b in seen if a < b and any((x ^ y).bit_count() <= 4 for x, y in zip(seen[a][1], seen[b][1], strict=True))}
    assert got <= {(a, b) for a, b in within if label[a] != label[b]}
    assert got >= {(a, b) for a, b in within if label[a] != label[b] and simhash.shingle_similarity(seen[a][0], seen[b][0]) >= 0.8}
    every = simhash._crossings(saved(found.union(equal)), held, labels, named, 4, 0.0, most)
    assert {tuple(r) for r in every.collect()} == {(a, b) for a, b in within if label[a] != label[b]}


def test_python_takes_long_texts_by_pieces(spark):
    rows = [(k, f"{k} " * 1000) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)

    def scan(batch):
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([t[:8] for t in batch.column(1).to_pylist()]), pa.array([batch.nbytes] * batch.num_rows, pa.int64())], names=["doc_id", "text", "size"])

    found = common.map_arrow(docs, scan, "doc_id long, text string, size long").collect()
    assert sorted((r["doc_id"], r["text"]) for r in found) == [(k, t[:8]) for k, t in rows]
    assert max(r["size"] for r in found) <= 2 * 2**20


def test_pieces_cut_no_row_and_keep_their_order():
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(["x" * (k * 10**5) for k in range(40)])], names=["doc_id", "text"])
    cut = list(common.pieces([batch, batch.slice(0, 0), batch.slice(0, 2)]))
    assert pa.Table.from_batches(cut).to_pylist() == batch.to_pylist() + batch.slice(0, 2).to_pylist()
    assert len(cut) > 2


def test_further_links_join_components_without_all_links_again(spark, monkeypatch):
    asked, whole = [], simhash.connected_components

    def counted(edges):
        asked.append(edges.count())
        return whole(edges)

    monkeypatch.setattr(simhash, "connected_components", counted)
    rows = families(random.Random(5), False, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.alike_documents(docs).collect()}
    assert got == {d: d // 2 * 2 for d, _ in rows}
    assert sum(asked) <= len(rows) // 2


@pytest.mark.parametrize("seed", [1, 2])
def test_merged_labels_equal_components_of_all_links(spark, seed):
    rng = random.Random(seed)
    some = [(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(25)) if a < b]
    more = [(a, b) for a, b in ((rng.randrange(90), rng.randrange(90)) for _ in range(20)) if a < b] + [(200, 201), (201, 202)]
    links = lambda rows: simhash.saved(spark.createDataFrame(rows, "a long, b long"))
    got = simhash._merged(simhash.connected_components(links(some)), links(more)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, simhash.connected_components(links(some + more)).collect()))
