"""The stages of the corpus pipeline on small tables, each on its own input."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sheetframe.llm.exact_dedup import drop_copies
from sheetframe.llm.simhash import shingle_similarity

WORDS = "alder birch cedar maple oak pine rowan spruce willow yew ash elm fir hazel holly larch".split()


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Documents with junk, exact and near copies, two languages, and labels for some."""
    rng = random.Random(11)
    folder = tmp_path_factory.mktemp("tables")
    docs, labels = [], []
    for k in range(240):
        bad = k % 8 == 0
        words = [rng.choice(WORDS) + rng.choice(["", "s", "en"]) for _ in range(rng.randrange(40, 120))]
        if k % 3 == 0:
            words = [w[::-1] for w in words]
        if bad:
            words = [w.upper() + "!!!" for w in words]
        docs.append((k, " ".join(words), "fr" if k % 3 == 0 else "en", f"src{k % 4}"))
        if k % 2 == 0:
            labels.append((k, int(not bad), 0))
    docs += [(300 + k, docs[k][1].upper() if k % 2 and k % 8 else docs[k][1], docs[k][2], "copy") for k in range(1, 20)]
    near = docs[5][1].split()
    for k in range(4):
        near[(10 + 15 * k) % len(near)] = f"edit{k}"
        docs.append((400 + k, " ".join(near), "en", "near"))
    rows = [(d, t, lang, s, len(t)) for d, t, lang, s in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def alike(rows, least=0.8):
    """The least id of each component of rows (id, text) whose five-word similarity is least or more, all pairs compared."""
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for k, (a, one) in enumerate(rows):
        for b, two in rows[:k]:
            if shingle_similarity(one, two) >= least:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(d) for d in root}


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir).persist()
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        seen.append((name, before, docs, ids))
        if name != "best-fit packing":
            assert docs.columns == names
    quality, exact, near, mixed, packed = seen
    assert not any(d % 8 == 0 for d in quality[3] if d < 300)
    assert all(d in quality[3] for d in range(240) if d % 8)
    assert exact[3] == {r["doc_id"] for r in drop_copies(exact[1], "largest").collect()}
    assert near[3] == alike([(r["doc_id"], r["text"]) for r in near[1].collect()])
    assert len(near[3] & {305, 400, 401, 402, 403}) < 5
    assert mixed[3] == near[3] and mixed[2].count() >= len(near[3])
    length = packed[2].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert length.where("n <> end or n > 2048").count() == 0
    assert packed[3] == mixed[3]


def test_stages_on_odd_rows(spark, sf_dir, tmp_path):
    """Nulls in any column, empty, blank and very long texts, repeated rows, ties and extra columns with names used within."""
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "s", "en"]) for _ in range(n))
    same = text(60)
    rows = [(k, text(70), "en", "s", 1) for k in range(40)]
    rows += [(50, None, None, None, None), (51, "", "en", "s", 0), (52, " \n", "en", "s", 2), (None, text(60), "en", "s", 3), (None, None, None, None, None)]
    rows += [(60, same, "en", "s", 1), (60, same, "en", "s", 1), (61, same.upper(), "fr", "t", 1), (62, text(60) + " long" * 60_000, "en", "s", 1), (63, text(60) + " long" * 60_000, "en", "s", 1)]
    names = ("_gone", "gone", "_copies", "_copy", "_mixed", "mixed_id", "mixed_n", "mixed_copy", "node", "fps", "kept", "group", "sequence_id", "offset", "_sha", "tokens", "p")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *(F.lit("x").alias(n) for n in names))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(0, 40, 2)] + [(51, 1, None), (None, 1, 0), (62, None, None), (60, 1, 0), (60, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path)).persist()
        got = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(got) <= want, name
        if name == "exact dedup":
            assert sorted(d for d in got if d in (60, 61)) == [61] and sum(d in (50, 51) for d in got) == 1
        if name != "best-fit packing":
            assert docs.columns == before.columns
        want = set(got)
    assert {0, 1, 39, None} <= want


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
