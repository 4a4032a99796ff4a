"""The corpus pipeline: raw documents to packed training sequences.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheetframe.llm.common import release, saved
from sheetframe.llm.exact_dedup import drop_copies
from sheetframe.llm.mixing import mix_documents
from sheetframe.llm.packing import pack_documents
from sheetframe.llm.quality import keep_good
from sheetframe.llm.queries import LANGUAGE_SHARES, labelled_domains
from sheetframe.llm.simhash import drop_near_duplicates


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling against good labelled rows; what it rejects goes. Nulls, empty and very long texts, ties, repeated
    rows, empty tables and further columns, whatever their names, are as keep_good says; likewise below."""
    return keep_good(docs, _labels(spark, sf_dir))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Content sort; of equal texts the row with the largest doc_id stays, one row only. Edge cases: drop_copies."""
    return drop_copies(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ball hashing proposes, five-word similarity of 0.8 or more links; one document of each component stays. Edge cases:
    drop_near_duplicates."""
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Soft-membership mixing to the target shares of the languages by repeating documents: with rates of 1 or more none is lost.
    Edge cases: mix_documents."""
    return mix_documents(docs, labelled_domains(docs, _labels(spark, sf_dir)), LANGUAGE_SHARES, least=1.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Vector best-fit into sequences of 2048 tokens. Edge cases: pack_documents."""
    return pack_documents(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing", mix), ("best-fit packing", pack)]

#: No stage but the second can be put as SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
            release(before)  # what a stage has read is needed no more; the input isn't ours to delete and stays
    return docs
