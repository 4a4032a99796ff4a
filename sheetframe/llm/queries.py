"""The queries opN_<name>: each operator with production parameters over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from .exact_dedup import content_sort
from .mixing import soft_mix
from .packing import pack_documents
from .passages import remove_repeats
from .pii import find_pii
from .quality import importance_resample
from .simhash import near_duplicates
from .topk import top_inner_products
from .urls import judge_urls
from .warc import round_trip

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Target shares of the mixture's tokens: languages of good rows, then what is wanted little or not at all.
SHARES = {"en": 0.52, "fr": 0.16, "de": 0.16, "es": 0.14, "junk": 0.02, "toxic": 0.0}

#: The same for documents that the quality stage has kept: languages only.
LANGUAGE_SHARES = {"en": 0.58, "fr": 0.16, "de": 0.16, "es": 0.10}


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, domain of labelled rows: toxic, else junk, else the language."""
    marks = labels.select(F.col("doc_id").alias("marked"), "quality", "toxic")
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, F.col("lang"))
    return docs.select("doc_id", "lang").join(marks, F.col("doc_id") == F.col("marked")).select("doc_id", domain.alias("domain")).where("domain is not null")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: doc_id, log_weight, kept. Nulls, empty and very long texts, ties, repeated rows, empty tables and
    further columns are as importance_resample says."""
    return importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: counts, digest and spans. Nulls, empty and very long texts, repeated rows, empty tables and further
    columns are as find_pii says; ties between kinds go in the order of KINDS."""
    return find_pii(_table(spark, sf_dir, "documents"))


def op3_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: the group of its text; the largest doc_id stays. Edge cases are as content_sort says."""
    return content_sort(_table(spark, sf_dir, "documents"), keep="largest")


def op4_soft_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: its posteriors over the domains, rate and copies. Edge cases are as soft_mix says; a language
    outside SHARES is no domain."""
    docs = _table(spark, sf_dir, "documents")
    return soft_mix(docs, labelled_domains(docs, _table(spark, sf_dir, "labels")), SHARES)


def op5_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece: its place in a sequence of at most 2048 tokens. Edge cases are as pack_documents says."""
    return pack_documents(_table(spark, sf_dir, "documents"))


def op6_ball_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: fingerprint and component_id. Edge cases are as near_duplicates says."""
    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_host_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of pages: host, path, rule, verdict and the words scored. Edge cases are as judge_urls says."""
    return judge_urls(_table(spark, sf_dir, "pages"))


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of pages: its record as read back. Edge cases are as round_trip says."""
    return round_trip(_table(spark, sf_dir, "pages")).drop("url")


def op9_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: words, words removed and the digest of the rest. Edge cases are as remove_repeats says."""
    return remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)


def op10_branch_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query its five best. Edge cases are as whole_vectors and search say."""
    return top_inner_products(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_importance_resampling": op1_importance_resampling,
    "op2_pii_anchors": op2_pii_anchors,
    "op3_content_sort": op3_content_sort,
    "op4_soft_membership": op4_soft_membership,
    "op5_vector_best_fit": op5_vector_best_fit,
    "op6_ball_hashing": op6_ball_hashing,
    "op7_host_words": op7_host_words,
    "op8_warc_round_trip": op8_warc_round_trip,
    "op9_phrase_automata": op9_phrase_automata,
    "op10_branch_and_bound": op10_branch_and_bound,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op3_content_sort": f"""
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, norm, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size
              FROM (SELECT doc_id, {_LOWER} AS norm FROM documents) WINDOW w AS (PARTITION BY norm))""",
    "op8_warc_round_trip": """
        SELECT page_id, octet_length(encode(html)) AS payload_bytes, digest AS payload_digest,
               CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to
        FROM (SELECT *, octet_length(encode(html)) >= 100 AND page_id <> first_id AS again
              FROM (SELECT page_id, html, sha256(html) AS digest, min(page_id) OVER (PARTITION BY sha256(html)) AS first_id
                    FROM (SELECT page_id, coalesce(html, '') AS html FROM pages)))""",
    "op10_branch_and_bound": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score,
                   row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id) AS rank
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 5""",
    "op9_phrase_automata": r"""
        WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
             win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM t WHERE len(w) >= 20)),
             late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
             gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM late),
             words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM t),
             kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS k, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)""",
}
