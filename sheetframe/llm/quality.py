"""Quality classifier by importance resampling.

Two generative models over hashed n-grams are counted: one of the target text (rows labelled good), one of all raw text. The
weight of a document is the ratio of its likelihoods under the two, the product over its n-grams; log weights are sums.
Documents are sampled without replacement in proportion to their weights by Gumbel top-k: the k largest of log weight + Gumbel
noise stay. The noise is a hash of the id, so a rerun after a lost executor draws the same. k is given, or is the number of
documents on the good side of the weight that best parts good from bad labelled rows, fitted on at most LABELLED_SAMPLE.

A toxic text may be ordinary but for a few words, which drown in the sum. So a second pair of models counts in how many target
and toxic rows each word occurs; a text scores by the TOXIC_WORDS words that speak most for toxic, and one on the toxic side of
the score that best parts toxic from target rows has that part of its log ratio put below the cut. The k-th key is found
exactly by radix selection: a few counts by 16 bits each; nothing is sorted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, release, saved, text_of, without
from .ngrams import SIZE, WORDS, buckets_of, model_counts, presence_counts, word_hashes, words_in

#: Labelled rows at most that the cut is fitted on, those with the least hash of id and scores.
LABELLED_SAMPLE = 50_000
#: Prior observations of a bucket, at the raw text's rate.
PRIOR = 10.0
#: Log weights count this many times against the noise; 1 samples in proportion to the weights.
SHARPNESS = 1.0
#: So many words, those that speak most for toxic, make a text's score; prior observations of a word in either class.
TOXIC_WORDS = 3
TOXIC_PRIOR = 2.0


def log_ratios(target: np.ndarray, raw: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw), shrunk to 0 where a bucket has been seen little."""
    if not target.sum() or not raw.sum():
        return np.zeros(SIZE)
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + prior) / (expected + prior))


def gumbel(doc_id: int | None, seed: int) -> float:
    u = (xxhash.xxh64_intdigest(str(doc_id), seed) + 0.5) / 2.0**64
    return float(-np.log(-np.log(u)))


def toxic_ratios(counts: np.ndarray, prior: float = TOXIC_PRIOR) -> np.ndarray:
    """counts: presence_counts of target and toxic rows. log p(word | target) - log p(word | toxic), shrunk to 0 where the
    word has been seen little; all 0 without rows of either."""
    (good, n_good), (toxic, n_toxic) = ((c[:-1], c[-1]) for c in counts)
    if not n_good or not n_toxic:
        return np.zeros(WORDS)
    return np.log((good * (n_toxic / n_good) + prior) / (toxic + prior))


def cleanness(words: np.ndarray, ratios: np.ndarray) -> float:
    """The sum of the TOXIC_WORDS least ratios: the log ratio of target to toxic of those words."""
    found = ratios[words]
    if len(found) > TOXIC_WORDS:
        found = np.partition(found, TOXIC_WORDS)[:TOXIC_WORDS]
    return float(found.sum())


def weights(docs: DataFrame, ratios: np.ndarray, toxic: np.ndarray) -> DataFrame:
    """doc_id, text to doc_id, ratio (the sum of ratios, 0 if there is no n-gram), clean (the cleanness)."""
    ratios, toxic = ratios.astype(np.float64), toxic.astype(np.float32)
    any_toxic = bool(toxic.any())

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums, clean = [], []
        for text in batch.column(1).to_pylist():
            hashes = word_hashes(text)
            sums.append(float(ratios[buckets_of(hashes)].sum()))
            clean.append(cleanness(words_in(hashes), toxic) if any_toxic else 0.0)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.float64()), pa.array(clean, pa.float64())], names=["doc_id", "ratio", "clean"])

    return map_arrow(docs.select("doc_id", "text"), scan, "doc_id long, ratio double, clean double")


def ranked(scored: DataFrame, cut: float, clean_cut: float, sharpness: float = SHARPNESS, seed: int = 17) -> DataFrame:
    """doc_id, log_weight, rank_key: a long that orders as sharpness x log_weight + noise. The log weight is the ratio; of a
    text whose cleanness is under clean_cut, the ratio or the cut if that is less, less what is missing to clean_cut."""

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        ratio, clean = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        weight = np.where(clean < clean_cut, np.minimum(ratio, cut) - (clean_cut - clean), ratio) if np.isfinite(clean_cut) else ratio
        noise = np.array([gumbel(d, seed) for d in batch.column(0).to_pylist()])
        keys = (sharpness * weight + noise).view(np.int64)
        ordered = np.where(keys < 0, keys ^ np.int64(0x7FFFFFFFFFFFFFFF), keys)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight, pa.float64()), pa.array(ordered)], names=["doc_id", "log_weight", "rank_key"])

    return map_arrow(scored, scan, "doc_id long, log_weight double, rank_key long")


def kth_largest(rows: DataFrame, column: str, k: int) -> tuple[int, int]:
    """The k-th largest (from 1) value of a long column without nulls, and how many rows are larger. Four counts by 16 bits."""
    prefix, above = 0, 0
    value = F.col(column).bitwiseXOR(F.lit(-(2**63)))  # orders as unsigned
    for step in range(4):
        shift = 48 - 16 * step
        own = rows if not step else rows.where(F.shiftrightunsigned(value, shift + 16) == prefix)
        digit = F.shiftrightunsigned(value, shift).bitwiseAND(F.lit(0xFFFF).cast("long")).alias("digit")
        counts = {r["digit"]: r["n"] for r in own.groupBy(digit).agg(F.count("*").alias("n")).collect()}
        for d in sorted(counts, reverse=True):
            if above + counts[d] >= k:
                prefix = prefix << 16 | d
                break
            above += counts[d]
    return (prefix ^ 2**63) - (2**64 if prefix ^ 2**63 >= 2**63 else 0), above


def labelled_sample(rows: DataFrame, most: int = LABELLED_SAMPLE) -> pd.DataFrame:
    """ratio, clean, quality, toxic of the `most` rows with the least hash of id and scores, or of all rows if they are fewer.
    Rows of one hash are alike, so that it doesn't matter which of them are taken. The hash up to which rows are taken is
    found by counts; no more than the sample itself reaches the driver, and nothing is sorted."""
    kept = saved(rows.select("ratio", "clean", "quality", "toxic", F.bitwise_not(F.xxhash64("doc_id", "ratio", "clean")).alias("rank")))
    taken = kept
    if kept.count() > most:
        value, above = kth_largest(kept, "rank", most)
        taken = kept.where(F.col("rank") > value).union(kept.where(F.col("rank") == value).limit(most - above))
    out = taken.select("ratio", "clean", "quality", "toxic").toPandas()
    release(kept)
    return out


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The weight between good and bad with the least sum of the two error rates; of the widest gap with that sum, its middle.
    With none of either, minus infinity: nothing is rejected."""
    if not len(good) or not len(bad):
        return float("-inf")
    values = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
    error = np.searchsorted(np.sort(good), cuts) / len(good) + 1 - np.searchsorted(np.sort(bad), cuts) / len(bad)
    least = np.flatnonzero(error <= error.min() + 1e-12)
    width = [values[i] - values[i - 1] if 0 < i < len(values) else 0.0 for i in least]
    return float(cuts[least[int(np.argmax(width))]])


def importance_resample(docs: DataFrame, labels: DataFrame, k: int | None = None, sharpness: float = SHARPNESS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, log_weight, kept. labels has doc_id, quality (1 good, 0 bad), toxic; good rows with
    toxic 0 or null are the target. Of equal keys the larger id stays first; rows that share id and key share their fate, null
    ids lose ties. A null text is empty, and an empty text has weight 0. Toxic rows (toxic 1, whatever the quality) count as
    rejected: see ranked. Without good rows all weights are 0; then, or without bad and toxic rows and without k, everything
    stays."""
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    marks = labels.groupBy(labels["doc_id"].cast("long").alias("marked")).agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    slim = saved(marks)
    joined = own.join(slim, own["doc_id"] == slim["marked"], "left")
    counts = model_counts(joined.select("text", F.when(good, 0).alias("class")), 1)
    either = F.when(F.col("toxic") == 1, 1).when(good, 0)
    seen = presence_counts(own.join(slim, own["doc_id"] == slim["marked"]).select("text", either.alias("class")).where("class is not null"), 2)
    found = saved(weights(own, log_ratios(counts[0], counts[1]), toxic_ratios(seen)))
    fit = labelled_sample(found.join(slim.where("quality in (0, 1) or toxic = 1"), found["doc_id"] == slim["marked"]))
    is_good, is_toxic = (fit["quality"] == 1) & (fit["toxic"] == 0), fit["toxic"] == 1
    cut = best_cut(fit["ratio"][is_good].to_numpy(), fit["ratio"][fit["quality"] == 0].to_numpy())
    clean_cut = best_cut(fit["clean"][is_good].to_numpy(), fit["clean"][is_toxic].to_numpy())
    roof = cut if np.isfinite(cut) else float(found.agg(F.coalesce(F.min("ratio"), F.lit(0.0))).first()[0])
    scored = saved(ranked(found, roof, clean_cut, sharpness, seed))
    n = scored.count()
    if k is None:
        k = scored.where(F.col("log_weight") >= roof).count() if np.isfinite(cut) or np.isfinite(clean_cut) else n
    release(slim, found)
    if k >= n or k <= 0:
        return scored.select("doc_id", "log_weight", F.lit(k > 0).alias("kept"))
    value, above = kth_largest(scored, "rank_key", k)
    tied = scored.where(F.col("rank_key") == value).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"))
    last = kth_largest(tied, "id", k - above)[0]
    stays = (F.col("rank_key") > value) | ((F.col("rank_key") == value) & (F.coalesce("doc_id", F.lit(-(2**63))) >= last))
    return scored.select("doc_id", "log_weight", stays.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that importance_resample rejects, columns as they are, whatever their names. Nulls, empty and
    repeated rows, ties and an empty table are as there; rows that share an id go only if all of them are rejected."""
    judged = importance_resample(docs, labels, k, id_col=id_col, text_col=text_col)
    return without(docs, id_col, saved(judged.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id")))
