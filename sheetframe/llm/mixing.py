"""Mixing sources to target weights by soft membership.

A multinomial classifier over hashed n-grams, counted over all labelled rows, gives each document its posterior over domains.
Document rates r >= least are then fitted by projected least squares, so that the expected tokens of each domain, the sum of
rate x tokens x posterior, meet the targets, with a slight pull to rate 1 that makes the answer unique. At the answer a rate
is max(least, 1 + posterior . y) for one number y per domain, so y is what is sought, by Newton's method on the convex dual: a
round is one pass over a narrow written table that adds up value, domain totals and curvature for a few step lengths at once.
Rates follow from y, so none is ever shuffled or stored.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_arrow, release, saved, text_of
from .ngrams import SIZE, buckets, model_counts

#: Rounds at most; the fit ends when it has converged, mostly in under ten.
ROUNDS = 100
#: Of a domain's target, so much may be missing for the pull's sake, where the domains' tokens allow it.
TOLERANCE = 0.01
#: The pull to rate 1 at most and at least. A domain of a small share of the tokens needs high rates, so a slighter pull.
PULL = 1e-4
LEAST_PULL = 1e-9
STEPS = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 0.001)


def log_likelihoods(counts: np.ndarray) -> np.ndarray:
    """Smoothed log p(bucket | domain), a row per domain."""
    rate = counts.sum(0) + 1.0
    smooth = counts + 50.0 * SIZE / rate.sum() * rate / SIZE
    return np.log(smooth / smooth.sum(1, keepdims=True))


def posteriors(own: np.ndarray, logs: np.ndarray, prior: np.ndarray, evidence: float = 1.0) -> np.ndarray:
    """logs: a row per bucket, a column per domain. evidence: what an n-gram counts, 1 where n-grams are independent."""
    score = prior + evidence * logs[own].sum(0)
    score = np.exp(score - score.max())
    return score / score.sum()


class Fit:
    """The dual: minimise the sum of tokens x psi(1 + p . y) - targets . y + pull x mass x |y|^2 / 2, where psi' is max(least, .)."""

    def __init__(self, size: int, least: float = 0.0):
        self.size, self.least, self.width = size, least, 1 + size + size * size

    def rates(self, posterior: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.maximum(self.least, 1.0 + posterior @ y)

    def sums(self, w: np.ndarray, p: np.ndarray, ys: np.ndarray) -> np.ndarray:
        """For each y of ys: value, domain totals and curvature over the rows, in one line."""
        out = np.zeros((len(ys), self.width))
        for k, y in enumerate(ys):
            s = 1.0 + p @ y
            r = np.maximum(self.least, s)
            free = w * (s > self.least)
            out[k] = np.concatenate([[w @ (r * (s - r / 2))], (w * r) @ p, ((free[:, None] * p).T @ p).ravel()])
        return out


def classify(docs: DataFrame, labelled: DataFrame, domains: list[str], evidence: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tokens (white-space words), p array<double> in the order of domains, for each row of docs. labelled: doc_id,
    domain; labels outside domains count as none; of several for an id the least counts. A domain without labelled rows gets
    what smoothing leaves it."""
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    marks = saved(labelled.where(F.col("domain").isin(domains)).groupBy(labelled["doc_id"].cast("long").alias("marked")).agg(F.min("domain").alias("domain")))
    number = F.coalesce(*(F.when(F.col("domain") == d, k) for k, d in enumerate(domains)))
    joined = own.join(marks, own["doc_id"] == marks["marked"]).select("text", number.alias("class"))
    counts = model_counts(joined, len(domains))[:-1]
    rows = {r["domain"]: r["count"] for r in marks.groupBy("domain").count().collect()}
    release(marks)
    n = np.array([rows.get(d, 0) for d in domains], float)
    prior, logs = np.log((n + 1) / (n.sum() + len(n))), np.ascontiguousarray(log_likelihoods(counts).T)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        p = [posteriors(buckets(t), logs, prior, evidence) for t in texts]
        tokens = [len(t.encode("utf-8", "surrogatepass").split()) for t in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(p, pa.list_(pa.float64()))], names=["doc_id", "tokens", "p"])

    return map_arrow(own, scan, "doc_id long, tokens long, p array<double>")


def fit_rates(members: DataFrame, targets: np.ndarray, rounds: int = ROUNDS, least: float = 0.0, seed: int = 29) -> DataFrame:
    """members (doc_id, tokens, p; a written table) with rate double and copies long: the rate rounded down or up by a hash
    of the id, so that copies are the rate on average. targets: tokens for each domain."""
    size = len(targets)
    fit = Fit(size, least)

    def summed(ys: np.ndarray) -> np.ndarray:
        def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(ys), fit.width))
            for batch in batches:
                total += fit.sums(batch.column(0).to_numpy().astype(float), batch.column(1).flatten().to_numpy().reshape(-1, size), ys)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "x"])

        out = np.zeros(len(ys) * fit.width)
        for r in members.select("tokens", "p").mapInArrow(scan, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
            out[r["at"]] = r["x"]
        return out.reshape(len(ys), fit.width)

    y = np.zeros(size)
    now = summed(y[None, :])[0]
    # Rates of 1 tell how many tokens each domain has; where least is more, the totals are least times that.
    own = now[1 : size + 1] / max(1.0, least)
    mass = float(own.sum())
    if mass:
        wanted = (targets > 0) & (own > 0)
        pull = mass * max(LEAST_PULL, min(PULL, TOLERANCE / 2 * float((own[wanted] / mass).min(initial=1.0))))
        close = 1e-5 * np.maximum(targets, mass * 1e-3)
        slope_of = lambda sums, y: sums[1 : size + 1] - targets + pull * y
        value_of = lambda sums, y: sums[0] - targets @ y + pull * (y @ y) / 2
        for _ in range(rounds):
            slope = slope_of(now, y)
            if (np.abs(slope) <= close).all():
                break
            step = np.linalg.solve(now[size + 1 :].reshape(size, size) + pull * np.eye(size), -slope)
            ys = y + np.array(STEPS)[:, None] * step
            tried = summed(ys)
            values = [value_of(t, v) for t, v in zip(tried, ys, strict=True)]
            best = int(np.argmin(values))
            if (np.abs(slope_of(tried[0], ys[0])) <= close).all():
                best = 0
            elif values[best] >= value_of(now, y):
                break  # as near as doubles come
            y, now = ys[best], tried[best]
        else:
            if (np.abs(slope_of(now, y)) > close).any():
                warnings.warn(f"the mixing rates haven't converged in {rounds} rounds", stacklevel=2)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = batch.column(2).flatten().to_numpy().reshape(-1, size)
        rate = fit.rates(p, y)
        u = np.array([xxhash.xxh64_intdigest(str(d), seed) / 2.0**64 for d in batch.column(0).to_pylist()])
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rate), pa.array(np.floor(rate + u).astype(np.int64))], names=["doc_id", "tokens", "p", "rate", "copies"])

    return map_arrow(members.select("doc_id", "tokens", "p"), scan, "doc_id long, tokens long, p array<double>, rate double, copies long")


def soft_mix(docs: DataFrame, labelled: DataFrame, shares: dict[str, float], total: float | None = None, least: float = 0.0, rounds: int = ROUNDS, evidence: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, tokens, domain (the likeliest; of equals the first named), p (posteriors in the order
    of shares), rate, copies. shares are the target weights of the domains; total is how many tokens the mixture has: by
    default, the least under which no domain with a share above 0 must be thinned when least is 1, else as many as docs has.
    Null and empty texts have no tokens and keep rate 1 or nearly so; a null id is a row like any other. Repeated rows are
    rated alike, but for the rounding of copies, which goes by id. An empty table gives an empty result; columns of docs other
    than id and text aren't read. Targets that rates of least or more can reach are met within TOLERANCE,
    unless a domain has less than 2 x LEAST_PULL / TOLERANCE of all tokens; of others the nearest in least squares."""
    domains = list(shares)
    weight = np.array([shares[d] for d in domains], float)
    weight = weight / weight.sum()
    members = saved(classify(docs, labelled, domains, evidence, id_col, text_col))
    masses = members.select(*(F.coalesce(F.sum(F.col("tokens") * F.col("p")[k]), F.lit(0.0)).alias(str(k)) for k in range(len(domains)))).first()
    mass = np.array([masses[str(k)] for k in range(len(domains))])
    if total is None:
        wanted = weight > 0
        total = float((mass[wanted] / weight[wanted]).max()) if least >= 1 else float(mass.sum())
    rated = fit_rates(members, weight * total, rounds, least)
    top = F.element_at(F.array(*(F.lit(d) for d in domains)), F.array_position(F.col("p"), F.array_max("p")).cast("int"))
    return rated.select("doc_id", "tokens", top.alias("domain"), "p", "rate", "copies")


def mix_documents(docs: DataFrame, labelled: DataFrame, shares: dict[str, float], total: float | None = None, least: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each row as many times as soft_mix gives it copies, columns as they are, whatever their names. Rows that share
    an id, null among them, all come as often as the most frequent of them; the rest is as in soft_mix."""
    found = soft_mix(docs, labelled, shares, total, least, id_col=id_col, text_col=text_col)
    of, n, each = (fresh(name, docs) for name in ("mixed_id", "mixed_n", "mixed_copy"))
    times = saved(found.groupBy(F.col("doc_id").alias(of)).agg(F.max("copies").alias(n)).where(F.col(n) != 1))
    joined = docs.join(times, docs[id_col].cast("long").eqNullSafe(times[of]), "left")
    copies = F.coalesce(times[n], F.lit(1))
    times_over = F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<bigint>")))
    return joined.select(*(docs[f"`{c}`"] for c in docs.columns), times_over.alias(each)).drop(each)
