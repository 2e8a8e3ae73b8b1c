"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

The n-grams of 3 to 6 characters present in a text are features.  Over a sample of at most
``SAMPLE`` labelled texts of each class, the log-ratio r of each feature's smoothed frequencies in
toxic and other texts is found; presence is scaled by r, and logistic regression with an L2 penalty is fitted
over every n-gram that ``LEAST_TEXTS`` texts of the sample have.  The intercept is then moved from the
sample's share of toxic texts to the labels' share.

Cases: null and empty texts have no feature and get the intercept's score; rows with a null label aren't
learnt from; without a label of either class the score is the share of toxic labels, or 0; a score of exactly one half
is predicted 1; very long texts are read whole, in memory that grows with them; repeated rows get equal results, and
an id with several labels counts as toxic if any is 1; ids may be numbers or text; an empty table gives an empty result.
Other columns of documents and labels are not read and don't come back, whatever their names.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, discard, few_at_a_time, small_batches, text_of, written
from .ngrams import SPACE_BITS, Distinct, grams, normal, sample_each

SIZES = range(3, 7)
#: Bound of the sample, in labelled texts of each class.
SAMPLE = 2000
LEAST_TEXTS = 4
#: Features of texts that are looked at together while fitting.
BLOCK = 2_000_000
PENALTY = 1.0
_distinct: list[Distinct] = []


def presence(text: str) -> np.ndarray:
    if not _distinct:
        _distinct.append(Distinct())
    return _distinct[0](grams(normal(text), SIZES))


def _class_counts(batches):
    """How many texts of each class have each n-gram: one compressed row for each partition."""
    space = 2**SPACE_BITS
    counts = np.zeros((2, space), np.int32)
    for b in few_at_a_time(batches, 1):
        for label, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            counts[label, presence(t)] += 1
    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names=["counts"])


def _chosen(sent):
    def run(batches):
        at = _table(sent.value)
        for b in few_at_a_time(batches, 1):
            rows = []
            for t in b.column(1).to_pylist():
                k = at[presence(t)]
                rows.append(np.unique(k[k >= 0]).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["label", "features"])

    return run


def _table(buckets: np.ndarray) -> np.ndarray:
    at = np.full(2**SPACE_BITS, -1, np.int32)
    at[buckets] = np.arange(len(buckets))
    return at


def _logistic(index: np.ndarray, size: np.ndarray, y: np.ndarray, scale: np.ndarray, penalty: float, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights of the scaled features and intercept, by L-BFGS with the last ten steps, until the gradient is small.

    ``index``: the features of all texts, one text after the other; ``size``: how many each has.
    """
    full = np.flatnonzero(size)  # the texts with features
    start = np.concatenate(([0], np.cumsum(size[full])))
    cuts = np.unique(np.searchsorted(start, np.arange(0, start[-1] + BLOCK, BLOCK)).clip(0, len(full)))
    d = len(scale)

    def times(v):
        out = np.zeros(len(size))
        for lo, hi in itertools.pairwise(cuts):
            out[full[lo:hi]] = np.add.reduceat(v[index[start[lo] : start[hi]]], start[lo:hi] - start[lo])
        return out

    def back(g):
        out = np.zeros(d)
        for lo, hi in itertools.pairwise(cuts):
            out += np.bincount(index[start[lo] : start[hi]], weights=np.repeat(g[full[lo:hi]], size[full[lo:hi]]), minlength=d)
        return out

    def loss(w):
        z = times(scale * w[:-1]) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        value = float(np.sum(np.logaddexp(0, z) - y * z)) + penalty / 2 * float(w[:-1] @ w[:-1])
        return value, np.append(scale * back(p - y) + penalty * w[:-1], (p - y).sum())

    w = np.zeros(d + 1)
    value, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(g).max() < 1e-3:
            break
        step, alphas = -g, []
        for s, q in reversed(past):
            alphas.append((s @ step) / (s @ q))
            step = step - alphas[-1] * q
        step = step * (past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1])) if past else step / max(1.0, float(np.linalg.norm(g)))
        for (s, q), alpha in zip(past, reversed(alphas), strict=True):
            step = step + (alpha - (q @ step) / (s @ q)) * s
        slope, t = float(g @ step), 1.0
        for _ in range(30):
            new_value, new_g = loss(w + t * step)
            if new_value <= value + 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        s, q = t * step, new_g - g
        if s @ q > 1e-12:
            past = [*past[-9:], (s, q)]
        w, value, g = w + s, new_value, new_g
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = PENALTY):
    """(buckets, weights, intercept).  ``docs``: doc_id, text; ``labels``: doc_id, toxic; both of training rows."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    nothing = np.empty(0, np.int64), np.empty(0)
    if len(totals) < 2:
        return *nothing, 40.0 if share == 1 else -40.0
    picked = sample_each(known, "label", sample).collect()
    chosen = F.broadcast(spark.createDataFrame([(r["doc_id"], r["label"]) for r in picked], "chosen string, label int"))
    texts = docs.join(chosen, docs["doc_id"].cast("string") == F.col("chosen")).select("label", text_of(docs).alias("text"))
    texts = written(texts, "labelled", paths := []).coalesce(16)  # a bounded sample, read twice
    counts = np.zeros((2, 2**SPACE_BITS), np.int64)
    for r in texts.mapInArrow(_class_counts, "counts binary").toLocalIterator():
        counts += np.frombuffer(zlib.decompress(r["counts"]), np.int32).reshape(2, -1)
    p, q = counts[1] + 1.0, counts[0] + 1.0
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    present = counts.sum(axis=0)
    buckets = np.flatnonzero((present >= LEAST_TEXTS) & (ratio != 0))
    if not len(buckets):
        discard(spark, paths)
        return *nothing, float(np.log(share / (1 - share)))
    found = texts.mapInArrow(_chosen(spark.sparkContext.broadcast(buckets)), "label int, features binary").toLocalIterator()
    rows = sorted((r["label"], bytes(r["features"])) for r in found)
    discard(spark, paths)
    y, size = np.array([label for label, _ in rows], np.float64), np.array([len(x) // 4 for _, x in rows])
    index = np.frombuffer(b"".join(x for _, x in rows), "<i4")
    del rows  # the features are held once, 4 bytes each
    scale = ratio[buckets]
    w, b = _logistic(index, size, y, scale, penalty)
    seen = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    return buckets, w * scale, float(b + np.log(share / (1 - share)) - np.log(seen / (1 - seen)))


def _predict(sent):
    def run(batches):
        buckets, weights, intercept = sent.value
        of_bucket = np.zeros(2**SPACE_BITS)
        of_bucket[buckets] = weights
        for b in few_at_a_time(batches, 2):
            score = []
            for t in b.column(2).to_pylist():
                score.append(1 / (1 + np.exp(-np.clip(of_bucket[presence(t)].sum() + intercept, -40.0, 40.0))))
            score = np.array(score, np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row for each document: id, held_out, score, predicted.  Learns where crc32(id as text) mod 5 is not 0."""
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_column).alias("doc_id"), (crc_bucket(id_column, 5) == 0).alias("held_out"), text_of(docs).alias("text"))
    train = labels.select(F.col(id_column).alias("doc_id"), "toxic").where(crc_bucket("doc_id", 5) != 0)
    sent = docs.sparkSession.sparkContext.broadcast(fit(plain.where("not held_out").select("doc_id", "text"), train))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(_predict(sent), f"doc_id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("doc_id", id_column)
