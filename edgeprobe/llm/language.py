"""Language identification with a string kernel, Nystroem landmarks and kernel ridge regression.

Two texts' kernel is the number of character n-grams (of 1 to 3) that both have, over the geometric mean of
the numbers that each has.  Landmarks and further training texts are a bounded sample of
``LANDMARKS`` and ``TRAINING`` texts of each language.  One-versus-rest ridge regression in the landmarks'
feature space gives weights for the landmarks; a batch of texts is scored by the product of its presence
matrix with (landmark presence x weights), which is the product with all landmarks in another order.

Cases: null texts and texts without a letter are ``und`` with score 0, and so is every text if nothing can be
learnt; ties go to the language that sorts first; very long texts are read whole; repeated rows get equal
results, and an id that comes with several texts is learnt from by the one that sorts first; ids may be numbers or
text; an empty table gives an empty result.  Other columns are not read and don't come back, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_bucket, discard, few_at_a_time, small_batches, written
from .ngrams import SPACE_BITS, Distinct, grams, normal, sample_each

SIZES = range(1, 4)
#: Bounds of the sample, in texts of each language.
LANDMARKS, TRAINING = 48, 600
RIDGE = 1e-3
UNKNOWN = "und"
_distinct: list[Distinct] = []


def presence(text: str) -> np.ndarray:
    """The distinct n-grams of a text, as buckets."""
    if not _distinct:
        _distinct.append(Distinct())
    return _distinct[0](grams(normal(text), SIZES))


def _presences(batches):
    for b in batches:
        found = [np.sort(presence(t)).astype(np.int32) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], names=["lang", "grams"])


def _kernel_rows(sent):
    def run(batches):
        table, sizes = sent.value
        dense = _dense(table)
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                x = presence(t)
                rows.append(_times(dense, x) / np.sqrt(max(len(x), 1) * sizes))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["lang", "row"])

    return run


def _dense(table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For a table (buckets, rows): the row of each bucket (0: none) and the rows after a row of zeros."""
    buckets, rows = table
    at = np.zeros(2**SPACE_BITS, np.int32)
    at[buckets] = np.arange(1, len(buckets) + 1)
    return at, np.vstack([np.zeros((1, rows.shape[1])), rows])


def _times(dense: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    at, rows = dense
    return rows[at[x]].sum(axis=0, dtype=np.float64)


def fit(docs: DataFrame, landmarks: int = LANDMARKS, training: int = TRAINING, ridge: float = RIDGE):
    """(languages, buckets, weights of each bucket and language, bias), or None.  ``docs``: doc_id, text, lang."""
    spark = docs.sparkSession
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = sample_each(usable.where(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang"), "lang", landmarks + training)
    picked = {r["doc_id"]: r["lang"] for r in ids.collect()}
    if not picked:
        return None
    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = F.broadcast(spark.createDataFrame([(i,) for i in picked if i is not None], f"doc_id {kind}"))
    texts = usable.join(chosen, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r")).select("doc_id", "r.*")
    texts = written(texts, "landmarks", paths := [])  # a few hundred of each language, read three times
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id"))
    of_marks = texts.withColumn("k", order).where(F.col("k") <= landmarks).select("lang", "text").mapInArrow(_presences, "lang string, grams array<int>").collect()
    found = sorted(((r["lang"], np.array(r["grams"], np.int64)) for r in of_marks), key=lambda x: (x[0], x[1].tobytes()))
    buckets = np.unique(np.concatenate([g for _, g in found]))
    incidence = np.zeros((len(buckets), len(found)), np.float32)
    for j, (_, g) in enumerate(found):
        incidence[np.searchsorted(buckets, g), j] = 1.0
    sizes = np.array([max(len(g), 1) for _, g in found], np.float64)
    inner = (incidence.T @ incidence).astype(np.float64) / np.sqrt(np.outer(sizes, sizes))
    sent = spark.sparkContext.broadcast(((buckets, incidence), sizes))
    rows = texts.select("lang", "text").mapInArrow(_kernel_rows(sent), "lang string, row array<double>").collect()
    discard(spark, paths)
    rows.sort(key=lambda r: (r["lang"], r["row"]))
    languages = sorted({r["lang"] for r in rows})
    k = np.array([r["row"] for r in rows])
    y = np.where(np.array([r["lang"] for r in rows])[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    weight = 1.0 / np.array([(y[:, c] > 0).sum() for c in range(len(languages))])
    per_row = np.sqrt(weight[y.argmax(axis=1)])[:, None]
    # Nystroem: features K(x, landmarks) @ inner ** -1/2.
    values, vectors = np.linalg.eigh(inner)
    root = vectors / np.sqrt(np.maximum(values, 1e-6 * values.max())) @ vectors.T
    phi = np.hstack([k @ root, np.ones((len(k), 1))]) * per_row
    keep = ridge * np.eye(phi.shape[1])
    keep[-1, -1] = 1e-9
    beta = np.linalg.solve(phi.T @ phi + keep, phi.T @ (y * per_row))
    alpha = root @ beta[:-1] / np.sqrt(sizes)[:, None]
    return languages, buckets, incidence @ alpha, beta[-1]


def _predict(sent):
    def run(batches):
        model = sent.value
        if model is not None:
            languages, buckets, weights, bias = model
            dense = _dense((buckets, weights))
        for b in few_at_a_time(batches, 2):
            said, score = [], []
            for t in b.column(2).to_pylist():
                if model is None or t is None or not any(map(str.isalpha, t)):
                    said.append(UNKNOWN)
                    score.append(0.0)
                    continue
                x = presence(t)
                f = _times(dense, x) / np.sqrt(len(x)) + bias
                best = int(f.argmax())
                said.append(languages[best])
                score.append(float(np.clip((f[best] + 1) / 2, 0, 1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row for each document: id, held_out, lang_pred, score.  Learns where crc32(id as text) mod 4 is not 2."""
    spark = small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_column).alias("doc_id"), (crc_bucket(id_column, 4) == 2).alias("held_out"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sent = spark.sparkContext.broadcast(fit(plain.where("not held_out").select("doc_id", "text", "lang")))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.select("doc_id", "held_out", "text").mapInArrow(_predict(sent), f"doc_id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("doc_id", id_column)
