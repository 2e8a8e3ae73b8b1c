"""Hashed character n-grams and bounded samples, for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: N-grams fall into 2**SPACE_BITS buckets.
SPACE_BITS = 20
_GOLD = 0x9E3779B97F4A7C15
_M = np.uint64(_GOLD)
_SHIFT = np.uint64(64 - SPACE_BITS)


def normal(text: str) -> str:
    """Lower case, white space as single spaces, one before and after."""
    return f" {' '.join(text.lower().split())} "


def grams(text: str, sizes: range) -> list[np.ndarray]:
    """The bucket of every n-gram of a normalised text, an array for each size (from ``sizes``, rising by one)."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    out, h = [], None
    for n in range(1, sizes.stop):
        if n > len(c):
            break
        h = c if h is None else h[:-1] * _M + c[n - 1 :]
        if n in sizes:
            x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n * _GOLD % 2**64)
            out.append(((x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)) >> _SHIFT)
    return [x.astype(np.int64) for x in out]


class Distinct:
    """Distinct buckets in linear time, with one array over all buckets."""

    def __init__(self):
        self.last = np.empty(2**SPACE_BITS, np.int64)

    def __call__(self, found: list[np.ndarray]) -> np.ndarray:
        if not found:
            return np.empty(0, np.int64)
        x = np.concatenate(found)
        at = np.arange(len(x))
        self.last[x] = at
        return x[self.last[x] == at]


def sample_each(rows: DataFrame, kind: str, most: int, id_column: str = "doc_id") -> DataFrame:
    """At most ``most`` rows of each value of ``kind``: those whose ids have the smallest hashes.

    Every row takes part.  A first threshold from the exact counts leaves a few times ``most`` rows of each value, so
    that ranking them is small work however large or uneven the classes are.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(kind).count().collect()}
    if not counts:
        return rows.limit(0)
    order = F.xxhash64(F.col(id_column).cast("string"), F.lit(7))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (3 * most + 100) / n))])
    few = rows.withColumn("_order", order).where((F.col("_order") / F.lit(2.0**64) + 0.5) <= share[F.col(kind)])
    rank = F.row_number().over(Window.partitionBy(kind).orderBy("_order", id_column))
    return few.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_order", "_rank")
