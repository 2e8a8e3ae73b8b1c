"""Near duplicates by MinHash signatures in an inverted index of their coordinates.

A document's signature has ``COORDINATES`` numbers, each the smallest hash of its word shingles under a function of its own, so two documents
agree in a coordinate with the probability of their Jaccard similarity.  Documents are posted under (coordinate, value) pairs.

*Match threshold.*  A pair is a candidate when at least ``MATCHES`` coordinates collide.  A pair that just links (85 hundredths) has fewer with a
probability of 8 in a billion.  Pairs that are just below the similarity collide about as often, so a candidate's parity sketch has to be near enough as well (it is that of
any linked pair, without exception), and what is left is confirmed on whole shingle sets.

*Prefix.*  Each document's pairs are put into one global order, those of common shingles last and the most frequent of all at the very end.  Two documents with
``MATCHES`` collisions have at least 1 + ``SPARE`` of them among the first COORDINATES - MATCHES + 1 + ``SPARE`` pairs of each, so only these are
posted.

*Skip merging.*  Since a linked pair meets in 1 + ``SPARE`` lists, a document may skip any ``SPARE`` of its lists.  Members of a list hang on one of them, the
collisions of these pairs are counted on whole signatures, and what is confirmed forms components.  A document skips lists with several components, the longest
first; only those that have more of these than they can spare are merged member by member with what they don't skip.  The lists, their
dealing in bounded buckets, hot groups, verification and components are those of :mod:`jaccard`, whose parity blocks this method replaces.

Cases: as in :mod:`jaccard`.  Sets of fewer shingles than coordinates repeat their shingles in the signature, which leaves the probabilities as they are.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .hashing import GOLD, M, mix

COORDINATES, MATCHES, SPARE = 64, 36, 19
#: Hundredths of the union that the intersection of linked sets has at least.
SHARE = 85
#: Shingles whose hashes under all functions are held at once.
_AT_ONCE = 4096

_PAIRS = COORDINATES // 2
_ODD = (mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * M) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (mix(np.arange(1001, COORDINATES + 1001, dtype=np.uint64) * M) >> np.uint64(32)).astype(np.uint32)


def signature(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest hash of a set's shingles in each coordinate, and which shingle has it."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    best = which = None
    for at in range(0, max(len(x), 1), _AT_ONCE):
        h = _ODD[:, None] * x[at : at + _AT_ONCE] + _ADD[:, None]
        place = h.argmin(axis=1)
        low = h[np.arange(COORDINATES), place]
        if best is None:
            best, which = low, place
        else:
            less = low < best
            best, which = np.where(less, low, best), np.where(less, place + at, which)
    return best, which


def mark(s: np.ndarray) -> np.ndarray:
    """The signature, two coordinates in a number (zeros for an empty set), and the parity sketch."""
    low = signature(s)[0].view("<i8") if len(s) else np.zeros(_PAIRS, np.int64)
    return np.concatenate([low, jaccard.sketch(s)])


def posted(s: np.ndarray, common: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int]:
    """The keys of the lists that a set is posted in, and how many of them it can skip.

    ``common`` is sorted, ``rank`` has the places of its shingles by falling frequency.
    """
    if not len(s):
        return s, 0
    low, which = signature(s)
    order = np.zeros(COORDINATES, np.int64)
    if len(common):
        x = s[which]
        at = np.minimum(np.searchsorted(common, x), len(common) - 1)
        order = np.where(common[at] == x, len(rank) - rank[at], 0)
    first = np.argsort(order, kind="stable")[: COORDINATES - MATCHES + 1 + SPARE]
    return np.unique(mix((first.astype(np.uint64) << np.uint64(32) | low[first]) ^ np.uint64(GOLD))), SPARE


def _posted_from(common: np.ndarray):
    order = np.argsort(common)
    return functools.partial(posted, common=common[order], rank=order)


def _apart(left: Column, right: Column) -> Column:
    """How many bits of two sketches differ."""
    return F.aggregate(F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def _collisions(left: str, right: str) -> Column:
    """How many coordinates collide."""
    pairs = F.zip_with(*(F.slice(f"{side}mark", 1, _PAIRS) for side in (left, right)), lambda x, y: x.bitwiseXOR(y))
    same = lambda x: F.when(x == 0, F.lit(1)).otherwise(F.lit(0))
    return F.aggregate(pairs, F.lit(0), lambda n, x: n + same(F.shiftrightunsigned(x, 32)) + same(x.bitwiseAND(F.lit(0xFFFFFFFF))))


def _few(apart: Column, left: str, right: str, share: int) -> Column:
    """Whether linked sets of these sizes may differ so much."""
    return (100 + share) * apart <= (100 - share) * (F.col(f"{left}n") + F.col(f"{right}n"))


def _near(left: str, right: str, share: int) -> Column:
    whole = _apart(*(F.slice(f"{side}mark", _PAIRS + 1, jaccard.SKETCH_LONGS) for side in (left, right)))
    wide = F.coalesce(_apart(F.col(f"{left}wide"), F.col(f"{right}wide")), F.lit(0))
    return (_collisions(left, right) >= MATCHES) & _few(whole, left, right, share) & _few(wide, left, right, share)


def _bits() -> Column:
    """The parity sketch."""
    return F.slice("mark", _PAIRS + 1, jaccard.SKETCH_LONGS)


MINHASH = jaccard.Method(
    SHARE, _PAIRS + jaccard.SKETCH_LONGS, mark, jaccard.wide_sketch, _posted_from, lambda shingles, sets: sets * (COORDINATES - MATCHES + 1 + SPARE), _near, _bits, False
)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id (of the id's type), kept (whether the row is its component's)."""
    found = jaccard.near_duplicates(docs, id_column, MINHASH)
    return found.withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_column), F.lit(True)))
