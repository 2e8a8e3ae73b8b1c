"""LM scoring with a probabilistic suffix tree over words.

Symbols are lower-case words and an end.  The root is the smoothed distribution of single tokens.  A
context of one or two words becomes a state if it occurs often enough and its next-symbol
distribution diverges from that of its longest proper suffix: the log-likelihood gained exceeds half a
logarithm of its count for each next symbol kept.  A state's distribution discounts what it has counted and
leaves the rest to its suffix, so that it sums to one; a text is scored by the longest suffix that
is a state.

Counts cover the whole training corpus, and every n-gram that occurs ``LEAST`` times is in the tree.
Nothing is broadcast and no n-gram is a row.  Texts are written once, as chunks of numbered words; a chunk sends the
sorted distinct hashes of its words, pairs, triples and contexts, cut by ranges of the hash, with its own counts or
sums, and gets back what all chunks together make of each.  Words and pairs go first, then triples of pairs that come
often enough and contexts of one word, then contexts of two; at last each chunk scores its texts.  Whoever decides on a
context of two passes its last word on, if that is no state by itself, so that which words are suffixes of states is found
without the chunks.  Chunks and answers are bucketed by chunk alike, so that only questions and answers are
shuffled.  A key is sent once by a chunk, however often it occurs there.  Words and n-grams are told by 64-bit hashes.
``grow`` and ``log_scores`` say the same in memory.

Cases: null and empty texts are one token, the end; without any training text every count is 0 and the
base is the uniform one of an empty vocabulary; very long texts are read whole, in memory that grows with them; a context
whose gain equals the penalty is no state; repeated rows are scored alike; an empty table gives an empty result; columns
other than the id and the text are not read.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, by_chunk, crc_bucket, discard, few_at_a_time, freed, shared_path, small_batches, text_of, written
from .hashing import GOLD, M, hashes_of_texts, mix

#: Least count of an n-gram of the tree, however many tokens there are.
LEAST = 2
DISCOUNT = 0.75
SMOOTH = 0.1
#: The end of a text; no word has a space.
END = b" "
#: Tokens of a chunk, at least one text each; keys that one range of the hash gets, on average.
_TOKENS = 1_000_000
_KEYS = 1_000_000
#: What chunks ask about: words, pairs, triples, contexts of one word and of two, and contexts as suffixes of others; those are
#: unsure until all contexts of two are decided.
WORD, PAIR, TRIPLE, ONE, TWO, SUFFIX, UNSURE = range(7)
_COUNTS = (WORD, PAIR, TRIPLE)
_ASKED = "kind int, part bigint, chunk bigint, keys binary, own binary, of binary"
_TOLD = "chunk bigint, kind int, part bigint, told binary, distinct bigint"


def words(text: str | None) -> list[bytes]:
    """Lower-case words (ASCII capitals only), as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def planes(x: np.ndarray) -> bytes:
    """Numbers as bytes: the first of each, then the second of each and so on, so that bytes that are all zero compress."""
    of_each = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize)
    out = np.empty(of_each.shape[::-1], np.uint8)
    for k in range(x.itemsize):  # several times as fast as a transposed copy
        out[k] = of_each[:, k]
    return out.tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    each = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    out = np.empty(each.shape[::-1], np.uint8)
    for k, x in enumerate(each):
        out[:, k] = x
    return out.view(kind).ravel()


def _sorted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted values, and the place of each; equal ones keep their order.

    Values are sorted as numbers of their leading bits and their place, which takes less than half the time of ``argsort``; where
    different hashes have the same leading bits and come out in the wrong order, all are sorted again.
    """
    if len(x) < 2:
        return x, np.arange(len(x))
    low, bits = x.min(), len(x).bit_length()
    over = np.uint64(max(0, int(x.max() - low).bit_length() + bits - 64))
    both = (x - low) >> over
    both <<= np.uint64(bits)
    both |= np.arange(len(x), dtype=np.uint64)
    both.sort()
    both &= np.uint64((1 << bits) - 1)
    order = both.view(np.int64)
    out = x[order]
    if (out[1:] < out[:-1]).any():
        order = np.argsort(x, kind="stable")
        out = x[order]
    return out, order


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the first place of each, and for each element the place of its value."""
    x, order = _sorted(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    back = np.empty(len(x), np.int64)
    back[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return x[first], order[first], back


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


def _chunks(batches, size: int):
    """From (id, held_out, text): chunks of whole texts, their words as places in the chunk's sorted distinct hashes."""
    task, made = TaskContext.get().partitionId(), 0
    ids, held, hashes, tokens = [], [], [], 0

    def chunk():
        every, lengths, out = np.concatenate(hashes), np.array([len(x) for x in hashes], np.int64), np.array(held, np.uint8)
        words, _, codes = _distinct(every)
        own = pa.concat_arrays(ids)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([(task << 33) + made], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own),
                *(pa.array([x], pa.binary()) for x in (out.tobytes(), planes(lengths), _packed(words), planes(codes.astype(np.uint32)))),
                pa.array([len(every)], pa.int64()), pa.array([int(lengths[out == 0].sum())], pa.int64()),
            ],
            names=["chunk", "ids", "held", "lengths", "words", "codes", "tokens", "train"],
        )

    for part in few_at_a_time(batches, 2):
        at = 0
        texts = hashes_of_texts((text.encode("utf-8", "surrogatepass").lower() for text in part.column(2).to_pylist()), GOLD)
        for k, (out, own) in enumerate(zip(part.column(1).to_pylist(), texts, strict=True)):
            hashes.append(own)
            held.append(out)
            tokens += len(hashes[-1])
            if tokens >= size:
                ids.append(part.column(0).slice(at, k + 1 - at))
                yield chunk()
                made, at = made + 1, k + 1
                ids, held, hashes, tokens = [], [], [], 0
        if at < part.num_rows:
            ids.append(part.column(0).slice(at))
    if hashes:
        yield chunk()


def _ranges(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """The ranges of the hash that have some of the sorted ``keys``, and from where to where those are."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(keys)]
    return [(int(part[lo]), lo, hi) for lo, hi in zip(edges, edges[1:]) if hi > lo]


def _asked(chunk: int, kind: int, parts: int, keys: np.ndarray, own: list[np.ndarray], of: np.ndarray | None = None, some: np.ndarray | None = None) -> list[tuple]:
    """A row for each range of the hash that has some of the sorted ``keys``, with the chunk's own numbers or sums; ``of``: the
    last words of ``some`` of the contexts."""
    packed = _sums_packed if kind in (ONE, TWO) else lambda x: planes(x[0])

    def last(lo: int, hi: int) -> bytes | None:
        if of is None:
            return None
        at = np.flatnonzero(some[lo:hi])
        return planes(np.concatenate((at.astype(np.uint64), of[lo:hi][at])))

    return [(kind, part, chunk, _packed(keys[lo:hi]), packed([x[lo:hi] for x in own]), last(lo, hi)) for part, lo, hi in _ranges(keys, parts)]


#: Sums of a context over the next symbols that a chunk speaks for: how many, their count, the context's; gain, what its suffix gives them.
_SUMS = (np.uint64, np.uint64, np.uint64, np.float64, np.float64)


def _sums_packed(sums: list[np.ndarray]) -> bytes:
    """A byte for each context that says whether there is any sum, and those that there are."""
    some = sums[0] > 0
    return some.astype(np.uint8).tobytes() + b"".join(planes(x[some].astype(kind)) for x, kind in zip(sums, _SUMS, strict=True))


def _sums_unpacked(data: bytes, n: int) -> np.ndarray:
    some = np.frombuffer(data, bool, n)
    out, m = np.zeros((len(_SUMS), n)), int(some.sum())
    for k, kind in enumerate(_SUMS):
        out[k, some] = from_planes(data[n + 8 * k * m : n + 8 * (k + 1) * m], kind)
    return out


def _rows(rows: list[tuple]) -> pa.Table:
    types = (("kind", pa.int32()), ("part", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("own", pa.binary()), ("of", pa.binary()))
    return pa.table([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(types)], names=[x for x, _ in types])


def _told(chunk, kind, part, told: list[bytes], distinct: list[int] | None = None) -> pa.Table:
    columns = (chunk, kind, part, pa.array(told, pa.binary()), pa.array(distinct or [0] * len(told), pa.int64()))
    return pa.table(columns, names=["chunk", "kind", "part", "told", "distinct"])


def _answers(asked: pa.Table, least: float, parts: int = 1) -> pa.Table:
    """What all chunks together make of the keys of one kind in one range of the hash, for each chunk in its own order.

    Counts: twice the count (0 for n-grams below ``least``), and 1 more for the chunk with the smallest number, which
    speaks for the key in sums.  Contexts: what is left to the suffix; for those of one word negative if they diverge too
    little, for those of two 0, and rows of no chunk with the words that are suffixes of states.  Words that chunks are unsure
    about are kept as they are.
    """
    asked = asked.sort_by("chunk")
    kind = asked["kind"][0].as_py()
    if kind == UNSURE:
        return _told(asked["chunk"], asked["kind"], asked["part"], asked["keys"].to_pylist())
    keys = [_unpacked(x) for x in asked["keys"].to_pylist()]
    size = np.array([len(k) for k in keys])
    if kind in (ONE, TWO):
        own = [_sums_unpacked(x, n) for x, n in zip(asked["own"].to_pylist(), size.tolist(), strict=True)]
    else:
        own = [from_planes(x, np.uint32)[None] for x in asked["own"].to_pylist()]
    every, order = _sorted(np.concatenate(keys))
    own = np.concatenate(own, axis=1)[:, order]
    new = np.concatenate(([True], every[1:] != every[:-1]))
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    distinct = 0
    if kind in _COUNTS:
        total = np.add.reduceat(own[0].astype(np.uint64), first)
        if kind != WORD:
            total[total < least] = 0
        distinct = int((total > 0).sum())
        told = total[group] << np.uint64(1)
        chunk = np.repeat(np.arange(len(size), dtype=np.int32), size)[order]
        told |= ((chunk == np.minimum.reduceat(chunk, first)[group]) & (total > 0)[group]).astype(np.uint64)
    else:
        symbols, taken, of_parent, gain = (np.add.reduceat(own[k], first) for k in (0, 1, 4, 3))
        total = np.maximum(np.maximum.reduceat(own[2], first), 1.0)
        left, keep = _decided(symbols, taken, of_parent, gain, total)
        told = np.where(symbols > 0, np.where(keep, left, -left if kind == ONE else 0.0), 0.0)[group]
    back = np.empty_like(told)
    back[order] = told
    mine = np.split(back, np.cumsum(size)[:-1])
    told = _told(asked["chunk"], asked["kind"], asked["part"], [planes(x) for x in mine], [distinct] + [0] * (len(mine) - 1))
    if kind == TWO:
        told = pa.concat_tables([told, _last_words(asked, mine, parts)])
    return told


def _last_words(asked: pa.Table, told: list[np.ndarray], parts: int) -> pa.Table:
    """The distinct last words of the states among contexts of two, as far as chunks are unsure about them, by range.

    Their rows have a number below 0, which is that of no chunk, and another one for each range of contexts.
    """
    found = [np.empty(0, np.uint64)]
    for x, left in zip(asked["of"].to_pylist(), told, strict=True):
        at, words = from_planes(x, np.uint64).reshape(2, -1)
        found.append(words[left[at.astype(np.int64)] > 0])
    words = np.unique(np.concatenate(found))
    ranges, n = _ranges(words, parts), -1 - asked["part"][0].as_py()
    kinds = pa.array([UNSURE] * len(ranges), pa.int32())
    return _told(pa.array([n] * len(ranges), pa.int64()), kinds, pa.array([r[0] for r in ranges], pa.int64()), [_packed(words[lo:hi]) for _, lo, hi in ranges])


def _suffixes(rows: pa.Table) -> pa.Table:
    """For each chunk and word of one range of the hash that it is unsure about, whether that is the suffix of a state."""
    chunks = rows["chunk"].to_pylist()
    words = [_unpacked(x) for x in rows["told"].to_pylist()]
    found = np.unique(np.concatenate([np.empty(0, np.uint64), *(x for k, x in zip(chunks, words, strict=True) if k < 0)]))
    own = [k for k, n in enumerate(chunks) if n >= 0]
    told = [planes((lookup(found, words[k]) >= 0).astype(np.uint8)) for k in own]
    return _told(rows["chunk"].take(own), pa.array([SUFFIX] * len(own), pa.int32()), rows["part"].take(own), told)


def _decided(symbols, taken, of_parent, gain, total) -> tuple[np.ndarray, np.ndarray]:
    """``_left`` and ``_diverges`` from sums over the kept next symbols of each context."""
    other, other_parent = np.maximum(total - taken, 0.0), np.clip(1.0 - of_parent, 1e-12, 1.0)
    gain = gain + np.where(other > 0, other * np.log(np.maximum(other, 1e-12) / (total * other_parent)), 0.0)
    return 1.0 - (taken - DISCOUNT * symbols) / total, gain > 0.5 * symbols * np.log(total + 1)


class _Chunk:
    """A chunk's tokens with what it has been told, and what it asks next."""

    def __init__(self, row: dict, answers: pa.Table | None = None):
        self.id, self.ids = row["chunk"], row["ids"]
        self.words, self.codes = _unpacked(row["words"]), from_planes(row["codes"], np.uint32).astype(np.intp)
        self.lengths = from_planes(row["lengths"], np.int64)
        self.held = np.frombuffer(row["held"], np.uint8).astype(bool)
        self.train = np.repeat(~self.held, self.lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.told = defaultdict(list)
        if answers is not None:
            found = zip(*(answers[x].to_pylist() for x in ("kind", "part", "told")), strict=True)
            for kind, _, x in sorted(found, key=lambda r: r[:2]):
                self.told[kind].append(from_planes(x, np.uint64 if kind in _COUNTS else np.uint8 if kind == SUFFIX else np.float64))
        # Pairs: where they end, their key, the words that they are of.
        inside = np.ones(len(self.codes), bool)
        inside[self.starts] = False
        self.at = np.flatnonzero(inside)
        # Those of them that end a triple: its first pair is the one before.
        self.second = np.flatnonzero(inside[self.at - 1])
        hashes = self.words[self.codes]
        self.pairs, first, self.pair = _distinct(mix(hashes[:-1] * M + hashes[1:])[inside[1:]])
        self.pair_b, self.pair_c = self.codes[self.at[first] - 1], self.codes[self.at[first]]

    def _heard(self, kind: int) -> np.ndarray:
        return np.concatenate(self.told[kind]) if self.told[kind] else np.empty(0, np.uint64 if kind in _COUNTS else np.float64)

    def _counted(self, back: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(back, weights=self.train[at], minlength=size).astype(np.uint32)

    def counts(self, floor: float) -> None:
        """After the first answers: counts of words and pairs; contexts that can be states."""
        self.count = (self._heard(WORD) >> np.uint64(1)).astype(np.int64)
        self.p0 = (self.count + SMOOTH) / floor
        told = self._heard(PAIR)
        self.pair_n, self.pair_own = (told >> np.uint64(1)).astype(np.int64), (told & np.uint64(1)).astype(bool)
        # They come often enough and something follows them.
        one, two = np.zeros(len(self.words), bool), np.zeros(len(self.pairs), bool)
        one[self.pair_b], two[self.pair[self.second - 1]] = True, True
        self.ones, self.twos = np.flatnonzero(one & (self.count >= LEAST)), np.flatnonzero(two & (self.pair_n > 0))

    def find_triples(self) -> None:
        """Triples both of whose pairs are in the tree."""
        often = (self.pair_n > 0)[self.pair]
        on = self.second[often[self.second - 1] & often[self.second]]
        self.at3, x, y = self.at[on], self.pair[on - 1], self.pair[on]
        self.triples, first, self.triple = _distinct(mix(self.pairs[x] * M + self.pairs[y]))
        self.triple_ab, self.triple_bc = x[first], y[first]

    def _sums(self, context, n, parent, total, contexts, totals) -> list[np.ndarray]:
        """Sums over kept next symbols (``context``: places in ``contexts``), for each context."""
        m = len(contexts)
        sums = lambda x: np.bincount(context, weights=x, minlength=m).astype(float)
        return [sums(np.ones(len(n))), sums(n), totals, sums(n * np.log(n / (total * parent))), sums(parent)]

    def single(self) -> None:
        """What contexts of one word leave to the root; negative if only as suffixes of others."""
        self.left1 = np.zeros(len(self.words))
        self.left1[self.ones] = self._heard(ONE)

    def ask(self, step: int, parts: int, floor: float) -> list[tuple]:
        if step == 0:
            words = np.bincount(self.codes, weights=self.train, minlength=len(self.words)).astype(np.uint32)
            return _asked(self.id, WORD, parts, self.words, [words]) + _asked(self.id, PAIR, parts, self.pairs, [self._counted(self.pair, self.at, len(self.pairs))])
        self.counts(floor)
        if step == 1:
            self.find_triples()
            own = np.flatnonzero(self.pair_own & (self.pair_n > 0))
            b, n = self.pair_b[own], self.pair_n[own]
            sums = self._sums(np.searchsorted(self.ones, b), n, self.p0[self.pair_c[own]], self.count[b], self.ones, self.count[self.ones])
            triples = _asked(self.id, TRIPLE, parts, self.triples, [self._counted(self.triple, self.at3, len(self.triples))])
            return triples + _asked(self.id, ONE, parts, self.words[self.ones], sums)
        self.single()
        self.find_triples()
        told = self._heard(TRIPLE)
        own = np.flatnonzero(told & np.uint64(1))
        n, ab, bc = (told[own] >> np.uint64(1)).astype(np.int64), self.triple_ab[own], self.triple_bc[own]
        b = self.pair_b[bc]
        parent = (self.pair_n[bc] - DISCOUNT) / self.count[b] + np.abs(self.left1[b]) * self.p0[self.pair_c[bc]]
        sums = self._sums(np.searchsorted(self.twos, ab), n, parent, self.pair_n[ab], self.twos, self.pair_n[self.twos])
        last, unsure = self.pair_c[self.twos], self.ones[self.left1[self.ones] < 0]
        contexts = _asked(self.id, TWO, parts, self.pairs[self.twos], sums, self.words[last], self.left1[last] < 0)
        return contexts + _asked(self.id, UNSURE, parts, self.words[unsure], [np.empty(0, np.uint8)])

    def scores(self, floor: float, total: int) -> pa.Table:
        """The texts' rows."""
        self.counts(floor)
        self.find_triples()
        self.single()
        unsure = self.ones[self.left1[self.ones] < 0]
        self.left1[unsure] = np.where(self._heard(SUFFIX) > 0, -self.left1[unsure], 0.0)
        # By pair, then by token; the first of a text has no context.
        b, n, p0 = self.pair_b, self.pair_n, self.p0[self.pair_c]
        left = self.left1[b]
        one = np.where(left > 0, np.where(n > 0, (n - DISCOUNT) / np.maximum(self.count[b], 1), 0.0) + left * p0, p0)
        p = np.empty(len(self.codes))
        p[self.starts], p[self.at] = self.p0[self.codes[self.starts]], one[self.pair]
        left2 = np.zeros(len(self.pairs))
        left2[self.twos] = self._heard(TWO)
        n3 = np.zeros(len(self.codes), np.int64)
        n3[self.at3] = (self._heard(TRIPLE) >> np.uint64(1)).astype(np.int64)[self.triple]
        on = self.second[(left2 > 0)[self.pair[self.second - 1]]]
        third, ab = self.at[on], self.pair[on - 1]
        p[third] = np.where(n3[third] > 0, (n3[third] - DISCOUNT) / self.pair_n[ab], 0.0) + left2[ab] * p[third]
        each = lambda x: np.add.reduceat(x, self.starts)
        known = each((self.count > 0).astype(np.int64)[self.codes])
        columns = [pa.array(x) for x in (self.held, self.lengths, known, np.full(len(known), total, np.int64), each(np.log10(self.p0)[self.codes]), each(np.log10(p)))]
        return pa.table([self.ids, *columns], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def _chunk_of(table: pa.Table, k: int = 0, answers: pa.Table | None = None) -> _Chunk:
    row = {x: table[x][k].as_py() for x in ("chunk", "held", "lengths", "words", "codes")}
    return _Chunk(row | {"ids": table["ids"][k].values}, answers)


def _first_asked(batches, parts: int):
    for b in batches:
        t = pa.Table.from_batches([b])
        for k in range(t.num_rows):
            yield from _rows(_chunk_of(t, k).ask(0, parts, 0.0)).to_batches()


def lookup(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def _pair_keys(ids: np.ndarray, n: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of neighbouring numbers below ``n``, and their places (of the second)."""
    a, b = ids[:-1], ids[1:]
    ok = np.flatnonzero((a < n) & (b < n) & (a != end))
    return a[ok] * n + b[ok], ok + 1


def _triple_keys(ids: np.ndarray, n: int, end: int, pairs: np.ndarray) -> np.ndarray:
    """Keys (number of the first pair, third) of triples both of whose pairs are in ``pairs``."""
    key, place = _pair_keys(ids, n, end)
    at = lookup(pairs, key)
    of = np.full(len(ids), -1, np.int64)
    of[place] = at
    first, second = of[1:-1], of[2:]  # the pairs that end in the middle and in the third
    ok = np.flatnonzero((first >= 0) & (second >= 0))
    return first[ok] * n + ids[ok + 2]


@dataclass
class Tree:
    """States of one word (by number) and of two (by key), their next symbols and what they leave to the suffix.

    ``rest1``/``rest2`` are 1 where a context isn't a state; ``next1``/``next2`` are sorted keys (state, symbol).
    """

    n: int
    rest1: np.ndarray
    next1: np.ndarray
    p1: np.ndarray
    pairs: np.ndarray
    rest2: np.ndarray
    next2: np.ndarray
    p2: np.ndarray

    def p_one(self, a: np.ndarray, b: np.ndarray, p0: np.ndarray) -> np.ndarray:
        """P(b | a) given P(b)."""
        at = lookup(self.next1, a * self.n + b)
        return np.where(at >= 0, self.p1[at] if len(self.p1) else 0.0, 0.0) + self.rest1[a] * p0


def grow(n: int, count: np.ndarray, p0: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], triples: tuple[np.ndarray, np.ndarray]) -> Tree:
    """The tree: states that pass the divergence test, and the suffixes of states.

    ``count`` and ``p0`` are by number; pairs and triples are sorted keys with counts.
    """
    rest1 = np.ones(n + 1)
    pair_keys, pair_n = pairs
    a, b = pair_keys // n, pair_keys % n
    keep1 = _diverges(a, pair_n, count, p0[b], n)
    # Two-word states come from the three-word counts; their suffix is the second word.
    triple_keys, triple_n = triples
    state, third = triple_keys // n, triple_keys % n
    second = b[state]
    left1 = _left(a, pair_n, count, n)
    at = lookup(pair_keys, second * n + third)
    own = np.where(at >= 0, (pair_n[at] - DISCOUNT) / count[second], 0.0) if len(pair_keys) else np.zeros(0)
    parent = own + left1[second] * p0[third]
    keep2 = _diverges(state, triple_n, pair_n, parent, len(pair_keys))
    keep1[np.unique(b[np.flatnonzero(keep2)])] = True  # suffixes of states are states
    rest1[:n] = np.where(keep1, left1, 1.0)
    on1 = keep1[a]
    left2 = _left(state, triple_n, pair_n, len(pair_keys))
    on2 = keep2[state]
    return Tree(
        n, rest1, pair_keys[on1], (pair_n[on1] - DISCOUNT) / count[a[on1]],
        pair_keys, np.where(keep2, left2, 1.0), triple_keys[on2], (triple_n[on2] - DISCOUNT) / pair_n[state[on2]],
    )


def _left(state: np.ndarray, n_next: np.ndarray, n_state: np.ndarray, size: int) -> np.ndarray:
    """The share of each state that its kept next symbols leave to the suffix."""
    taken = np.bincount(state, weights=n_next - DISCOUNT, minlength=size)[:size]
    return 1.0 - taken / np.maximum(n_state[:size], 1)


def _diverges(state: np.ndarray, n_next: np.ndarray, n_state: np.ndarray, parent: np.ndarray, size: int) -> np.ndarray:
    """Whether a state's kept next symbols gain more than half a log of its count each.

    What isn't kept is one further symbol, for the state and for its suffix alike.
    """
    if not size:
        return np.zeros(0, bool)
    total = np.maximum(n_state[:size].astype(float), 1.0)
    symbols = np.bincount(state, minlength=size)[:size]
    gain = np.bincount(state, weights=n_next * np.log(n_next / (total[state] * parent)), minlength=size)[:size]
    other = np.maximum(total - np.bincount(state, weights=n_next, minlength=size)[:size], 0.0)
    other_parent = np.clip(1.0 - np.bincount(state, weights=parent, minlength=size)[:size], 1e-12, 1.0)
    gain += np.where(other > 0, other * np.log(np.maximum(other, 1e-12) / (total * other_parent)), 0.0)
    return (symbols > 0) & (gain > 0.5 * symbols * np.log(total + 1))


def log_scores(tree: Tree, ids: np.ndarray, p0: np.ndarray) -> np.ndarray:
    """log10 P(token | what stands before it), given P(token), for one text's numbers."""
    n = tree.n
    low = np.minimum(ids, n)
    p = p0.copy()
    if len(ids) > 1:
        a, b = low[:-1], low[1:]
        inside = (a < n) & (b < n)
        one = tree.rest1[a] * p0[1:]
        if inside.any():
            one[inside] = tree.p_one(a[inside], b[inside], p0[1:][inside])
        p[1:] = one
        if len(ids) > 2 and len(tree.pairs):
            key = np.where(inside, a * n + b, -1)
            pair = lookup(tree.pairs, key[:-1])
            on = np.flatnonzero((pair >= 0) & (tree.rest2[pair] < 1.0))
            if len(on):
                third = low[on + 2]
                at = np.where(third < n, lookup(tree.next2, pair[on] * n + third), -1)
                p[on + 2] = np.where(at >= 0, tree.p2[at] if len(tree.p2) else 0.0, 0.0) + tree.rest2[pair[on]] * p[on + 2]
    return np.log10(p)


def score_texts(docs: DataFrame, id_column: str = "doc_id", gram_share: float = 0.0, word_share: float = 0.0) -> DataFrame:
    """One row for each document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the documents whose crc32(id as text) mod 10 is not 0.  With ``gram_share``, an n-gram has at least that
    share of all tokens, too; ``word_share`` is without effect, as no words are broadcast.
    """
    spark, size, kind = small_batches(docs.sparkSession), _TOKENS, docs.schema[id_column].dataType.simpleString()
    plain = docs.select(F.col(id_column).alias("id"), (crc_bucket(id_column, 10) == 0).alias("held_out"), text_of(docs).alias("text"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"edgeprobe_{x}_{uuid.uuid4().hex}" for x in ("chunks", "answers")]
    paths = [shared_path(spark, x) for x in ("chunks", "answers")]
    form = f"chunk bigint, ids array<{kind}>, held binary, lengths binary, words binary, codes binary, tokens bigint, train bigint"
    try:
        chunks = bucketed(plain.mapInArrow(lambda batches: _chunks(batches, size), form), names[0], paths[0], buckets)
        tokens, total = (x or 0 for x in chunks.agg(F.sum("tokens"), F.sum("train")).first())
        parts, least = max(1, -(-tokens // _KEYS)), max(float(LEAST), gram_share * total)
        floor, answers = 1.0, None
        for step in range(3):
            if step == 0:
                asked = chunks.mapInArrow(lambda batches: _first_asked(batches, parts), _ASKED)
            else:
                asked = by_chunk(chunks, answers, _asking(step, parts, floor), _ASKED)
            told = asked.groupBy("kind", "part").applyInArrow(lambda t: _answers(t, least, parts), _TOLD)
            answers = bucketed(told.repartition(buckets, "chunk"), names[1], paths[1], buckets)
            asked = told = None
            freed(spark)
            if step == 0:
                distinct = answers.where(F.col("kind") == WORD).agg(F.sum("distinct")).first()[0] or 0
                floor = total + SMOOTH * (distinct + 1)
        told = answers.where(F.col("kind") == UNSURE).groupBy("part").applyInArrow(_suffixes, _TOLD)
        answers = bucketed(told.repartition(buckets, "chunk"), names[1], paths[1], buckets).where(F.col("kind") != UNSURE)
        told = None
        freed(spark)
        result = f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
        return written(by_chunk(chunks, answers, _scoring(floor, total), result), "scores").withColumnRenamed("id", id_column)
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(spark, paths)


def _asking(step: int, parts: int, floor: float):
    return lambda chunk, answers: _rows(_chunk_of(chunk, 0, answers).ask(step, parts, floor))


def _scoring(floor: float, total: int):
    return lambda chunk, answers: _chunk_of(chunk, 0, answers).scores(floor, total)
