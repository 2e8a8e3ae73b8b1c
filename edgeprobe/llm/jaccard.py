"""N-gram Jaccard join by parity sketches: near-duplicate groups, with no link lost.

A document's set is its distinct word shingles, as 64-bit hashes.  Seen as a parity sketch of
2**64 bits in which each shingle flips one bit, the Hamming distance of two sketches is the size of
the symmetric difference, and a shorter sketch (bits folded together by XOR) has a Hamming distance
that is never larger.  Two sets of n1 and n2 shingles link when 100*|A&B| >= 75*|A|B|, hence
only if they differ in at most (n1+n2)/7 bits and neither is under 3/4 of the other.

*Pigeonhole per size band.*  The sketch is cut into 2**k equal blocks.  If a document has more
than n/3 non-empty blocks, then any linked partner has at least one of those blocks bit for bit, as
(n1+n2)/7 <= n/3 for each of the two.  A document takes the first such k as its level and joins on
the 64-bit XOR of each of its non-empty blocks, at that level and the coarser ones that a partner of
3/4 its size can have as level (2**k > n/4).  Of two linked documents the one with the coarser
level vouches for the match, and the other has that level's blocks too.

*Common shingles.*  Blocks made of common shingles only (a licence line) join what isn't alike.
They are left out wherever a document has more than n/3 blocks besides them at some level; other documents keep
them.  Which shingles count as common has no effect on the result, for the argument above holds for
the blocks that stay.

*Dealing.*  A chunk sends its keys in rows of packed arrays, one for each bucket that it has keys of; where there are more buckets than ``FAN``, rows of
several buckets go to tasks that deal them again, many keys at once.  So neither a chunk's work nor the number of partitions grows with the data.
Keys are cut to 48 bits, and lie by class, with a count for each, for they are most of what is on disk at once.  Blocks that a shorter key
throws together only give further candidates; a document with two such blocks has one list fewer to do without.

*Hot groups.*  Within a chunk of a partition the members of a block hang on one of them, and only
that one is dealt out by the block; so a block with a third of all documents sends a row or two for each
chunk.  Candidates are (member, representative) pairs, as many as there are shared blocks, never all
pairs of a group.  After these are verified and their components found, blocks that still hold
several components get other representatives, once.  Most documents are done then: one whose own level
has more than n/3 blocks that hold a single component has met every partner that it vouches for.  Only
the documents for which that isn't so are compared with those members of their blocks that are in
other components, and each of them does without as many of its largest blocks as it has to spare.
That happens inside tasks, on whole sketches: a block first gives only pairs that join its components one after
another (at most one for each member), then, as some of these don't link, whatever pairs are left between components.

Cases: null and empty texts, and those of white space, have no set and are linked with nothing;
texts of fewer words than a shingle are one shingle; very long texts are read whole, in memory that grows with
them; equal sets are one class and compared once; rows with a null id come back with a component of null,
uncompared; repeated ids are one document with several texts, which join whatever any of them links to;
ids may be numbers or text, the smallest by their own order; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, few_at_a_time, freed, shuffles_removed, small_batches, text_of, written
from .hashing import GOLD, M, mix, word_hashes

SHINGLE = 5
#: A shingle is common if this share of a chunk's distinct sets has it, and at least COMMON_LEAST do.
COMMON_SHARE, COMMON_LEAST = 0.01, 8
#: Most shingles that are treated as common (8 bytes each, broadcast); the most frequent come first.
COMMON_MOST = 200_000
#: Shingles held at once in a worker, 8 bytes each.
CHUNK = 600_000
#: Rows of a bucket of block keys, about: what one task holds of it at a time (some 40 bytes each).
BUCKET_KEYS = 2_000_000
#: Bytes of a key that are sent, and their bits.
KEY_BYTES, KEY_BITS = 6, np.uint64((1 << 48) - 1)
#: Most rows into which a chunk's keys are dealt.  More buckets are dealt in two steps, of as many keys at once in the second.
FAN, AGAIN = 4000, 4_000_000
#: Most partitions that buckets are spread over; one reads its buckets one after another.
MOST_PARTS = 20_000
#: Most ids that are broadcast (8 bytes each) to pick texts; more are joined by a shuffle.
SENT_IDS = 1_000_000
SKETCH_LONGS, FOLDED = 64, 8
#: How often blocks that hold several components get other representatives before all of their members are compared.
OTHER_STARS = 1
#: Edges in a partition while components are found, about.
EDGES = 200_000
#: Most members of a list, about, whose sketches are compared in one task; rows and pairs that such a task holds at once.
PART, ROWS_HELD, PAIRS_HELD = 2000, 10_000, 200_000
#: Documents in hundredths of the union that their intersection has at least.
SHARE = 75
#: Sets over so many shingles have a longer sketch, too.
WIDE_FROM, WIDE_LONGS = 3000, 256


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles (ASCII capitals lowered, white space parts words)."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(h):
        return h
    k = min(size, len(h))
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out *= M
        out += h[i : len(h) - k + 1 + i]
    out = mix(out + np.uint64(k))
    out.sort()
    return out if len(out) == 1 else out[np.concatenate(([True], out[1:] != out[:-1]))]


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def most_different(n1: int, n2: int) -> int:
    """The largest symmetric difference of linked sets of these sizes."""
    return (n1 + n2) // 7


def _levels(s: np.ndarray) -> np.ndarray:
    """For each shingle but the first the coarsest level (of 2**level blocks) that parts it from the one before; 33 if none up to 32 does."""
    apart = ((s[1:] ^ s[:-1]) >> np.uint64(32)).astype(np.float64)
    return np.where(apart > 0, 33 - np.frexp(apart)[1], 33)


def block_keys(s: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, int]:
    """The keys that a set joins on, and how many blocks its own level has beyond those it needs; ``common`` is sorted."""
    n = len(s)
    if not n:
        return s, 0
    mixed = mix(s ^ M)
    rare = None
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        rare = common[at] != s
        rare = None if rare.all() else rare.astype(np.int64)
    first = max(0, (n // 4).bit_length())
    while first and 2 ** (first - 1) * 4 > n:
        first -= 1
    last = (4 * n - 1).bit_length()  # levels up to here can be a document's own, then only the finest
    parted = _levels(s)
    made: list[tuple[int, np.ndarray, np.ndarray]] = []
    own = None
    for k in [*range(first, last + 2), 64]:
        starts = np.concatenate(([0], np.flatnonzero(parted <= k) + 1)) if k < 64 else np.arange(n)
        key = mix(np.bitwise_xor.reduceat(mixed, starts) + np.uint64((k + 1) * GOLD % 2**64))
        usable = np.ones(len(key), bool) if rare is None else np.add.reduceat(rare, starts) > 0
        made.append((k, key, usable))
        if k != last + 1 and 3 * int(usable.sum()) > n:
            own = k
            break
    out = [key[usable] for _, key, usable in made]
    blocks = len(out[-1])
    if own is None:  # too much of it is common: blocks of common shingles only, too
        for k, key, usable in made:
            out.append(key[~usable])
            blocks = len(key)
            if k != last + 1 and 3 * blocks > n:
                break
    return np.concatenate(out), blocks - n // 3 - 1


def sketch(s: np.ndarray, longs: int = SKETCH_LONGS) -> np.ndarray:
    """A parity sketch of 64 * longs bits: each shingle flips one."""
    odd = np.bincount((s & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def wide_sketch(s: np.ndarray) -> np.ndarray | None:
    """A longer sketch of a large set, whose short one is half full of chance."""
    return sketch(s, WIDE_LONGS) if len(s) > WIDE_FROM else None


def linked(a: np.ndarray, b: np.ndarray, share: int = SHARE) -> bool:
    """Whether 100 * intersection >= share * union, exactly."""
    if not len(a) or not len(b):
        return False
    both = np.concatenate([a, b])
    both.sort()
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= share * (len(a) + len(b) - inter)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


_WIDE = pa.list_(pa.int64())


@dataclass(frozen=True)
class Method:
    """How candidates are found, and told apart before whole sets are compared.

    ``keys_from`` gets the common shingles, the most frequent first, and returns what gives a set's keys and how many of their
    lists it can do without.  ``mark`` gives a set's mark (``longs`` whole numbers, ``wide`` further ones or none); ``near`` says of the
    columns of two marks whether their sets may link, and ``bits`` has the parity sketch in a mark, by which a list's members are compared.
    """

    share: int
    longs: int
    mark: Callable[[np.ndarray], np.ndarray]
    wide: Callable[[np.ndarray], np.ndarray | None]
    keys_from: Callable[[np.ndarray], Callable[[np.ndarray], tuple[np.ndarray, int]]]
    keys_in_all: Callable[[int, int], int]
    near: Callable[[str, str, int], Column]
    bits: Callable[[], Column]
    #: Whether ``near`` reads the numbers of marks as columns s0, s1, ...; else it reads the array.
    columns: bool = True
    #: How often lists that hold several components get other representatives before their members are compared.
    rounds: int = OTHER_STARS

    def sizes(self, left: str, right: str) -> Column:
        """The condition on sizes that every link meets."""
        return 100 * F.least(left, right) >= self.share * F.greatest(left, right)

    def may_link(self, left: str, right: str) -> Column:
        return self.sizes(f"{left}n", f"{right}n") & self.near(left, right, self.share)


def _profile(longs: int, mark, wide_mark):
    return functools.partial(_profiles, longs, mark, wide_mark)


def _profiles(longs: int, mark, wide_mark, batches):
    """A row for each document (id, n, digest, mark), and rows (shingle, count) for what is common in a chunk."""
    names = ["id", "n", "hi", "lo", "shingle", "count", "mark", "wide"]
    held: dict[tuple[int, int], np.ndarray] = {}
    size, kind = 0, None

    def flush():
        found = np.concatenate(list(held.values()))
        found.sort()
        starts = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        counts = np.diff(np.append(starts, len(found)))
        hot = counts >= max(COMMON_LEAST, COMMON_SHARE * len(held))
        none = pa.nulls(int(hot.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([pa.nulls(len(none), kind), *[none] * 3, _signed(found[starts[hot]]), pa.array(counts[hot].astype(np.int64)), pa.nulls(len(none), _WIDE), pa.nulls(len(none), _WIDE)], names=names)

    for part in few_at_a_time(batches, 1):
        kind = part.column(0).type
        rows, bits, wide = [], [], []
        for text in part.column(1).to_pylist():
            s = shingles(text)
            d = digest(s)
            rows.append((len(s), *d))
            bits.append(mark(s))
            wide.append(wide_mark(s))
            if len(s) and d not in held:
                held[d] = s
                size += len(s)
                if size >= CHUNK:
                    yield flush()
                    held.clear()
                    size = 0
        n, hi, lo = (pa.array(np.array([r[i] for r in rows], np.int64)) for i in range(3))
        none = pa.nulls(len(rows), pa.int64())
        bits = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * longs), pa.array(np.array(bits, np.int64).reshape(-1)))
        yield pa.RecordBatch.from_arrays([part.column(0), n, hi, lo, none, none, bits, pa.array(wide, _WIDE)], names=names)
    if held:
        yield flush()


_DEALT = "bucket bigint, keys binary, who binary, classes binary, inner_keys binary, inner_who binary, inner_rep binary, spare binary"
_DEALT_NAMES = [c.split()[0] for c in _DEALT.split(", ")]


def _packed(bucket: int, *cells) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), *(pa.array([None if x is None else x.tobytes()], pa.binary()) for x in cells)], names=_DEALT_NAMES)


def _bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key & KEY_BITS) % np.uint64(buckets)).astype(np.int64)


def _short(key: np.ndarray) -> np.ndarray:
    """The low bytes of keys."""
    return np.ascontiguousarray(key, "<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]


def _long(data) -> np.ndarray:
    """Keys of their low bytes."""
    low = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :KEY_BYTES] = low
    return out.view("<u8")[:, 0]


def _deal(head, inner, buckets: int, per: int):
    """A row of packed arrays for each ``per`` buckets that have any of these keys.

    ``head`` is (key, representative), each key once; ``inner`` is (key, representative, member) of the others, which are spread
    by key and member.  The keys of ``head`` lie by representative, with a count for each of ``classes``; members of ``inner`` are packed as
    numbers into ``classes``.
    """
    own, other = _bucket_of(head[0], buckets) // per, _bucket_of(mix(inner[0] ^ inner[2].view(np.uint64)), buckets) // per
    order, inner_order = np.lexsort((head[1], own)), np.argsort(other, kind="stable")
    own, other = own[order], other[inner_order]
    there = np.unique(np.concatenate([own, other]))  # the chunk's own ones, however many there are
    spans = [np.searchsorted(x, there, side) for x in (own, other) for side in ("left", "right")]
    for bucket, start, end, inner_start, inner_end in zip(there.tolist(), *spans, strict=True):
        a, b = order[start:end], inner_order[inner_start:inner_end]
        w, v, r = head[1][a], inner[2][b], inner[1][b]
        used, back = np.unique(np.concatenate([w, v, r]), return_inverse=True)
        back = back.astype(np.uint16 if len(used) <= 65536 else np.uint32)
        parts = np.split(back, [len(w), len(w) + len(v)])
        counts = np.bincount(parts[0], minlength=len(used))
        counts = counts.astype(np.uint8 if counts.max() < 256 else np.uint32)
        yield _packed(bucket, _short(head[0][a]), counts, used, inner[0][b], parts[1], parts[2], None)


def _keys(common, buckets: int, per: int, keys_from):
    """For each chunk and ``per`` buckets of keys one row of packed arrays, and a row that has only ``spare`` and ``classes``:
    how many lists each class of the chunk can do without."""

    def flush(keys, numbers, spare):
        key, which = np.concatenate(keys) & KEY_BITS, np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        order = np.argsort(key, kind="stable")
        key, which = key[order], which[order]
        twice = np.r_[False, (key[1:] == key[:-1]) & (which[1:] == which[:-1])]  # two blocks of one set in one list
        spare = np.array(spare) - np.bincount(which[twice], minlength=len(spare))
        yield _packed(_bucket_of(numbers[:1].view(np.uint64), buckets)[0] // per, None, None, numbers, None, None, None, spare.astype(np.int32))
        key, who = key[~twice], numbers[which[~twice]]
        new = np.r_[True, key[1:] != key[:-1]]
        rep = who[np.flatnonzero(new)][np.cumsum(new) - 1]
        yield from _deal((key[new], who[new]), (key[~new], rep[~new], who[~new]), buckets, per)

    def run(batches):
        make = keys_from(np.array(common.value, np.int64).view(np.uint64))
        keys, numbers, spare, seen, size = [], [], [], set(), 0
        for part in few_at_a_time(batches, 0):
            for text in part.column(0).to_pylist():
                s = shingles(text)
                d = digest(s)
                if not len(s) or d in seen:
                    continue
                seen.add(d)
                own, more = make(s)
                keys.append(own)
                spare.append(more)
                numbers.append(d[0])
                size += len(own)
                if size >= CHUNK:
                    yield from flush(keys, np.array(numbers, np.int64), spare)
                    keys, numbers, spare, size = [], [], [], 0
                    seen.clear()
        if keys:
            yield from flush(keys, np.array(numbers, np.int64), spare)

    return run


def _unpacked(cells) -> tuple:
    """The head and the inner rows of packed arrays."""
    raw = [c.as_buffer() for c in cells]
    classes = np.frombuffer(raw[2], np.int64)
    kind = np.uint16 if len(classes) <= 65536 else np.uint32
    who = np.repeat(classes, np.frombuffer(raw[1], np.uint8 if raw[1].size == len(classes) else np.uint32))
    inner_who, inner_rep = (classes[np.frombuffer(raw[c], kind)] for c in (4, 5))
    return (_long(raw[0]), who), (np.frombuffer(raw[3], np.uint64), inner_rep, inner_who)


def _dealt_again(buckets: int, per: int):
    """Rows of ``per`` buckets, sorted by them, dealt to single buckets, many keys at once."""

    def run(batches):
        held, size, at = [], 0, None

        def flush():
            head, inner = ([np.concatenate([h[k][i] for h in held]) for i in range(n)] for k, n in ((0, 2), (1, 3)))
            held.clear()
            order = np.lexsort((head[1], head[0]))
            key, who = head[0][order], head[1][order]
            new = np.r_[True, key[1:] != key[:-1]][: len(key)]
            rep = who[np.flatnonzero(new)][np.cumsum(new) - 1]
            more = ~new & (rep != who)
            inner = [np.concatenate(x) for x in zip(inner, (key[more], rep[more], who[more]), strict=True)]
            yield from _deal((key[new], who[new]), inner, buckets, 1)

        for b in batches:
            for i in range(b.num_rows):
                group, *cells, spare = (b.column(c)[i] for c in range(len(_DEALT_NAMES)))
                if spare.is_valid:
                    yield b.slice(i, 1)
                    continue
                if held and (group.as_py() != at or size >= AGAIN):
                    yield from flush()
                    size = 0
                at = group.as_py()
                held.append(_unpacked(cells))
                size += len(held[-1][0][0]) + len(held[-1][1][0])
        if held:
            yield from flush()

    return run


def _stars(batches):
    """From rows sorted by bucket: (key, rep, cls) wherever a block has another class, and (null, spare, cls).

    A bucket is held whole; their number is chosen so that it has about BUCKET_KEYS rows.
    """
    held: list[list[np.ndarray]] = []
    bucket = None

    def flush():
        key, cls, inner_key, inner_rep, inner_cls = (np.concatenate([h[i] for h in held]) for i in range(5))
        held.clear()
        order = np.lexsort((cls, key))
        key, cls = key[order], cls[order]
        del order
        new = np.r_[True, key[1:] != key[:-1]][: len(key)]
        rep = cls[np.flatnonzero(new)][np.cumsum(new) - 1] if len(key) else cls
        other = rep != cls
        out = [np.concatenate(x) for x in ((key[other], inner_key), (rep[other], inner_rep), (cls[other], inner_cls))]
        for at in range(0, len(out[0]), 200_000):
            yield pa.RecordBatch.from_arrays([_signed(out[0][at : at + 200_000]), *(pa.array(x[at : at + 200_000]) for x in out[1:])], names=["key", "rep", "cls"])

    for b in batches:
        for i in range(b.num_rows):
            k, *cells, spare = (b.column(c)[i] for c in range(len(_DEALT_NAMES)))
            if spare.is_valid:
                more = np.frombuffer(spare.as_buffer(), np.int32).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(more), pa.int64()), pa.array(more), pa.array(np.frombuffer(cells[2].as_buffer(), np.int64))], names=["key", "rep", "cls"])
                continue
            if k.as_py() != bucket and held:
                yield from flush()
            bucket = k.as_py()
            (key, who), (inner_key, inner_rep, inner_who) = _unpacked(cells)
            held.append([key, who, inner_key.copy(), inner_rep, inner_who])
    if held:
        yield from flush()


def _sets(batches):
    for part in few_at_a_time(batches, 1):
        sets = [shingles(t) for t in part.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])


def _verify(share: int, batches):
    for b in batches:
        ok = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), share) for x, y in zip(b.column(2), b.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])


def _ids(pairs: DataFrame) -> tuple[DataFrame, bool]:
    """The documents of pairs, and whether they are few enough to be broadcast."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    return ids, ids.count() <= SENT_IDS


def verified(pairs: DataFrame, plain: DataFrame, share: int = SHARE) -> DataFrame:
    """The pairs (a, b) of ids that link, by the whole sets of their texts."""
    kind = plain.schema["id"].dataType.simpleString()
    pairs = cut(pairs.select("a", "b"))
    pairs = cut(pairs.coalesce(1 + pairs.count() // EDGES))
    ids, few = _ids(pairs)
    sets = written(plain.join(F.broadcast(ids) if few else ids, "id", "left_semi").mapInArrow(_sets, f"id {kind}, shingles binary"), "sets", paths := [])
    left = sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b"))
    right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a"))
    both = pairs.join(left, "b").join(right, "a").select("a", "b", "of_a", "of_b")
    found = cut(both.mapInArrow(functools.partial(_verify, share), f"a {kind}, b {kind}, linked boolean").where("linked").select("a", "b").distinct())
    discard(plain.sparkSession, paths)
    return found


def parity_near(left: str, right: str, share: int) -> Column:
    """The bound on the symmetric difference, by sketches."""
    marks = [f"s{i}" for i in range(SKETCH_LONGS)]
    apart = sum((F.bit_count(F.col(f"{left}{c}").bitwiseXOR(F.col(f"{right}{c}"))) for c in marks), F.lit(0))
    bits = F.aggregate(F.zip_with(f"{left}wide", f"{right}wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    most = (100 - share) * (F.col(f"{left}n") + F.col(f"{right}n"))
    return ((100 + share) * apart <= most) & ((100 + share) * F.coalesce(bits, F.lit(0)) <= most)


def _block_keys_from(common: np.ndarray):
    return functools.partial(block_keys, common=np.sort(common))


PARITY = Method(SHARE, SKETCH_LONGS, sketch, wide_sketch, _block_keys_from, lambda shingles, sets: shingles, parity_near, lambda: F.col("mark"))


def _within(pairs: DataFrame, sketches: DataFrame, more: list[str], method: Method) -> DataFrame:
    """The pairs (a, b) that may link by sizes and sketches; grouped, as a repeated id has several sketches (no further
    shuffle, since the pairs are dealt by ``b`` already)."""
    side = lambda c, name: sketches.select(F.col("id").alias(c), *[F.col(x).alias(f"{name}{x}") for x in ("n", "mark", "wide")])
    both = pairs.join(side("a", "l_"), "a").join(side("b", "r_"), "b")
    if method.columns:
        both = both.withColumns({f"{name}s{i}": F.get(f"{name}mark", F.lit(i)) for name in ("l_", "r_") for i in range(method.longs)})
    both = both.where(method.may_link("l_", "r_"))
    return both.groupBy("a", "b").agg(F.count("*").alias("_rows"), *[F.max(c).alias(c) for c in more]).drop("_rows")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b); nodes without edges are left out.

    Large-star and small-star rounds: every round hangs each node's neighbours on the smallest, by an
    aggregation and a join, until nothing changes (logarithmically many rounds).
    """
    edges = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    # Few edges are kept in few files, whatever the number of shuffle partitions.
    parts = 1 + edges.count() // EDGES
    now, mark = cut(edges.distinct().coalesce(parts)), None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct().coalesce(parts))
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return F.broadcast(out) if seen[0] <= SENT_IDS else out
        mark = seen


def _labelled(df: DataFrame, comps: DataFrame, column: str) -> DataFrame:
    """Add the component of a column's document as ``of_<column>``."""
    known = comps.select(F.col("node").alias(column), F.col("component").alias(f"of_{column}"))
    return df.join(known, column, "left").withColumn(f"of_{column}", F.coalesce(f"of_{column}", column))


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose documents are in different components."""
    return _labelled(_labelled(pairs, comps, "a"), comps, "b").where("of_a != of_b").select("a", "b")


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components with further links (a, b); the shuffles that found these are removed."""
    new = cut(_apart(links.select("a", "b"), comps))
    freed(links.sparkSession)
    if new.isEmpty():
        return comps
    return components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).union(new))


def _blocks(stars: DataFrame) -> DataFrame:
    """(key, times, x): the members of blocks of more than two; ``times`` blocks have the same rows, of which one is enough.

    A block of two is a pair that was tried.  The same row comes from every chunk that has its documents, so
    a block's rows are told by sums of their hashes' halves, in which equal ones don't cancel as under XOR.
    """
    hashes = [F.xxhash64("a", "b"), F.xxhash64("b", "a")]
    halves = [half for h in hashes for half in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    sums = [F.sum(half).alias(f"h{k}") for k, half in enumerate(halves)]
    many = stars.groupBy("key").agg(F.count("*").alias("m"), *sums)
    one = many.where("m > 1").groupBy("m", *(f"h{k}" for k in range(len(sums)))).agg(F.min("key").alias("key"), F.count("*").alias("times")).select("key", "times")
    rows = stars.join(one, "key")
    return rows.select("key", "times", F.explode(F.array("a", "b")).alias("x")).distinct()


def _mixed(blocks: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, times, x, of_x): the blocks in which several components are left."""
    labelled = _labelled(blocks, comps, "x")
    several = labelled.groupBy("key").agg(F.min("of_x").alias("low"), F.max("of_x").alias("high")).where("low < high").select("key")
    return labelled.join(several, "key", "left_semi")


def _unsettled(members: DataFrame, spare: DataFrame) -> DataFrame:
    """The documents x that can't do without all their mixed blocks, and so may not have met a partner that they vouch for."""
    mixed = members.groupBy("x").agg(F.sum("times").alias("mixed"))
    return mixed.join(spare, "x").where("mixed > spare").select("x")


def _around(members: DataFrame, these: DataFrame) -> DataFrame:
    """All members of the blocks that have any of these documents."""
    return members.join(members.join(these, "x", "left_semi").select("key").distinct(), "key", "left_semi")


def _opened(members: DataFrame, spare: DataFrame) -> DataFrame:
    """The members with ``open``: whether a document is to be compared with this block, for it does without its largest ones."""
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    largest = Window.partitionBy("x").orderBy(F.desc("size"), "key").rowsBetween(Window.unboundedPreceding, 0)
    return members.join(sizes, "key").join(spare, "x").withColumn("open", F.sum("times").over(largest) > F.col("spare")).select("key", "x", "of_x", "open")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _other_stars(members: DataFrame, salt: int) -> DataFrame:
    """Pairs (a, b) of each member with another representative of its block, where their components differ."""
    reps = members.groupBy("key").agg(F.min_by(F.struct("x", "of_x"), F.xxhash64("x", F.lit(salt))).alias("rep"))
    both = members.join(reps, "key").where("of_x != rep.of_x")
    return _ordered(both.select(F.col("x").alias("a"), F.col("rep.x").alias("b")))


def _near_in_list(n, of, is_open, first, bits, share: int):
    """Pairs (i, j) of a list's members, a few rows at a time, and their room: how far they are within the bounds on sizes and sketches.

    Only members of different components, of which one is open, are compared; with ``first`` only those that have it with those that haven't.
    """
    rows, cols = (np.arange(len(n)),) * 2 if first is None else (np.flatnonzero(first), np.flatnonzero(~first))
    if not len(rows) or not len(cols):
        return
    small = np.bitwise_xor.reduce(bits.reshape(len(n), -1, FOLDED), axis=1)
    step = max(1, PAIRS_HELD // len(cols))
    for at in range(0, len(rows), step):
        r = rows[at : at + step]
        may = (of[r][:, None] != of[cols]) & (100 * np.minimum(n[r][:, None], n[cols]) >= share * np.maximum(n[r][:, None], n[cols]))
        if not is_open.all():
            may &= is_open[r][:, None] | is_open[cols]
        if first is None:
            may &= r[:, None] < cols
        i, j = np.nonzero(may)
        i, j = r[i], cols[j]
        for marks, held in ((small, PAIRS_HELD), (bits, PAIRS_HELD * FOLDED // bits.shape[1])):
            room = np.empty(len(i), np.int64)
            for k in range(0, len(i), held):
                a, b = i[k : k + held], j[k : k + held]
                room[k : k + held] = (100 - share) * (n[a] + n[b]) - (100 + share) * np.bitwise_count(marks[a] ^ marks[b]).sum(axis=1, dtype=np.int64)
            i, j, room = i[room >= 0], j[room >= 0], room[room >= 0]
        if len(i):
            yield i, j, room


def _forest(i, j, room, of):
    """Of these pairs those, the roomiest first, that join components which the ones before them leave apart (Boruvka's rounds)."""
    order = np.lexsort((j, i, -room))
    i, j, room = i[order], j[order], room[order]
    known, ends = np.unique(np.concatenate([of[i], of[j]]), return_inverse=True)
    a, b = np.split(ends, 2)
    top, live, chosen = np.arange(len(known)), np.arange(len(i)), []
    while True:
        live = live[top[a[live]] != top[b[live]]]
        if not len(live):
            break
        x, y = top[a[live]], top[b[live]]
        best = np.full(len(known), len(live))
        for end in (x, y):
            seen, where = np.unique(end, return_index=True)
            best[seen] = np.minimum(best[seen], where)
        picked = np.unique(best[best < len(live)])
        chosen.append(live[picked])
        part = {}
        for u, v in zip(x[picked].tolist(), y[picked].tolist(), strict=True):
            while part.get(u, u) != u:
                u = part[u]
            while part.get(v, v) != v:
                v = part[v]
            part[max(u, v)] = min(u, v)
        up = np.arange(len(known))
        for u in sorted(part):  # each hangs on a smaller one, which is done
            up[u] = up[part[u]]
        top = up[top]
    kept = np.concatenate(chosen) if chosen else live
    return i[kept], j[kept], room[kept]


def _compare(share: int, whole: bool, batches):
    """Pairs (a, b) from rows sorted by list (and parts of it): those that sizes and sketches don't rule out; unless ``whole``, only a list's forest of them."""

    def pairs_of(rows, s, e, of, n, is_open, crossed, first, bits):
        near = _near_in_list(n[s:e], of[s:e], is_open[s:e], first[s:e] if crossed[s] else None, bits[s:e], share)
        if whole:
            return [(i + s, j + s) for i, j, _ in near]
        held: list[tuple] = []
        for found in near:
            held.append(found)
            if sum(len(f[0]) for f in held) > PAIRS_HELD:
                held = [_forest(*(np.concatenate(x) for x in zip(*held, strict=True)), of[s:e])]
        if not held:
            return []
        i, j, _ = _forest(*(np.concatenate(x) for x in zip(*held, strict=True)), of[s:e])
        return [(i + s, j + s)]

    def flush(rows, ends):
        column = {name: rows.column(name).combine_chunks() for name in rows.schema.names}
        of = column["of_x"].dictionary_encode().indices.to_numpy()
        n = column["n"].to_numpy()
        is_open, first = (column[c].to_numpy(zero_copy_only=False) for c in ("open", "first"))
        crossed = column["low"].to_numpy() != column["high"].to_numpy()
        bits = column["sketch"].flatten().to_numpy().view(np.uint64).reshape(len(n), -1)
        for s, e in zip([0, *ends[:-1]], ends, strict=True):
            if e - s > 1 and is_open[s:e].any() and (of[s:e] != of[s]).any():
                for i, j in pairs_of(rows, s, e, of, n, is_open, crossed, first, bits):
                    yield pa.RecordBatch.from_arrays([column["x"].take(pa.array(i)), column["x"].take(pa.array(j))], names=["a", "b"])

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= ROWS_HELD:
            rows = pa.Table.from_batches(held)
            ends = _list_ends(rows)
            if len(ends) > 1:  # the last list may go on
                yield from flush(rows.slice(0, ends[-2]), ends[:-1])
                rows = rows.slice(ends[-2])
            held, size = rows.to_batches(), rows.num_rows
    if size:
        rows = pa.Table.from_batches(held)
        yield from flush(rows, _list_ends(rows))


def _list_ends(rows: pa.Table) -> list[int]:
    named = [rows.column(c).combine_chunks().to_numpy() for c in ("key", "low", "high")]
    new = functools.reduce(np.logical_or, [x[1:] != x[:-1] for x in named])
    return [*(np.flatnonzero(new) + 1).tolist(), rows.num_rows]


def _across(members: DataFrame, tried: DataFrame, sketches: DataFrame, method: Method, whole: bool) -> DataFrame:
    """Pairs (a, b) of different components that share a list with one of them open, may link by size and mark, and weren't tried.

    Unless ``whole``, only pairs that join a list's components, one after another.  A list's members come to one task, which compares sketches
    and gives the pairs that are left; those of a list of more than ``PART`` are dealt into parts, and each pair of parts comes to a task.
    """
    parts = F.ceil(F.col("size") / PART).cast("int")
    lists = members.groupBy("key").agg(F.count("*").alias("size"), F.max("open").alias("any")).where("any").select("key", parts.alias("parts"))
    rows = members.join(lists, "key").join(sketches.select(F.col("id").alias("x"), "n", method.bits().alias("sketch")), "x")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("x"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), (F.col("part") < F.col("other")).alias("first"), "x", "of_x", "open", "n", "sketch")
    kind = members.schema["x"].dataType.simpleString()
    group = ["key", "low", "high"]
    pairs = rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(functools.partial(_compare, method.share, whole), f"a {kind}, b {kind}")
    return _within(_ordered(pairs).join(tried, ["a", "b"], "left_anti"), sketches, [], method).select("a", "b")


def _stars_of(plain: DataFrame, common, total: int, method: Method) -> DataFrame:
    """The rows of :func:`_stars`.  The number of buckets grows with the keys, that of rows from a chunk and that of partitions don't beyond a bound."""
    buckets = max(1, -(-total // BUCKET_KEYS))
    per = -(-buckets // FAN)
    groups = -(-buckets // per)
    sent = plain.where("id is not null").select("text").mapInArrow(_keys(common, buckets, per, method.keys_from), _DEALT)
    if per > 1:
        sent = sent.repartition(groups, "bucket").sortWithinPartitions("bucket").mapInArrow(_dealt_again(buckets, per), _DEALT)
    return sent.repartition(min(buckets, MOST_PARTS), "bucket").sortWithinPartitions("bucket").mapInArrow(_stars, "key bigint, rep bigint, cls bigint")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", method: Method = PARITY) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id (of the id's type)."""
    spark = small_batches(docs.sparkSession)
    done: list[str] = []
    try:
        with shuffles_removed(spark):
            out = _near_duplicates(docs, id_column, method, done)
    finally:
        discard(spark, done)  # the components are checkpointed; only the profile is read from here on
    return out.select("*")  # whose shuffles stay as long as the session says


def _near_duplicates(docs: DataFrame, id_column: str, method: Method, done: list[str]) -> DataFrame:
    spark = docs.sparkSession
    plain = docs.select(F.col(id_column).alias("id"), text_of(docs).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    profile = written(plain.mapInArrow(_profile(method.longs, method.mark, method.wide), f"id {kind}, n bigint, hi bigint, lo bigint, shingle bigint, count bigint, mark array<bigint>, wide array<bigint>"), "profile")
    mine = profile.where("n is not null").select("id", "n", "hi", "lo")
    hot = profile.where("shingle is not null").groupBy("shingle").agg(F.sum("count").alias("c")).orderBy(F.desc("c"), "shingle").limit(COMMON_MOST)
    common = spark.sparkContext.broadcast([r[0] for r in hot.select("shingle").collect()])
    # Classes of equal sets, each with its smallest document.  They are written, so that joins to them shuffle both sides
    # plainly: Spark then splits a partition that has a third of all documents for one class.
    roots = written(mine.where("n > 0 and id is not null").groupBy("hi", "lo").agg(F.min("id").alias("root"), F.max("n").alias("n")), "classes")

    size = roots.agg(F.count("*"), F.sum("n")).first()
    found = written(_stars_of(plain, common, method.keys_in_all(mine.agg(F.sum("n")).first()[0] or 0, size[0]), method), "stars", done)
    freed(spark)
    stars = found.where("key is not null")
    at = lambda c, to: roots.select(F.col("hi").alias(c), F.col("root").alias(to), F.col("n").alias(f"n_{to}"))
    pairs = stars.groupBy("rep", "cls").agg(F.count("*").alias("shared"))
    pairs = cut(pairs.join(at("rep", "a"), "rep").join(at("cls", "b"), "cls"))
    alike = F.col("a") != F.col("b")
    between = pairs.where(alike & method.sizes("n_a", "n_b")).groupBy("a", "b").agg(F.max("shared").alias("shared"))
    needed, few = _ids(between)
    sketches = written(profile.where("n > 0").join(F.broadcast(needed) if few else needed, "id", "left_semi").select("id", "n", "mark", "wide"), "sketches", done)
    # A document with several texts (a repeated id) has several classes.
    several = mine.where("n > 0 and id is not null").join(roots.drop("n"), ["hi", "lo"]).where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    several = several.join(roots.select(F.col("root").alias("a")).distinct(), "a", "left_semi")
    # First each document with the representative that it shares most lists with; then, where that
    # leaves two components apart, the other pairs.
    near = cut(_within(between, sketches, ["shared"], method))
    best = near.groupBy("b").agg(F.min_by("a", F.struct(-F.col("shared"), "a")).alias("a"))
    links = verified(best, plain, method.share)
    comps = components(links.union(several))
    rest = _apart(near.join(best, ["a", "b"], "left_anti").select("a", "b"), comps)
    comps = _joined(comps, verified(rest, plain, method.share))
    # Lists that still hold several components may hold links between members that aren't representatives, but a
    # document that can do without them has no link to lose.  Other representatives settle most of the rest; what then
    # stays open is compared member by member.
    spare = found.where("key is null").select(F.col("cls").alias("hi"), F.col("rep").alias("spare")).join(roots.select("hi", F.col("root").alias("x")), "hi")
    spare = spare.groupBy("x").agg(F.min("spare").alias("spare"))
    tried = cut(_ordered(pairs.where(alike).select("a", "b")))
    blocks = _blocks(stars.join(pairs, ["rep", "cls"]).select("key", "a", "b").where(alike))
    members = cut(_mixed(blocks, comps))
    members = cut(_around(members, _unsettled(members, spare)))
    freed(spark)
    for salt in range(1, 1 + method.rounds):
        if members.isEmpty():
            break
        new = cut(_other_stars(members, salt).join(tried, ["a", "b"], "left_anti"))
        tried = tried.union(new)
        comps = _joined(comps, verified(_within(new, sketches, [], method).select("a", "b"), plain, method.share))
        members = cut(_mixed(members.select("key", "times", "x"), comps))
        members = cut(_around(members, _unsettled(members, spare)))
    # First pairs that join the components of a list, one after another; then all that are left between components, as some of the first don't link.
    for whole in (False, True):
        if members.isEmpty():
            break
        opened = cut(_opened(members, spare))
        freed(spark)
        new = cut(_across(opened, tried, sketches, method, whole))
        comps = _joined(comps, verified(new, plain, method.share))
        if not whole:
            tried = tried.union(new)
            members = cut(_mixed(members.select("key", "times", "x"), comps))
            members = cut(_around(members, _unsettled(members, spare)))
    by_root = comps.withColumnRenamed("node", "root")
    classes = cut(roots.drop("n").join(by_root, "root", "left").select("hi", "lo", F.coalesce("component", "root").alias("component")))
    some = mine.where("n > 0").join(classes, ["hi", "lo"], "left").select("id", "n", "component")
    out = some.unionByName(mine.where("n = 0").select("id", "n", F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The documents with the smallest id of their group, with their own columns.

    Rows with a null id were compared with nothing and all stay.
    """
    kept = near_duplicates(docs, id_column).where(F.col("component_id") == F.col(id_column)).select(F.col(id_column).alias("_kept")).distinct()
    return docs.join(kept, docs[id_column] == kept["_kept"], "left_semi").unionByName(docs.where(docs[id_column].isNull()))
