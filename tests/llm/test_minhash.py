"""Signature joins and bounded dealing against plain comparisons of all sets."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from edgeprobe.llm import common, jaccard, minhash

VOCAB = [a + b for a in ("ka", "lo", "mi", "ter", "sun", "vel", "dra", "po") for b in ("n", "ra", "st", "lik", "mo", "e")]


def words(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def shingles(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").replace("\x0c", " ")
    w = [x for x in w.translate(str.maketrans("\t\n\r", "   ")).split(" ") if x]
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows, share):
    sets = [(i, shingles(t)) for i, t in rows]
    part = {i: i for i, _ in rows}

    def top(x):
        while part[x] != x:
            x = part[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and 100 * len(a & b) >= share * len(a | b):
                x, y = top(i), top(j)
                part[max(x, y)] = min(x, y)
    return sorted((i, len(a), top(i), top(i) == i) for i, a in sets)


def collection(rng):
    """Copies, near copies on both sides of the threshold, chains, passages that many texts share, odd texts."""
    rows = [None, "", " \n\t", "one", "One", "two words", "a b c d e", "A B C D E", "É " * 30, words(rng, 8000)]
    passages = [words(rng, 40) for _ in range(4)]
    for _ in range(60):
        rows.append("\n".join([*rng.sample(passages, rng.choice([1, 2, 3])), words(rng, rng.choice([3, 15, 60]))]))
    for _ in range(8):
        w = words(rng, rng.choice([30, 80, 200])).split()
        for _ in range(12):
            rows.append(" ".join(w))
            w = list(w)
            w[rng.randrange(len(w))] = rng.choice(VOCAB)
            if rng.random() < 0.4:
                w = w[1:] + [rng.choice(VOCAB)]
    base = words(rng, 120).split()
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(VOCAB)
        rows.append(" ".join(w))
    rows += [words(rng, 7) for _ in range(20)]
    return [(k, t) for k, t in enumerate(rows)]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("chunk,bucket", [(None, None), (300, 40)])
def test_components(spark, monkeypatch, chunk, bucket):
    """The same components with one chunk and bucket, and with many of both, dealt in two steps."""
    if chunk:
        for name, value in (("CHUNK", chunk), ("BUCKET_KEYS", bucket), ("FAN", 7), ("AGAIN", 500)):
            monkeypatch.setattr(jaccard, name, value)
    rows = collection(random.Random(6))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert rows_of(minhash.near_duplicates(docs)) == brute(rows, 85)
    if chunk:
        assert rows_of(jaccard.near_duplicates(docs)) == [r[:3] for r in brute(rows, 75)]


def test_linked_sets_collide_and_meet():
    """Sets of the least similarity have enough collisions, and meet in more posted lists than they may skip, whatever is common."""
    rng = np.random.default_rng(3)
    for n in (7, 30, 200, 1500, 9000):
        for _ in range(15):
            new = lambda k: rng.integers(0, 2**63, k).astype(np.uint64) * np.uint64(2)
            a = new(n)
            differ = int(n * 15 / 185)
            b = np.unique(np.concatenate([a[differ:], new(differ)]))
            a = np.unique(a)
            assert jaccard.linked(a, b, 85)
            assert (minhash.signature(a)[0] == minhash.signature(b)[0]).sum() >= minhash.MATCHES
            both = np.unique(np.concatenate([a, b]))
            common = rng.permutation(both[rng.random(len(both)) < rng.choice([0, 0.3, 1])])
            x, y = (minhash._posted_from(common)(s) for s in (a, b))
            assert len(np.intersect1d(x[0], y[0])) > minhash.SPARE == x[1]


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(5)
    found = []
    for _ in range(200):
        both = rng.integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2)
        found.append((minhash.signature(both[:800])[0] == minhash.signature(both[200:])[0]).mean())
    assert abs(np.mean(found) - 0.6) < 0.02 and abs(np.std(found) - (0.6 * 0.4 / 64) ** 0.5) < 0.01


def test_dealing_costs_what_the_chunk_has():
    """Neither the time nor the rows of a chunk grow with the number of buckets, and two steps give what one gives."""
    rng = np.random.default_rng(1)
    key, cls = np.unique(rng.integers(0, 2**63, 300_000).astype(np.uint64)), None
    cls = rng.integers(0, 2**62, len(key))
    inner = (key[::3], cls[::3], cls[1::3][: len(key[::3])])
    inner = tuple(x[: min(map(len, inner))] for x in inner)
    took, rows = [], []
    for buckets in (10, 100_000, 10_000_000):
        per = -(-buckets // jaccard.FAN)
        start = time.process_time()
        rows.append(len(list(jaccard._deal((key, cls), inner, buckets, per))))
        took.append(time.process_time() - start)
    assert max(rows) <= jaccard.FAN and max(took) < 1.5
    buckets, per = 50, 8
    again = [x for b in jaccard._deal((key, cls), inner, buckets, per) for x in jaccard._dealt_again(buckets, per)([b])]
    once = list(jaccard._deal((key, cls), inner, buckets, 1))

    def content(batches):
        out = set()
        for b in batches:
            head, rest = jaccard._unpacked([b.column(c)[0] for c in range(1, 7)])
            out |= {(b.column(0)[0].as_py(), *x) for x in zip(*(c.tolist() for c in head))} | {(b.column(0)[0].as_py(), *x) for x in zip(*(c.tolist() for c in rest))}
        return out

    assert content(again) == content(once)


def _dealt_keys(sets, buckets, per=1):
    """What a chunk of texts sends, with these keys for its texts; and the bytes of it."""
    texts = [" ".join(f"{k}x{i}" for i in range(6)) for k in range(len(sets))]
    keys = iter(sets)
    run = jaccard._keys(type("Sent", (), {"value": []}), buckets, per, lambda common: lambda s: (next(keys), 3))
    rows = list(run([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]))
    names = [jaccard.digest(jaccard.shingles(t))[0] for t in texts]
    return rows, names, sum(len(b.column(c)[0].as_buffer()) for b in rows for c in range(1, 8) if b.column(c)[0].is_valid)


@pytest.mark.parametrize("buckets,per,most", [(1, 1, 6.5), (50, 1, 8.5), (50, 8, 7)])
def test_bytes_of_dealt_keys(buckets, per, most):
    """A key is sent in six bytes besides its class, once for all of the class's keys in a row (ten before), and comes back with it."""
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 2**63, 200).astype(np.uint64)) for _ in range(300)]
    rows, names, sent = _dealt_keys(sets, buckets, per)
    found = []
    for b in rows:
        if not b.column(7)[0].is_valid:
            key, who = jaccard._unpacked([b.column(c)[0] for c in range(1, 7)])[0]
            assert (jaccard._bucket_of(key, buckets) // per == b.column(0)[0].as_py()).all()
            found += zip(key.tolist(), who.tolist(), strict=True)
    assert sorted(found) == sorted((k & (2**48 - 1), name) for name, s in zip(names, sets, strict=True) for k in s.tolist())
    assert sent < most * len(found)


def test_keys_that_fall_together():
    """Keys of two texts with the same low bits make one list; two such of one text leave it one list fewer to do without."""
    a, b = np.array([5, 5 + 2**48, 7], np.uint64), np.array([7 + 2**50, 9], np.uint64)
    rows, names, _ = _dealt_keys([a, b], 1)
    assert [(b.column(3)[0].as_buffer().to_pybytes(), np.frombuffer(b.column(7)[0].as_buffer(), np.int32).tolist()) for b in rows if b.column(7)[0].is_valid] == [(np.array(names).tobytes(), [2, 3])]
    stars = [(k, r, c) for x in jaccard._stars(rows) for k, r, c in zip(*(x.column(i).to_pylist() for i in range(3)), strict=True) if k is not None]
    assert [(k, {r, c}) for k, r, c in stars] == [(7, set(names))]


def test_shuffles_go_with_their_job(spark):
    """Shuffle files go as a frame has been checkpointed, and the session is then as it was."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    files = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before, was = files(), spark.conf.get(key, None)
    with common.shuffles_removed(spark):
        kept = [f(spark.range(1000).repartition(7, "id")) for f in (common.cut, lambda df: common.written(df, "dealt"))]
        for _ in range(50):
            if not (left := files() - before):
                break
            time.sleep(0.1)
    assert not left and [df.count() for df in kept] == [1000, 1000]
    assert spark.conf.get(key, None) == was
    found = jaccard.near_duplicates(spark.createDataFrame([(1, "a b c"), (2, "A b c")], "doc_id bigint, text string"))
    assert [rows_of(found) for _ in range(2)] == [[(1, 1, 1), (2, 1, 1)]] * 2 and spark.conf.get(key, None) == was


def _list_of(m, seed):
    """A list's rows: members within and beyond the bound of each other, each a component of its own."""
    rng = np.random.default_rng(seed)
    base = np.unique(rng.integers(0, 2**63, 100).astype(np.uint64))
    sets = []
    for _ in range(m):
        s = base.copy()
        s[rng.choice(len(s), rng.integers(0, 14), replace=False)] = rng.choice(2**62 + np.arange(300, dtype=np.uint64) * 7919, 1)
        sets.append(np.unique(s))
    bits = np.array([jaccard.sketch(s) for s in sets]).view(np.uint64)
    n = np.array([len(s) for s in sets])
    apart = np.bitwise_count(bits[:, None] ^ bits[None]).sum(axis=2, dtype=np.int64)
    near = (185 * apart <= 15 * (n[:, None] + n)) & (100 * np.minimum(n[:, None], n) >= 85 * np.maximum(n[:, None], n))
    return n, bits, {(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j}


def _batches(n, bits, parts, size):
    """The rows as a task gets them, whole or in pairs of parts, in batches."""
    m, rows = len(n), []
    for low in range(parts):
        for high in range(low, parts):
            rows += [(7, low, high, i % parts == low != high, i, i, True, n[i], bits[i].view(np.int64).tolist()) for i in range(m) if i % parts in (low, high)]
    names = ["key", "low", "high", "first", "x", "of_x", "open", "n", "sketch"]
    return [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[at : at + size], strict=True)], names=names) for at in range(0, len(rows), size)]


@pytest.mark.parametrize("parts,size,held", [(1, 1000, 200_000), (3, 17, 50)])
def test_lists_give_a_forest_then_the_rest(monkeypatch, parts, size, held):
    """A group of near copies gives at most a row for each member (and pair of parts) before its components are joined, and no pair is lost."""
    for name in ("ROWS_HELD", "PAIRS_HELD"):
        monkeypatch.setattr(jaccard, name, held)
    n, bits, near = _list_of(120, 4)
    got = lambda whole: [(min(p), max(p)) for b in jaccard._compare(85, whole, iter(_batches(n, bits, parts, size))) for p in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)]
    assert sorted(got(True)) == sorted(near) and len(near) > 3 * 120
    forest = got(False)
    assert set(forest) <= near and len(forest) < 120 * parts * (parts + 1) // 2

    def tops(pairs):
        part = list(range(120))
        for a, b in pairs:
            low, high = sorted((part[a], part[b]))
            part = [low if p == high else p for p in part]
        return part

    assert tops(forest) == tops(near)


def test_edges(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    docs = spark.createDataFrame([(None, "a b c d e f", 1), ("x", "a b c d e f", 2), ("b", "A B C d e f", 3), ("x", None, 4)], "doc_id string, text string, component_id int")
    got = sorted(((r.doc_id or "", r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()))
    assert got == [("", 2, None, True), ("b", 2, "b", True), ("x", 0, "x", True), ("x", 2, "b", False)]
