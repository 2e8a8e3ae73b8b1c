"""How often operator 3 goes through its texts, and what that rests on, against plain versions."""

import random

import numpy as np

from edgeprobe.llm import hashing, suffix_tree


def test_texts_are_gone_through_three_times(spark, monkeypatch):
    """Once for triples and contexts of one word, once for those of two, once for the scores; suffixes of states need no chunk."""
    passes, plain = [], suffix_tree.by_chunk

    def counted(*args):
        passes.append(args)
        return plain(*args)

    monkeypatch.setattr(suffix_tree, "by_chunk", counted)
    docs = spark.createDataFrame([(k, "a b c d " * 3) for k in range(12)], "doc_id bigint, text string")
    assert suffix_tree.score_texts(docs).count() == 12
    assert len(passes) == 3


def test_sorted_is_a_stable_argsort():
    rng = np.random.default_rng(5)
    for x in (np.empty(0, np.uint64), np.array([7], np.uint64), rng.integers(0, 2**64, 5000, np.uint64, endpoint=False), np.array([2**64 - 1, 0, 2**64 - 1, 1, 0], np.uint64)):
        # Repeated; of one range of the hash; the same in all bits that are sorted with the place; all equal.
        for y in (np.tile(x, 3), x >> np.uint64(40), np.append(x & np.uint64(3), np.uint64(2**63)), x | np.uint64(2**64 - 1)):
            got, order = suffix_tree._sorted(y)
            assert (order == np.argsort(y, kind="stable")).all() and (got == np.sort(y)).all()


def test_last_words_of_states_are_told_to_every_chunk_that_is_unsure():
    """Of two contexts one diverges; its last word is a suffix for all chunks that ask, whether they have the context or not."""
    top = np.uint64(1) << np.uint64(60)
    keys, last, other = np.array([3, 9], np.uint64) * top, np.array([5, 11], np.uint64) * top, np.uint64(7) * top
    nothing, ask = np.zeros(2), suffix_tree._asked
    strong = [np.array([1, 1]), np.array([100, 2]), np.array([100, 100]), np.array([400.0, 0.0]), np.array([0.01, 0.02])]
    silent = [nothing, nothing, np.array([100, 100]), nothing, nothing]
    parts, every = 4, np.array([True, True])
    asked = [r for chunk, sums in ((0, strong), (1, silent)) for r in ask(chunk, suffix_tree.TWO, parts, keys, sums, last, every)]
    words = {0: last, 1: np.sort(np.append(last, other)), 2: last[:1]}
    asked += [r for chunk, x in words.items() for r in ask(chunk, suffix_tree.UNSURE, parts, x, [np.empty(0, np.uint8)])]
    groups = {}
    for r in asked:
        groups.setdefault(r[:2], []).append(r)
    told = [x for g in groups.values() for x in suffix_tree._answers(suffix_tree._rows(g), 2.0, parts).to_pylist()]
    unsure, found = {}, {}
    for x in told:
        if x["kind"] == suffix_tree.UNSURE:
            unsure.setdefault(x["part"], []).append(x)
    for part, rows in unsure.items():
        table = suffix_tree._told(*([x[c] for x in rows] for c in ("chunk", "kind", "part", "told")))
        for x in suffix_tree._suffixes(table).to_pylist():
            assert x["chunk"] >= 0 and x["kind"] == suffix_tree.SUFFIX
            found.setdefault(x["chunk"], []).append((part, suffix_tree.from_planes(x["told"], np.uint8).tolist()))
    assert {k: [y for _, x in sorted(v) for y in x] for k, v in found.items()} == {0: [1, 0], 1: [1, 0, 0], 2: [1]}


def test_hashes_of_texts():
    """Texts hashed together, whole or by themselves: the hashes of each, then the end."""
    rng = random.Random(6)
    texts = [b"", b" \n", b"x" * 100, b"w " * 40_000, b"z" * 300_000, b"a" + b" " * 200 + b"b", b"\xff\x00\x1f c"]
    texts += [bytes(rng.choice(b"ab \n\t\x0b\x0c\r\xc3") for _ in range(rng.randrange(400))) for _ in range(500)]
    rng.shuffle(texts)
    for some in ([], texts[:1], texts):
        got = list(hashing.hashes_of_texts(iter(some), hashing.GOLD))
        assert [x.tolist() for x in got] == [[*hashing.word_hashes(t).tolist(), hashing.GOLD] for t in some]
