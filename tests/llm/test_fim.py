"""Fill-in-middle against a plain version."""

import hashlib
import random
import re

import numpy as np
import pytest

from edgeprobe.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(doc_id, text):
    t = text or ""
    u = UNIT.findall(t)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(u)
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(u[:i]), "".join(u[i:j]), "".join(u[j:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, t
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(3)
    out = [None, "", " ", "\t\n  \r", "word", " lead and trail \n", "a\x0bb\x0cc", "é ü 漢字 😀 x", "has <M> in it", "no <p> here", "\x00 zero", " nb sp ", "x" * 5000, " ".join("w%d" % i for i in range(20_000))]
    out += ["".join(rng.choice("ab \n😀é") for _ in range(rng.randrange(60))) for _ in range(150)]
    return out + ["the same text again and again"] * 40


def test_lists_give_every_number_back():
    rng = np.random.default_rng(1)
    for n, most in ((0, 0), (1, 1), (1, 10**9), (5, 5), (300, 300), (1000, 10**7), (777, 5000)):
        x = np.sort(rng.choice(most, n, replace=False)) + 1 if n else np.empty(0, np.int64)
        got = fim.EliasFano.from_bytes(fim.EliasFano.of(x, most).to_bytes())
        assert [got[k] for k in range(n)] == x.tolist()
    big = np.cumsum(rng.integers(1, 12, 50_000))
    assert len(fim.EliasFano.of(big, int(big[-1])).to_bytes()) < 0.7 * len(big)  # 5 bits or so each


def test_unit_ends_are_those_of_the_expression():
    for t in texts():
        t = t or ""
        assert fim.unit_ends(t).tolist() == [m.end() for m in UNIT.finditer(t)]


@pytest.mark.parametrize("hot_rows", [5, 500])
def test_against_the_plain_version(spark, hot_rows):
    rows = [(i, t, f"f{i}", i) for i, t in enumerate(texts())]
    rows += [rows[4], rows[20], (None, "a text without an id but words", "n", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fim_form string, digest bigint")
    got = fim.fill_in_middle(docs, hot_rows=hot_rows)
    assert got.columns == ["doc_id", "own_fim_form", "digest", *fim.NEW]
    key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)
    want = sorted(((i, f, g, p[1], p[0], *p[2:]) for i, t, f, g in rows for p in [plain_version(i, t)]), key=key)
    assert sorted((tuple(r) for r in got.collect()), key=key) == want
    forms = {r[3] for r in want}
    assert forms == {"plain", "spm", "psm"}
    sums = {(r.doc_id, r.output_sha256, r.restored_sha256) for r in fim.digests(got).collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sums == {(i, sha(plain_version(i, t)[4]), sha(t)) for i, t, _, _ in rows}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert fim.digests(fim.fill_in_middle(docs)).collect() == []
