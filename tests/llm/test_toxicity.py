"""The toxicity classifier against a plain version: presence, log-count ratios, the least loss, the score."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from edgeprobe.llm import ngrams, toxicity


def plain_grams(text):
    t = f" {' '.join((text or '').lower().split())} "
    return {t[i : i + n] for n in range(3, 7) for i in range(len(t) - n + 1)}


def plain_scores(learnt, texts):
    """Dense presence of every n-gram that four texts have, scaled by its log-count ratio; Newton steps to the least loss."""
    sets, y = [plain_grams(t) for t, _ in learnt], np.array([v for _, v in learnt], float)
    counts = [Counter(g for s, v in zip(sets, y, strict=True) if v == label for g in s) for label in (0, 1)]
    space = 2**ngrams.SPACE_BITS
    log = lambda label, g: np.log((counts[label][g] + 1) / (sum(counts[label].values()) + space))
    names = [g for g in sorted(counts[0].keys() | counts[1].keys()) if counts[0][g] + counts[1][g] >= 4]
    scale = np.array([log(1, g) - log(0, g) for g in names])
    a = np.hstack([np.array([[g in s for g in names] for s in sets], float) * scale, np.ones((len(sets), 1))])
    penalty, w = np.diag([toxicity.PENALTY] * len(names) + [0.0]), np.zeros(len(names) + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w = w + np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
    z = [sum(w[k] * scale[k] for k, g in enumerate(names) if g in plain_grams(t)) + w[-1] for t in texts]
    return 1 / (1 + np.exp(-np.array(z)))


def test_scores_against_a_plain_version(spark):
    rng = random.Random(5)
    mild, rude = ["garden", "morning", "river", "table"], ["stupid", "idiot", "trash", "ugly"]
    rows = [(k, " ".join(rng.choice(rude if k % 3 == 0 and rng.random() < 0.6 else mild) for _ in range(7)), int(k % 3 == 0)) for k in range(90)]
    texts = [*((k, t) for k, t, _ in rows), (500, None), (501, "x"), (502, "A Garden\n of  IDIOT trash")]
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(spark.createDataFrame(texts, "doc_id bigint, text string"), labels).collect()}
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    want = plain_scores([(t, y) for k, t, y in rows if not held(k)], [t for _, t in texts])
    assert len(got) == len(texts)
    for (k, _), p in zip(texts, want, strict=True):
        assert got[k].score == pytest.approx(p, abs=3e-3)
        assert got[k].held_out == held(k) and got[k].predicted == int(got[k].score >= 0.5)
