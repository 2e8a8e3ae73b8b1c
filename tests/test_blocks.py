"""Histories in blocks: tables of machines, means and the as-of join against plain loops over whole histories."""

import datetime as dt
import math
import random

import pytest

from edgeprobe.operators import features, scans
from edgeprobe.operators.asof import asof_strict

START = dt.datetime(2001, 3, 5)
NAN = float("nan")


def plain_hysteresis(x, a, b, c, d, short, least):
    pos, held, out = 0.0, 0, []
    for p in x:
        want = pos
        if p == p:
            if pos <= 0 and p >= a:
                want = 1.0
            elif pos >= 0 and short and p <= c:
                want = -1.0
            elif (pos > 0 and p < b) or (pos < 0 and p > d):
                want = 0.0
        pos, held = (want, 0) if want != pos and held >= least else (pos, held + 1)
        out.append(pos)
    return out


def plain_fade(x, entry, exit):
    pos, out = 0.0, []
    for z in x:
        if z == z:
            if pos == 0:
                pos = 1.0 if z <= -entry else -1.0 if z >= entry else 0.0
            elif (pos > 0 and z >= -exit) or (pos < 0 and z <= exit):
                pos = 0.0
        out.append(pos)
    return out


def plain_min_hold(x, bars):
    pos, held, want, out = 0.0, bars, 0.0, []
    for v in x:
        want = v if v == v else want
        pos, held = (want, 0) if want != pos and held >= bars else (pos, held + 1)
        out.append(pos)
    return out


def plain_band(x, width):
    pos, out = 0.0, []
    for v in x:
        pos = v if v == v and abs(v - pos) > width else pos
        out.append(pos)
    return out


def in_blocks(machine, x, rng):
    """The positions when a history is cut anywhere: each block's table leads to the next one's start."""
    cuts = sorted(rng.sample(range(1, len(x)), min(len(x) - 1, rng.randrange(1, 9))))
    state, out = machine.start, []
    for lo, hi in zip([0, *cuts], [*cuts, len(x)], strict=True):
        held, end = machine.advance(x[lo:hi], state)
        out += list(held)
        state = machine.after(machine.table(x[lo:hi]), state)
        assert state == end
    return out


def test_machines_in_blocks():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(2, 90)
        gap = rng.choice([0, 0.2, 0.9])
        p = [NAN if rng.random() < gap else rng.choice([0.3, 0.44, 0.45, 0.5, 0.55, 0.56, 0.8, rng.random()]) for _ in range(n)]
        args = (0.56, 0.5, 0.44, 0.5, rng.random() < 0.7, rng.randrange(8))
        assert in_blocks(scans.Hysteresis(*args), p, rng) == plain_hysteresis(p, *args)
        z = [NAN if rng.random() < gap else rng.gauss(0, 2) for _ in range(n)]
        assert in_blocks(scans.Fade(2, 0.5), z, rng) == plain_fade(z, 2, 0.5)
        w = [NAN if rng.random() < gap else rng.choice([-1.0, 0.0, 1.0, 0.25]) for _ in range(n)]
        bars = rng.randrange(9)
        assert in_blocks(scans.MinHold(bars), w, rng) == plain_min_hold(w, bars)
        t = [NAN if rng.random() < gap else rng.gauss(0, 1) for _ in range(n)]
        width = rng.choice([0.1, 0.5, 1.5])
        assert in_blocks(scans.Band(width), t, rng) == plain_band(t, width)


def frame(spark, histories, columns):
    rows = [(s, START + dt.timedelta(hours=k), *x) for s, h in histories.items() for k, x in h]
    return spark.createDataFrame(rows, f"symbol string, ts timestamp_ntz, {columns}").repartition(5)


def test_scans_over_several_blocks(spark):
    """Blocks of a day, with whole days missing; two machines in one pass."""
    rng = random.Random(4)
    histories = {s: [(k, (None if rng.random() < 0.1 else rng.random(),)) for k in range(300) if not 80 <= k < 160 or s != "b"] for s in "abc"}
    machines = {"one": scans.Hysteresis(0.56, 0.5, 0.44, 0.5, True, 6), "two": scans.Hysteresis(0.7, 0.5, 0.3, 0.5, False, 30), "band": scans.Band(0.3), "kept": scans.MinHold(40)}
    got = scans.scan(frame(spark, histories, "x double"), "x", machines, days=1).orderBy("symbol", "ts").collect()
    for s, h in histories.items():
        x = [NAN if v is None else v for _, (v,) in h]
        mine = [r for r in got if r.symbol == s]
        assert [r.one for r in mine] == plain_hysteresis(x, 0.56, 0.5, 0.44, 0.5, True, 6)
        assert [r.two for r in mine] == plain_hysteresis(x, 0.7, 0.5, 0.3, 0.5, False, 30)
        assert [r.band for r in mine] == plain_band(x, 0.3)
        assert [r.kept for r in mine] == plain_min_hold(x, 40)


def test_asof_carries_over_blocks(spark):
    """The auxiliary row may be many blocks back; its missing values stay missing; before the first there is none."""
    rng = random.Random(2)
    bars = {s: [(k, (float(k),)) for k in range(400)] for s in "ab"}
    rates = {"a": [(20, (1.0, None)), (25, (None, "x")), (330, (3.0, "y")), (330, (2.0, "z"))], "b": [(k, (float(k), None)) for k in sorted(rng.sample(range(400), 30))]}
    got = asof_strict(frame(spark, bars, "close double"), frame(spark, rates, "rate double, note string"), ["rate", "note"], 3600, days=1).collect()
    assert len(got) == 800
    for r in got:
        k = int(r.close)
        earlier = [x for at, x in rates[r.symbol] if at < k + 1]
        latest = [at for at, _ in rates[r.symbol] if at < k + 1]
        want = max(x for at, x in rates[r.symbol] if at == latest[-1]) if earlier and latest[-1] == 330 else earlier[-1] if earlier else (None, None)
        assert (r.rate, r.note) == want, k


@pytest.mark.parametrize("a", [0.002, 1 / 14, 0.6])
def test_means_over_several_blocks(spark, a):
    rng = random.Random(3)
    histories = {s: [(k, (None if k < lead else 100 * math.exp(rng.gauss(0, 1)),)) for k in range(1500)] for s, lead in (("a", 0), ("b", 30), ("c", 2000))}
    df = frame(spark, histories, "x double").withColumn("_block", scans.block_of("ts", 1))
    got = {(r.symbol, r.ts): r.m for r in scans.means(df, {"m": ("x", a)}).collect()}
    for s, h in histories.items():
        y = None
        for k, (x,) in h:
            y = y if x is None else x if y is None else (1 - a) * y + a * x
            m = got[s, START + dt.timedelta(hours=k)]
            assert m == pytest.approx(y, rel=1e-11) if y is not None else m is None


def test_smoothed_against_pandas(spark):
    import pandas as pd

    rng = random.Random(9)
    close = [100.0]
    for _ in range(2999):
        close.append(close[-1] * math.exp(rng.gauss(0, 0.01)))
    h = [(k, (c * (1 + rng.random() / 100), c * (1 - rng.random() / 100), c)) for k, c in enumerate(close)]
    got = features.smoothed(frame(spark, {"a": h}, "high double, low double, close double")).orderBy("ts").toPandas()
    b = pd.DataFrame([x for _, x in h], columns=["high", "low", "close"])
    mean = lambda x, w: x.ewm(alpha=w, adjust=False).mean()
    change = b.close.diff()
    u, d = mean(change.clip(lower=0), 1 / 14), mean((-change).clip(lower=0), 1 / 14)
    reach = pd.concat([b.high - b.low, (b.high - b.close.shift()).abs(), (b.low - b.close.shift()).abs()], axis=1).max(axis=1)
    trend = mean(b.close, 2 / 13) - mean(b.close, 2 / 27)
    want = pd.DataFrame({"rsi_14": 100 * u / (u + d), "atr_pct": mean(reach, 1 / 14) / b.close, "macd_n": (trend - mean(trend, 2 / 10)) / b.close})
    pd.testing.assert_frame_equal(got[list(want)], want, rtol=1e-9, atol=1e-12)
