"""Hand-computed cases of the operators, invariants, and bugs that the detectors must find."""

import datetime as dt
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeprobe import costs, report, stats
from edgeprobe.errors import ConfigError, InsufficientDataError
from edgeprobe.operators import audit, execution, features, labels, ledger, models, panel, robustness, scans, validation
from edgeprobe.operators.asof import asof_strict
from edgeprobe.plans import catalog
from edgeprobe.sources import archives, synthetic
from edgeprobe.sources import bars as src

BAR = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, trades double"
T0 = dt.datetime(2020, 1, 1)


def bars(spark, opens, symbol="A", hours=1):
    rows = [(symbol, T0 + dt.timedelta(hours=hours * i), float(o), o * 1.01, o * 0.99, float(o), 1.0, 1.0) for i, o in enumerate(opens)]
    return spark.createDataFrame(rows, BAR)


def column(df, c, order="ts"):
    return [r[c] for r in df.orderBy(order).collect()]


def held(spark, opens, pos):
    b = labels.positions(bars(spark, opens))
    p = spark.createDataFrame(list(enumerate(map(float, pos))), "k bigint, w double")
    return b.join(p, b.pos == p.k).drop("pos").withColumnRenamed("w", "pos")


def test_fill_at_the_next_open(spark):
    got = column(execution.backtest(held(spark, [100, 100, 110, 110, 110], [1, 0, 0, 0, 0]), 0.0), "gross")
    assert got == pytest.approx([math.log(1.1), 0, 0, 0, 0])
    assert column(execution.backtest(held(spark, [100, 100, 200, 200, 200], [0, 1, 0, 0, 0]), 0.0), "equity")[-1] == pytest.approx(1.0)


def test_costs(spark):
    r = execution.backtest(held(spark, [100] * 6, [1, 1, -1, -1, 0, 0]))
    assert sum(column(r, "turnover")) == 4.0 and sum(column(r, "cost")) == pytest.approx(4 * 0.0012)


def test_closing_trade_is_charged(spark):
    r = execution.backtest(held(spark, [100] * 12, [0, 0, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0])).withColumn("inside", F.col("k").between(2, 7))
    (s,) = execution.summarize(execution.restrict(r, "inside"), 8760, ["symbol"]).collect()
    assert s["n_trades"] == 2 and s["cost_drag"] == pytest.approx(1 - math.exp(-2 * 0.0012)) and s["bars"] == 6


def test_scans(spark):
    p = bars(spark, [100] * 8).withColumn("k", F.hour("ts")).withColumn("p", F.when(F.col("k") % 2 == 0, 0.57).otherwise(0.55))
    assert column(scans.hysteresis(p, "p", min_hold=0), "pos") == [1.0] * 8
    assert column(scans.hysteresis(p, "p", min_hold=3), "pos")[:6] == [0, 0, 0, 0, 1, 1]
    want = p.withColumn("w", F.when(F.col("k") < 2, 1.0).when(F.col("k") == 4, -1.0))
    assert column(scans.min_hold(want, "w", bars=3), "pos") == [1, 1, 1, 1, -1, -1, -1, -1]
    target = p.withColumn("w", F.lit(0.06) * F.col("k"))
    assert column(scans.band(target, "w", width=0.1), "pos") == pytest.approx([0, 0, 0.12, 0.12, 0.24, 0.24, 0.36, 0.36])


def test_asof_is_strict(spark):
    b = bars(spark, [100] * 6, hours=4)
    f = spark.createDataFrame([("A", T0 + dt.timedelta(hours=8 * i), float(i)) for i in range(4)], "symbol string, ts timestamp_ntz, rate double")
    assert column(asof_strict(b, f, ["rate"], 4 * 3600), "rate")[:4] == [0, 0, 1, 1]
    late = f.withColumn("rate", F.when(F.col("rate") != 1, F.col("rate")))
    assert column(asof_strict(b, late, ["rate"], 4 * 3600), "rate")[:4] == [0, 0, None, None]


def test_rsi_of_a_rise_is_100(spark):
    got = column(features.smoothed(bars(spark, range(100, 200))), "rsi_14")
    assert got[0] is None and got[-1] == 100 and len([x for x in got if x is not None]) == 99


def test_triple_barrier_tail_is_unknown(spark):
    b = labels.triple_barrier(synthetic.random_walk(spark, 300), horizon=24, window=20)
    y = column(b, "y")
    assert y[-24:] == [None] * 24 and all(v in (0.0, 1.0) for v in y[30:-24])


def test_features_do_not_look_ahead(spark):
    b = synthetic.random_walk(spark, 260)
    build = lambda x: features.channel(features.stretch(features.momentum(features.log_returns(x))))
    assert {r["differs"] for r in audit.point_in_time(b, build, ["ret_6", "z_24", "donch_24"], [100, 200]).collect()} == {0}
    leaky = lambda x: build(x).withColumn("z_24", F.lead("close", 1).over(execution.bars_window()))
    assert {r["feature"]: r["differs"] for r in audit.point_in_time(b, leaky, ["ret_6", "z_24"], [100, 200]).collect()} == {"ret_6": 0, "z_24": 2}
    audit.lint_lookahead(build(b))
    with pytest.raises(audit.LookaheadError):
        audit.lint_lookahead(leaky(b))


def test_folds():
    s = validation.Split(n_folds=3, min_train=300, embargo=5)
    got = validation.fold_bounds(900, s)
    assert [(a[3], a[4]) for a in got] == [(300, 500), (500, 700), (700, 900)] and all(a[2] == a[3] - 5 for a in got)
    with pytest.raises(ConfigError):
        validation.fold_bounds(900, validation.Split(scheme="other", min_train=10))
    with pytest.raises(InsufficientDataError):
        validation.fold_bounds(200, s)


def test_uniqueness_matches_a_loop(spark):
    b = labels.positions(bars(spark, [100] * 40)).withColumn("t_end", F.least(F.col("pos") + F.col("pos") % 5, F.lit(39)))
    got = [r["weight"] for r in validation.uniqueness(b).orderBy("pos").collect()]
    end = [min(i + i % 5, 39) for i in range(40)]
    conc = [sum(i <= t <= e for i, e in enumerate(end)) for t in range(40)]
    assert got == pytest.approx([np.mean([1 / conc[t] for t in range(i, e + 1)]) for i, e in enumerate(end)])


def test_rank_and_neutralise(spark):
    p = spark.createDataFrame([(T0, "A", 1.0), (T0, "B", 3.0), (T0, "C", 2.0), (T0, "J", None)], "ts timestamp_ntz, symbol string, x double")
    got = {r["symbol"]: r["rank"] for r in panel.rank_pct(p, ["x"]).collect()}
    assert got["A"] == pytest.approx(1 / 3) and got["B"] == 1.0 and got["J"] is None
    w = spark.createDataFrame([(0, "A", 0.5), (0, "B", 0.2), (0, "C", -0.2), (1, "A", 0.3), (1, "B", 0.0)], "time_pos bigint, symbol string, w double")
    out = {(r["time_pos"], r["symbol"]): r["w"] for r in panel.neutralise(w).collect()}
    assert out[0, "A"] == pytest.approx(5 / 7) and out[0, "C"] == -1 and out[1, "A"] == 0


def test_concentration(spark):
    rows = [(t, s, w) for t in range(10) for s, w in (("L1", 0.5), ("L2", 0.5), ("S1", -0.5 if t < 6 else -1.0), ("S2", -0.5 if t < 6 else 0.0))]
    (r,) = audit.concentration(spark.createDataFrame(rows, "time_pos bigint, symbol string, w double"), 0.5).collect()
    assert (r["max_short"], r["bars"], r["share"], r["longest"]) == (1.0, 4, 0.4, 4)


def test_tail(spark):
    rows = [(t, s, -1.0 if s == "BBB" else 1.0, math.log(2) if (t, s) == (10, "AAA") else 0.0) for t in range(1000) for s in ("AAA", "BBB")]
    (r,) = audit.tail_census(spark.createDataFrame(rows, "time_pos bigint, symbol string, w double, ret_next double"), 0.65).collect()
    assert (r["extreme"], r["hits"], r["expected"]) == (1, 0, 0.5)


def test_sign_flips(spark):
    make = lambda f: spark.createDataFrame([("A", i, j, f(i, j)) for i in range(3) for j in range(3)], "symbol string, a int, b int, v double")
    rate = lambda df: robustness.sign_flips(df, "a", "b", "v", ["symbol"]).first()["rate"]
    assert rate(make(lambda i, j: 1.0)) == 0.0 and rate(make(lambda i, j: 1.0 if (i + j) % 2 else -1.0)) == 1.0


def test_verdict():
    good = robustness.grid_gate([0.4, 0.5, 0.6, 0.5], 4, 0.0)
    assert robustness.verdict([good, robustness.count_gate("years", [0.2, 0.5, -0.1]), robustness.count_gate("symbols", [0.1, 0.2])]) == "SURVIVED"
    assert robustness.verdict([good, robustness.count_gate("years", [0.21, 0.56, -0.5, -0.21, -0.27])]) == "INCONCLUSIVE"
    assert robustness.verdict([robustness.grid_gate([-1, -0.5], 1, 0.0)]) == "KILLED"


def test_statistics():
    assert stats.t_p(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert stats.t_p(0.5, 3) == pytest.approx(0.6514480, abs=1e-6)
    assert stats.binomial_cdf(2, 5, 0.5) == 0.5
    assert stats.deflated_sharpe(1.0, 1000, 365, 1) == 1.0 > stats.deflated_sharpe(1.0, 1000, 365, 50)


def test_ledger(spark, tmp_path):
    for k in range(5):
        ledger.record(str(tmp_path), "run", {"a": {"b": 1}, "name": f"n{k}"}, {"sharpe": k}, variants=7)
    (tmp_path / "broken.json").write_text("{")
    runs = ledger.load(spark, str(tmp_path))
    assert runs.count() == 5 and ledger.count_trials(runs).first()["trials"] == 7


def test_no_edge_in_a_random_walk(spark):
    b = synthetic.random_walk(spark, 3000, 3)
    assert all(r["bad_high"] == r["bad_low"] == r["not_positive"] == 0 for r in src.integrity(b).collect())
    rows = execution.summarize(execution.backtest(execution.sma_cross(b, 20, 80), 0.0), 8760, ["symbol"]).collect()
    assert all(abs(r["t_stat"]) < 3.5 for r in rows)


def test_growth_after_a_near_total_loss(spark):
    """The yearly growth keeps its digits where 1 + total_return has few left."""
    r = execution.backtest(execution.buy_hold(bars(spark, [1.0] * 2000)), 0.0).withColumn("net", F.lit(-0.0133)).withColumn("equity", F.lit(1.0))
    (s,) = execution.summarize(r, 365, ["symbol"]).collect()
    assert s.cagr + 1 == pytest.approx(math.exp(-0.0133 * 365), rel=1e-9)


def test_models_take_every_symbol(spark):
    """Each symbol's folds and drops are those of a run over its bars alone, whatever their number."""
    walk = lambda seed, n: (100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.01, n)))).tolist()
    a, b = bars(spark, walk(1, 500), "A"), bars(spark, walk(2, 420), "B")
    rows = lambda x: models.with_label(features.build(x, with_smoothed=False), labels.next_bar_sign)
    names, split = ["ret_1", "z_24"], validation.Split(n_folds=2, min_train=250, embargo=1, least=20)
    for run in (models.walk_forward_scores, models.importance):
        got = sorted(tuple(r) for r in run(rows(a.unionByName(b)), names, split, each=True).collect())
        assert got == sorted((s, *r) for s, x in (("A", a), ("B", b)) for r in run(rows(x), names, split).collect())


@pytest.mark.parametrize("name", ["ml_direction", "permutation_importance"])
def test_model_queries_take_every_symbol(spark, name):
    got = {r["symbol"] for r in catalog.QUERIES[name](spark, "/root/testdata/sf0.01").select("symbol").distinct().collect()}
    assert got == {r[0] for r in spark.read.parquet("/root/testdata/sf0.01/events.parquet").select("event_type").distinct().collect()}


def test_probes_are_spread_over_each_symbol(spark):
    """A leak in the last quarter of a long symbol and one in a short symbol are both found."""
    b = bars(spark, range(100, 500), "long").unionByName(bars(spark, range(100, 140), "short"))
    ahead = lambda x: F.when(x, F.lead("close", 1).over(execution.bars_window())).otherwise(F.lit(0.0))
    build = lambda x: x.withColumn("late", ahead((F.col("close") > 400) & F.col("symbol").startswith("long"))).withColumn("other", ahead(F.col("symbol").startswith("short")))
    # Bars 30, 61, ..., 369 of 400 and 3, 6, ..., 36 of 40; closes over 400 start at bar 301.
    want = {"late": sum(400 * (k + 1) // 13 > 300 for k in range(12)), "other": 12}
    assert {r["feature"]: r["differs"] for r in audit.point_in_time(b, build, None, 12).collect()} == want


def test_audit_query_takes_every_feature(spark):
    got = {r["feature"]: r["differs"] for r in catalog.QUERIES["point_in_time_audit"](spark, "/root/testdata/sf0.001").collect()}
    b = bars(spark, range(100, 130))
    assert set(got) == set(features.build(b).columns) - set(b.columns) and set(got.values()) == {0}


def test_folds_of_unequal_histories_do_not_look_ahead(spark):
    """A symbol that begins later must not train on times that another one is tested on."""
    long, late = bars(spark, range(100, 400), "A"), bars(spark, range(100, 250), "B").withColumn("ts", F.col("ts") + F.expr("interval 150 hours"))
    rows = labels.next_bar_sign(long.unionByName(late)).withColumn("x", F.rand(1))
    split = validation.Split(n_folds=3, min_train=150, least=20)
    a = models._assigned(rows, ["x"], split)
    for r in a.groupBy("fold").agg(F.max(F.when(F.col("part") == "train", F.col("time_end"))).alias("known"), F.min(F.when(F.col("part") == "test", F.col("time_pos"))).alias("first")).collect():
        assert r["known"] < r["first"]
    assert a.where("part = 'test'").groupBy("symbol", "ts").count().where("count > 1").count() == 0
    assert {r["fold"]: r["count"] for r in a.where("part = 'test' and symbol = 'B'").groupBy("fold").count().collect()} == {1: 50, 2: 50, 3: 50}


def test_complete_rows(spark):
    df = spark.createDataFrame([(1.0, 1.0, None), (None, 1.0, 1.0), (1.0, None, 1.0)], "x double, sigma double, y double")
    assert validation.complete(df, ["x", "sigma"], 1).collect()[0]["y"] is None
    with pytest.raises(InsufficientDataError):
        validation.complete(df, ["x", "sigma"])


def test_autoregression(spark):
    b = synthetic.random_walk(spark, 4000, 1, seed=3, edge=0.5)
    r = np.diff(np.log(column(b, "close")))
    lagged = lambda k: np.corrcoef(r[k:], r[:-k])[0, 1]
    assert lagged(1) == pytest.approx(0.5, abs=0.06) and lagged(2) == pytest.approx(0.25, abs=0.06)
    e = np.diff(np.log(column(synthetic.random_walk(spark, 4000, 1, seed=3), "close")))
    assert np.allclose(r[1:], 0.5 * r[:-1] + e[1:], atol=1e-9)


def test_auc_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(str(k % 3), float(np.round(rng.normal(), 1)), float(rng.random() < 0.4)) for k in range(400)] + [("3", 1.0, 1.0), ("4", None, 1.0), ("5", 2.0, 1.0), ("5", 2.0, 0.0)]
    got = {r["g"]: r["auc"] for r in audit.auc(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", ["g"]).collect()}
    for g in "012":
        up, down = ([x for k, x, y in rows if k == g and y == side] for side in (1, 0))
        assert got[g] == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in up for b in down]))
    assert got["3"] is None and "4" not in got and got["5"] == 0.5


def test_archives(spark, tmp_path):
    """Headers or none, zip or not, milliseconds and microseconds, repeated times, a broken file, the symbol from the name."""
    line = "1600000000000,1,3,0.5,2,10,0,0,7,0,0,0"
    (tmp_path / "AAA-1h-2020-09.csv").write_text(line + "\n" + line.replace(",1,3", ",9,9") + "\n")
    with zipfile.ZipFile(tmp_path / "BBB-1h-2025-01.zip", "w") as z:
        z.writestr("x.csv", ",".join(archives.KLINES) + "\n" + line.replace("1600000000000", "1600000000000000") + "\n")
    (tmp_path / "CCC-1h-2025-01.zip").write_bytes(b"PK broken")
    got = {r["symbol"]: r for r in archives.klines(spark, str(tmp_path)).collect()}
    assert set(got) == {"AAA", "BBB"} and got["AAA"]["open"] == 1.0 and got["AAA"]["ts"] == got["BBB"]["ts"] and got["BBB"]["trades"] == 7.0
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "AAA-fundingRate-2020-09.csv").write_text("calc_time,funding_interval_hours,last_funding_rate\n1600000000000,8,0.0001\n")
    (f,) = archives.funding(spark, str(tmp_path / "f")).collect()
    assert (f["funding_rate"], f["funding_hours"]) == (0.0001, 8.0) and f["ts"] == got["AAA"]["ts"]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "AAA-metrics-2020-09-13.csv").write_text("create_time,symbol,sum_open_interest\n2020-09-13 12:00:00,AAA,5\n2020-09-13 12:05:00,AAA,\n")
    m = archives.metrics(spark, str(tmp_path / "m")).orderBy("ts").collect()
    assert [r["open_interest"] for r in m] == [5.0, None] and m[0]["taker_buy_sell_ratio"] is None


def test_costs_of_holding(spark):
    assert costs.round_trip(10, 2) == pytest.approx(0.0024) and costs.duration(math.inf) == "never"
    hold = costs.breakeven_hold(0.01, 0.55, 0.0024)
    assert costs.required_accuracy(0.01, hold, 0.0024) == pytest.approx(0.55) and costs.breakeven_hold(0.01, 0.5, 0.0024) == math.inf
    assert costs.duration(47) == "47.0 hours" and costs.duration(240) == "10.0 days" and costs.duration(3040) == "4.2 months"
    assert len(costs.warnings(24, 6, 0.001, 0.0024)) == 1 and "can't" in costs.warnings(24, 6, 0.0001, 0.0024)[0] and costs.warnings(24, 24, 0.05, 0.0024) == []
    b = synthetic.random_walk(spark, 600, 1, sigma=0.004).withColumn("symbol", F.lit("A"))
    (r,) = costs.measured_breakeven(b, 0.6, 0.0024, most=300).collect()
    moves = {x["hold"]: x["move"] for x in execution.mean_move(b, [r["hold"] - 1, r["hold"]]).collect()}
    assert 0.2 * moves[r["hold"]] >= 0.0024 > 0.2 * moves[r["hold"] - 1]
    assert costs.measured_breakeven(b, 0.5, 0.0024).collect()[0]["hold"] is None


def test_predictions_are_remembered(spark):
    made = []

    def compute():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert models.remembered(spark, {"a": str(T0), "n": 1}, compute).count() == 3
    assert len(made) == 1 or made == []


def test_crossover(spark):
    df = spark.createDataFrame([(2.0, 1.0), (1.0, 1.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in df.select(execution.crossover_state("a", "b")).collect()] == [1.0, -1.0, -1.0]


def test_reports():
    text = report.table([{"name": "a", "n": 10, "x": 0.123456}, {"name": "bb", "n": 2, "x": None}])
    assert text.splitlines()[0].split() == ["name", "n", "x"] and "0.1235" in text and text.splitlines()[3].endswith("-")
    assert report.table([]) == "(nothing)"


def test_noise_and_power():
    """A grid of 31 pairs: signs as at random, smooth, nearly as at random, too few to tell."""
    assert [robustness.noise(good, 31, rate) for good, rate in ((0.5, 0.5), (0.5, 0.0), (0.75, 0.39), (0.97, 0.06))] == [True, False, True, False]
    assert robustness.noise(0.5, 0, 0.45) and not robustness.noise(0.5, 0, 0.3) and not robustness.noise(0.5, 31, None)
    assert robustness.gate_power(5) == pytest.approx(0.5) and robustness.gate_power(4) == pytest.approx(0.3125)
    gate = robustness.count_gate("years", [0.21, 0.56, -0.5, -0.21, None, float("nan"), -0.27])
    assert gate.outcome == "WEAK" and "2 of 5" in gate.reason and "50%" in gate.reason
    assert robustness.count_gate("years", [-1.0, -1.1, -0.9, -1.05]).outcome == "FAIL"
    lone = robustness.grid_gate([0.1, 0.12, 0.11, 0.13, 3.0], 4, 0.0, benchmark=0.5)
    assert lone.outcome == "WEAK" and "20% above holding" in lone.reason


def test_funding_per_bar(spark):
    b = bars(spark, [100] * 4, hours=4)
    f = spark.createDataFrame([("A", T0, 0.0, 8.0), ("A", T0 + dt.timedelta(hours=8), 0.001, 8.0)], "symbol string, ts timestamp_ntz, funding_rate double, funding_hours double")
    assert column(panel.funding_per_bar(b, f, 14_400), "funding") == [0.0, 0.0, 0.0005, 0.0005]
    assert column(panel.funding_per_bar(b, f.limit(0), 14_400), "funding") == [0.0] * 4
