"""The user's functions end to end on synthetic bars, streaming bars beside batch ones, and configuration errors."""

import dataclasses
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from edgeprobe import api, cli, config, ledger_view, report
from edgeprobe.errors import ConfigError, DataUnavailableError
from edgeprobe.operators import audit, labels, ledger, models, robustness, scans, validation
from edgeprobe.operators.execution import scale_to_risk
from edgeprobe.operators.features import momentum, log_returns
from edgeprobe.sources import bars as src
from edgeprobe.sources import synthetic
from edgeprobe.streaming import bars as stream
from edgeprobe.streaming import positions


@pytest.fixture
def cfg(tmp_path):
    return config.from_dict({
        "data": {"source": "synthetic", "bars": 900},
        "label": {"kind": "next_bar_sign"},
        "split": {"n_folds": 2, "min_train": 400, "least": 50},
        "model": {"kind": "logistic"},
        "strategies": ["buy_hold", "sma_cross", "donchian", "mean_reversion", "vol_target", "ml_direction", "ml_meta"],
        "params": {"sma_cross": {"fast": 5, "slow": 20}, "donchian": {"entry": 24, "exit": 12}},
        "ledger": str(tmp_path / "runs"),
    })


def test_run_records(spark, cfg):
    rows = api.run(spark, cfg).collect()
    assert {r["strategy"] for r in rows} == set(cfg.strategies) and all(r["bars"] == 500 for r in rows)
    (s,) = ledger_view.summary(spark, cfg.ledger).collect()
    assert (s["command"], s["runs"]) == ("run", 1)


def test_audit_of_clean_features(spark, cfg):
    got = {c.name: c.passed for c in api.audit(spark, cfg, probes=3, record=False)}
    assert got["point_in_time"] and got["plan"] and got["label_leakage"]


def test_robust_and_ablation(spark, cfg):
    verdict, gates = api.robust(spark, cfg, fast=(3, 5), slow=(20, 40), record=False)
    assert verdict in ("KILLED", "INCONCLUSIVE", "SURVIVED") and len(gates) == 3
    assert api.ablate(spark, cfg, ["z_24"])["folds"] == 2
    assert [(r["command"], r["variants"]) for r in ledger.load(spark, cfg.ledger).collect()] == [("ablate", 2)]
    assert api.feature_importance(spark, cfg).count() == 9
    with pytest.raises(ConfigError):
        api.ablate(spark, cfg, ["nothing"])


def test_cross_section(spark, cfg, tmp_path):
    src.nation_bars(spark, "/root/testdata/sf0.01").write.parquet(f"{tmp_path}/bars")
    c = config.from_dict({"data": {"path": f"{tmp_path}/bars", "interval": "1d"}})
    score = lambda p: p.withColumn("score", -F.col("lo"))
    assert {r["book"] for r in api.cross_section(spark, c, score, ks=(2,), rebalance=20).collect()} == {"top_2", "equal_weight"}


def test_panel_with_models_and_controls(spark, tmp_path):
    """A score that says what comes is found, shuffled labels aren't, and the measures have their significance."""
    walk = synthetic.random_walk(spark, 700, 12, "1d", seed=4, edge=0.6)
    walk.where("symbol <> 'SYN3' or ts < timestamp_ntz '2021-09-01'").write.parquet(f"{tmp_path}/bars")
    c = config.from_dict({"data": {"path": f"{tmp_path}/bars", "interval": "1d"}, "split": {"n_folds": 2, "min_train": 300, "least": 50}, "model": {"kind": "logistic"}, "ledger": str(tmp_path / "runs"), "prior_trials": 20})
    found = api.xsec(spark, c, "2021-12", ["ret_1", "ret_3", "z_12"], ks=(2,), rebalance=2, horizon=1, least_bars=400, reference="SYN1")
    assert [r["symbol"] for r in found.dead.collect()] == ["SYN3"]
    assert all(r["auc"] > 0.55 for r in found.folds.collect()) and found.folds.count() == 2
    got = {r["book"]: r for r in found.measures.collect()}
    assert {r["slippage_bps"] for r in found.costs.collect()} == {2.0, 25.0, 50.0, 100.0}
    dear = {r["slippage_bps"]: r["sharpe"] for r in found.costs.where("book = 'top_2'").collect()}
    assert dear[2.0] == pytest.approx(got["top_2"]["sharpe"]) and dear[2.0] > dear[25.0] > dear[100.0]
    assert set(got) == {"top_2", "equal_weight", "reference", "static"} and all(0 <= r["p_value"] <= 1 and r["deflated_sharpe"] < r["sharpe"] for r in got.values())
    checks = {x.name: x.passed for x in api.verify_panel(c, found)}
    assert checks["shuffled_label"] and checks["survivors_only"] is not None
    assert checks["per_symbol"] and checks["delisted_share"] is not None and {"tails", "concentration"} <= set(checks)
    told = api.attribution(found)
    assert told["contribution"].where("dead").select("symbol").collect() == [("SYN3",)] and 0 < told["delisted_share"].first()["share"] < 1
    few = api.xsec(spark, c, "2021-12", ["ret_1", "ret_3"], ks=(1,), rebalance=2, horizon=1, least_bars=400, symbols=[f"SYN{k}" for k in range(5)], n_trials=7, record=False)
    assert {r["symbol"] for r in few.rows.select("symbol").distinct().collect()} == {f"SYN{k}" for k in range(5)}
    assert api.resolve_universe(spark, c, "2020-02") == sorted(f"SYN{k}" for k in range(12))
    assert api.fetch(spark, c).count() == 0


def test_auxiliary_features_and_sizing(spark, cfg):
    d = dataclasses.replace(cfg.data, funding=True, metrics=True)
    c = dataclasses.replace(cfg, data=d, sizing=dataclasses.replace(cfg.sizing, vol_target=0.2, max_leverage=0.5), strategies=("ml_direction",))
    bars = api.load_bars(spark, c)
    funding, metrics = api.load_auxiliary(spark, c, bars)
    end = bars.agg(F.max("ts")).first()[0] + dt.timedelta(hours=1)
    assert funding.where(F.col("ts") >= F.lit(end)).count() == 0 and metrics.where(F.col("ts") >= F.lit(end)).count() == 0
    rows, names = api.build_features(spark, c, bars)
    assert set(names) <= set(rows.columns) and rows.count() == 900 and rows.where("oi_chg_24 is not null").count() > 800
    held = api.positions(bars, c, "ml_direction")
    assert held.agg(F.max(F.abs("pos"))).first()[0] <= 0.5
    with pytest.raises(DataUnavailableError):
        api.load_auxiliary(spark, dataclasses.replace(c, data=dataclasses.replace(d, source="events")), bars)


def test_boosted_trees_find_what_a_line_cannot(spark):
    """y is the sign of a product of two features."""
    w = synthetic.random_walk(spark, 900, 1, seed=2)
    w = w.select("symbol", "ts", F.signum("close").alias("_"), (F.pmod(F.xxhash64("ts"), F.lit(1000)) / 1000 - 0.5).alias("a"), (F.pmod(F.xxhash64("ts", F.lit(1)), F.lit(1000)) / 1000 - 0.5).alias("b"))
    rows = labels.positions(w).withColumn("y", (F.col("a") * F.col("b") > 0).cast("double")).withColumn("t_end", F.col("pos"))
    split = validation.Split(n_folds=2, min_train=500, least=50)
    found = {}
    for kind in ("logistic", "hgb"):
        p = models.walk_forward(rows, ["a", "b"], split, kind, **({"rounds": 15, "least": 20} if kind == "hgb" else {}))
        found[kind] = audit.auc(p.withColumn("one", F.lit(1)), "p", "y", ["one"]).first()["auc"]
    assert found["hgb"] > 0.9 and abs(found["logistic"] - 0.5) < 0.1


def test_grids_of_every_rule(spark, cfg):
    grid, one, two = api.neighbourhood(spark, cfg, "donchian", {"entry": [12, 24], "exit": [6, 24]})
    assert (one, two) == ("entry", "exit") and grid.count() == 3
    wide = robustness.pivot(grid, "entry", "exit")
    assert wide.columns == ["entry", "6", "24"] and wide.count() == 2
    assert "entry" in report.grid([r.asDict() for r in grid.collect()], "entry", "exit", "sharpe")
    verdict, gates = api.robust(spark, cfg, record=False, strategy="donchian", axes={"entry": [12, 24], "exit": [6, 12]})
    assert len(gates) == 3 and verdict in report.gates(verdict, gates)
    assert [robustness.around(x).sizing for x in ("vol_target", "ml_meta")] == [False, True]
    with pytest.raises(ConfigError):
        robustness.around("buy_hold")


def test_sweep(spark, cfg, monkeypatch):
    """All cells from one fit, each as if it were run alone, and as many variants in the ledger."""
    cfg = dataclasses.replace(cfg, data=dataclasses.replace(cfg.data, seed=31))  # no other test has made its predictions
    fits, fit = [], models.walk_forward
    monkeypatch.setattr(models, "walk_forward", lambda *a, **k: fits.append(1) or fit(*a, **k))
    got = api.sweep(spark, cfg, entries=(0.52, 0.54), holds=(12, 48)).collect()
    assert {(r["long_entry"], r["min_hold"]) for r in got} == {(0.52, 12), (0.52, 48), (0.54, 12), (0.54, 48)} and all(r["bars"] == 500 for r in got)
    alone = dataclasses.replace(cfg, strategies=("ml_direction",), sizing=dataclasses.replace(cfg.sizing, long_entry=0.52, short_entry=0.48, min_hold=48))
    mine = {r["symbol"]: r["sharpe"] for r in got if (r["long_entry"], r["min_hold"]) == (0.52, 48)}
    assert mine == pytest.approx({r["symbol"]: r["sharpe"] for r in api.run(spark, alone, record=False).collect()})
    assert len(fits) == 1
    other = dataclasses.replace(alone, data=dataclasses.replace(cfg.data, seed=5))
    api.run(spark, other, record=False).collect()
    assert len(fits) == 2  # other data, other predictions
    (run,) = ledger.load(spark, cfg.ledger).collect()
    assert (run["command"], run["variants"]) == ("sweep", 4)
    rules = api.sweep(spark, cfg, entries=(0.52, 0.54), holds=(12,), strategy="sma_cross", record=False).collect()
    assert len(rules) == 2 * len({r["symbol"] for r in rules}) and len({(r["symbol"], r["sharpe"]) for r in rules}) == len(rules) / 2


def test_trees_learn_where_missing_values_belong(spark):
    """One split tells everything, if missing values go to its right; and with them to its left."""
    for side in (1, 0):
        rows = [("a", k, (k * 7919 % 10) / 10 if k % 3 else None) for k in range(900)]
        rows = [(s, k, x, float(side if x is None else x > 0.5)) for s, k, x in rows]
        df = spark.createDataFrame(rows, "symbol string, pos bigint, x0 double, y double")
        ready = models._assembled(df, ["x0"], "hgb")
        p = models._fitted(ready, ready, models.estimator("hgb", rounds=1, depth=1, least=5))
        assert p.where((F.col("p") > 0.5) != (F.col("y") == 1)).count() == 0


def test_warnings_and_trials(spark, cfg):
    assert api.trials(spark, cfg) == len(cfg.strategies)
    api.run(spark, dataclasses.replace(cfg, strategies=("buy_hold",)), record=True).collect()
    near = dataclasses.replace(cfg, strategies=("buy_hold",), sizing=dataclasses.replace(cfg.sizing, min_hold=500))
    said = api.warnings(spark, near)
    assert any("bars ahead" in x for x in said) and any("nearly the same" in x for x in said)
    assert ledger.recent(ledger.load(spark, cfg.ledger)).count() == 1 and ledger.unrecorded(ledger.load(spark, cfg.ledger)).first()[0] == 0


def test_configuration_errors(tmp_path):
    f = tmp_path / "x.toml"
    f.write_text("[data]\nintervall = '1h'\n")
    with pytest.raises(ConfigError):
        config.load(str(f))
    with pytest.raises(ConfigError):
        config.load(str(tmp_path / "none.toml"))
    f.write_text("[sizing]\nmin_hold = 3\n")
    assert config.load(str(f), {"sizing.min_hold": "9"}).sizing.min_hold == 9 and config.load(str(f)).name == "x"


def test_risk_scaling(spark):
    df = spark.createDataFrame([(1.0, 0.01), (1.0, None), (-1.0, 0.0)], "pos double, sigma double")
    got = [r[0] for r in df.select(scale_to_risk("pos", "sigma", 0.5, 2500)).collect()]
    assert got == [1.0, 0.0, 0.0]


def test_stream_equals_batch(spark, tmp_path):
    data = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{data}/events.parquet")
    e.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    q = stream.stream_bars(stream.stream_events(spark, f"{tmp_path}/in", e.schema)).writeStream.format("memory").queryName("streamed").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r["symbol"], r["ts"], r["open"], r["close"], r["trades"]) for r in df.collect())
    assert key(spark.table("streamed")) == key(src.event_bars(spark, data))


def test_positions_of_a_stream(spark, tmp_path):
    """Rows in any order within the watermark give the positions of the whole history; a timer ends a symbol that gets no more rows."""
    rng = random.Random(8)
    start = dt.datetime(2001, 1, 1)
    rows = [(s, start + dt.timedelta(minutes=10 * k), rng.random() if rng.random() < 0.9 else None) for s in "ab" for k in range(300)]
    arrival = sorted(rows, key=lambda r: (r[1] + dt.timedelta(minutes=rng.randrange(100)), rng.random()))
    schema = "symbol string, ts timestamp, p double"
    for k in range(6):
        part = arrival[100 * k : 100 * k + 100]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([("end", start + dt.timedelta(days=400), 0.5)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for machine in (scans.Hysteresis(0.56, 0.5, 0.44, 0.5, True, 6), scans.MinHold(5)):
        name = f"held_{type(machine).__name__}"
        q = positions.stream_positions(files, "p", machine, "2 hours").writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
        got = sorted(tuple(r) for r in spark.table(name).collect() if r.symbol != "end")
        whole = spark.createDataFrame(rows, "symbol string, ts timestamp, p double")
        assert got == sorted(tuple(r) for r in scans.scan(whole, "p", {"pos": machine}).select("symbol", "ts", "pos").collect())


def test_command_line(tmp_path, capsys):
    f = tmp_path / "c.toml"
    f.write_text(f"""strategies = ["buy_hold", "sma_cross"]
ledger = "{tmp_path}/runs"
[data]
source = "synthetic"
bars = 600
[split]
n_folds = 2
min_train = 300
least = 50
[model]
kind = "logistic"
""")
    assert cli.main(["run", str(f), "--save", str(tmp_path / "out"), "--trials", "50"]) == 0
    out = capsys.readouterr().out
    assert "deflated_sharpe" in out and (tmp_path / "out" / "c-run.json").exists()
    assert cli.main(["budget", str(f)]) == 0 and "at 55%" in capsys.readouterr().out
    assert cli.main(["sweep", str(f), "--strategy", "sma_cross", "--set", "params.sma_cross.fast=5"]) == 0 and "cells above 0" in capsys.readouterr().out
    assert cli.main(["ablate", str(f), "--group", "z_24"]) == 0 and "AUC with" in capsys.readouterr().out
    assert cli.main(["log", str(f), "--last", "2"]) == 0
    out = capsys.readouterr().out
    assert "ablate" in out and "sweep" in out and "variants" in out
    assert cli.main(["run", str(f), "--trials", "0"]) == ConfigError.code and "variants" in capsys.readouterr().err
    assert cli.main(["run", str(tmp_path / "none.toml")]) == ConfigError.code


def test_windows_are_per_symbol(spark):
    b = log_returns(src.event_bars(spark, "/root/testdata/sf0.001"))
    first = momentum(b).groupBy("symbol").agg(F.min_by("ret_1", "ts").alias("x")).collect()
    assert all(r["x"] is None for r in first)
