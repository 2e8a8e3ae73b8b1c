"""What a user calls: each function builds lazy frames, collects small tables of measures and records the run."""

from __future__ import annotations

import dataclasses
import functools
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import costs, stats
from .config import Run
from .errors import ConfigError, DataUnavailableError, InsufficientDataError
from .functions.nulls import safe_ln
from .functions.windows import lag, roll
from .operators import audit as checks
from .operators import execution, features, labels, ledger, models, panel, robustness, scans, validation
from .operators.asof import asof_strict
from .sources import archives, coverage, synthetic
from .sources import bars as src
from .sources.shared import fingerprint, materialised


def load_bars(spark: SparkSession, cfg: Run) -> DataFrame:
    """Bars of the configured source; one symbol if one is named."""
    d = cfg.data
    if d.source == "synthetic":
        out = synthetic.random_walk(spark, d.bars, interval=d.interval, seed=d.seed)
    elif d.source == "parquet":
        if not d.path:
            raise DataUnavailableError("data.path is not set")
        out = spark.read.parquet(d.path)
    elif d.source == "events":
        out = src.event_bars(spark, d.path)
    elif d.source == "archives":
        out = archives.klines(spark, d.path)
    else:
        raise ConfigError(f"unknown source {d.source!r}")
    for bound, ok in ((d.start, F.col("ts") >= F.lit(d.start).cast("timestamp_ntz")), (d.end, F.col("ts") < F.lit(d.end).cast("timestamp_ntz"))):
        out = out.where(ok) if bound else out
    return out.where(F.col("symbol") == d.symbol) if d.symbol else out


def load_auxiliary(spark: SparkSession, cfg: Run, bars: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Funding and metrics, each only if it is asked for, from before the close of each symbol's last bar."""
    d, out = cfg.data, []
    for wanted, made, read, path in ((d.funding, synthetic.funding, archives.funding, d.funding_path), (d.metrics, synthetic.metrics, archives.metrics, d.metrics_path)):
        if not wanted:
            out.append(None)
            continue
        if d.source != "synthetic" and not path:
            raise DataUnavailableError("a path to the funding or metrics archives is not set")
        aux = made(bars, d.seed) if d.source == "synthetic" else read(spark, path)
        out.append(archives.before_last_close(aux, bars, synthetic.SPACING[d.interval]))
    return out[0], out[1]


def build_features(spark: SparkSession, cfg: Run, bars: DataFrame, with_smoothed: bool = False) -> tuple[DataFrame, list[str]]:
    """Features of the bars and, where funding and metrics are asked for, of those; and the names that models use."""
    rows, names = features.build(bars, with_smoothed), list(models.DEFAULT_FEATURES)
    funding, metrics = load_auxiliary(spark, cfg, bars)
    seconds = synthetic.SPACING[cfg.data.interval]
    if funding is not None:
        rows = features.funding(asof_strict(rows, funding, ["funding_rate"], seconds))
        names += ["funding_ma_3", "funding_ma_21", "funding_z"]
    if metrics is not None:
        own = [c for c in metrics.columns if c not in ("symbol", "ts")]
        rows = features.positioning(asof_strict(rows, metrics, own, seconds)).drop(*own)
        names += ["oi_chg_6", "oi_chg_24", "ls_spread", "taker_z"]
    return rows, names


def _label(cfg: Run, bars: DataFrame) -> DataFrame:
    c = cfg.label
    extra = {"next_bar_sign": {}, "fwd_return": {"horizon": c.horizon, "deadband": c.deadband}, "triple_barrier": {"horizon": c.horizon, "upper": c.upper, "lower": c.lower}}
    if c.kind not in extra:
        raise ConfigError(f"unknown label {c.kind!r}")
    return labels.BUILDERS[c.kind](bars, window=c.vol_window, **extra[c.kind])


def _oos(bars: DataFrame, cfg: Run) -> DataFrame:
    """Add ``inside``: the bars of any test fold.  Folds are cut by time, as the models' are."""
    n = bars.agg(F.count_distinct("ts")).first()[0]
    if not n:
        raise InsufficientDataError("no bars")
    bounds = validation.fold_bounds(n, cfg.split)
    low, high = min(x[3] for x in bounds), max(x[4] for x in bounds)
    times = bars.select("ts").distinct().withColumn("k", F.row_number().over(Window.orderBy("ts")) - 1)  # a row for each time
    return bars.join(times, "ts").withColumn("inside", (F.col("k") >= low) & (F.col("k") < high))


LEARNT = ("ml_direction", "ml_meta")


def predictions(bars: DataFrame, cfg: Run, name: str) -> DataFrame:
    """The bars with the walk-forward chance ``p`` of a learnt strategy, and for ``ml_meta`` its ``side``.

    They are kept in the shared folder under the settings and the content of what is learnt from, so a sweep of sizing fits once.
    """
    spark = bars.sparkSession
    rows, names = build_features(spark, cfg, bars)
    if name == "ml_direction":
        rows = _label(cfg, rows.drop("lc", "r"))
    else:
        side = execution.sma_cross(rows, 24, 120, allow_short=True).withColumnRenamed("pos", "primary_side")
        rows, names = labels.meta(_label(cfg, side.drop("lc", "r")), "primary_side").drop("y").withColumnRenamed("meta_y", "y"), [*names, "primary_side"]
    rows = rows.select("symbol", "ts", "pos", "t_end", "y", *names)
    key = {"strategy": name, "data": fingerprint(rows), "split": dataclasses.asdict(cfg.split), "model": dataclasses.asdict(cfg.model)}
    p = models.remembered(spark, key, lambda: models.walk_forward(rows, names, cfg.split, cfg.model.kind, **cfg.model.params))
    b = labels.positions(bars).join(p.select("symbol", "pos", "p"), ["symbol", "pos"], "left").drop("pos", "n")
    return b if name == "ml_direction" else execution.sma_cross(b, 24, 120, allow_short=True).withColumnRenamed("pos", "side")


def held_cells(bars: DataFrame, cfg: Run, name: str, cells: list[dict]) -> DataFrame:
    """(the keys of the cells, bars, pos) of a learnt strategy sized in several ways: one set of predictions and one scan for all cells."""
    b, s = predictions(bars, cfg, name), [dataclasses.replace(cfg.sizing, **c) for c in cells]
    if name == "ml_direction":
        machines = {f"_w{k}": scans.Hysteresis(x.long_entry, x.long_exit, x.short_entry, x.short_exit, x.allow_short, x.min_hold) for k, x in enumerate(s)}
        held = scans.scan(b, "p", machines)
    else:
        entries = {e: f"_e{k}" for k, e in enumerate(sorted({x.long_entry for x in s}))}
        b = b.withColumns({c: F.when(F.col("p").isNotNull(), F.when(F.col("p") >= e, F.col("side")).otherwise(0.0)) for e, c in entries.items()})
        held = scans.scan(b, {f"_w{k}": entries[x.long_entry] for k, x in enumerate(s)}, {f"_w{k}": scans.MinHold(x.min_hold) for k, x in enumerate(s)})
    each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in cell.items()], F.col(f"_w{k}").alias("pos")) for k, cell in enumerate(cells)])).alias("_c")
    return _sized(held.select(*bars.columns, each).select(*bars.columns, "_c.*"), cfg, list(cells[0]))


def positions(bars: DataFrame, cfg: Run, name: str) -> DataFrame:
    """Bars with the position of one strategy; of the learnt ones, by walk-forward predictions."""
    params = cfg.params.get(name, {})
    if name in LEARNT:
        return held_cells(bars, cfg, name, [{"min_hold": cfg.sizing.min_hold}]).drop("min_hold")
    if name not in execution.REGISTRY:
        raise ConfigError(f"unknown strategy {name!r}")
    if name == "vol_target":
        params = {"bars_per_year": cfg.data.bars_per_year, **params}
    try:
        return execution.REGISTRY[name](bars, **params)
    except TypeError as e:
        raise ConfigError(f"{name}: {e}") from e


def _sized(held: DataFrame, cfg: Run, cell: list[str]) -> DataFrame:
    """Positions scaled to ``sizing.vol_target`` (if it is over 0) and kept within ``sizing.max_leverage``; histories are told by symbol and cell."""
    s, by = cfg.sizing, ["symbol", *cell]
    b = held.withColumn("lc", safe_ln("close")).withColumn("r", F.col("lc") - lag("lc", by=by))
    b = b.withColumn("_sigma", roll(F.stddev_samp, "r", cfg.label.vol_window, by=by))
    return b.withColumn("pos", execution.scale_to_risk("pos", "_sigma", s.vol_target, cfg.data.bars_per_year, s.max_leverage)).drop("_sigma", "lc", "r")


def trials(spark: SparkSession, cfg: Run) -> int:
    """Variants tried so far: those of the ledger, ``prior_trials`` and this run's."""
    try:
        before = ledger.count_trials(ledger.load(spark, cfg.ledger)).first()[0]
    except AnalysisException:  # nothing has been recorded yet
        before = 0
    return before + cfg.prior_trials + len(cfg.strategies)


def warnings(spark: SparkSession, cfg: Run) -> list[str]:
    """What can't work in a configuration, and earlier runs that were nearly the same."""
    out = costs.warnings(cfg.label.horizon, cfg.sizing.min_hold, costs.sigma(load_bars(spark, cfg)), 2 * cfg.cost.rate)
    try:
        runs = ledger.load(spark, cfg.ledger)
    except AnalysisException:
        return out
    said = ledger.warning(ledger.near_misses(runs, ledger.flatten(dataclasses.asdict(cfg))))
    killed = runs.where((F.col("verdict") == "KILLED") & (F.col("config_hash") == ledger.fingerprint(dataclasses.asdict(cfg)))).count()
    return out + ([said] if said else []) + ([f"this configuration has been killed before, {killed} times"] if killed else [])


def out_of_sample(held: DataFrame, bars: DataFrame, cfg: Run, by: list[str] | None = None) -> DataFrame:
    """Positions tested on the bars of any test fold alone, flat before and after: what is compared is measured alike."""
    by = by or ["symbol"]
    inside = _oos(bars, cfg).select("symbol", "ts", "inside")
    held = held.join(inside, ["symbol", "ts"]).withColumn("pos", F.when(F.col("inside"), F.col("pos")).otherwise(0.0))
    return execution.restrict(execution.backtest(held, cfg.cost.rate, by=by), "inside", by)


def run(spark: SparkSession, cfg: Run, record: bool = True, n_trials: int | None = None) -> DataFrame:
    """(strategy, symbol, measures) out of sample, with p-values and Sharpe ratios deflated by the number of variants tried (by the ledger, unless it is given)."""
    if n_trials is not None and n_trials < 1:
        raise ConfigError(f"{n_trials} variants can't have been tried")
    bars, out = load_bars(spark, cfg), None
    for name in dict.fromkeys(cfg.strategies):
        r = out_of_sample(positions(bars, cfg, name), bars, cfg)
        s = execution.summarize(r, cfg.data.bars_per_year, ["symbol"]).select(F.lit(name).alias("strategy"), "*")
        out = s if out is None else out.unionByName(s)
    out = execution.significance(out, cfg.data.bars_per_year, n_trials or trials(spark, cfg))
    if record:
        rows = [r.asDict() for r in out.limit(1000).collect()]
        ledger.record(cfg.ledger, "run", dataclasses.asdict(cfg), {f"{r['strategy']}/{r['symbol']}": r for r in rows}, variants=len(cfg.strategies))
    return out


def budget(spark: SparkSession, cfg: Run, holds=(1, 6, 12, 24, 48, 168, 336, 720), accuracies=(0.51, 0.52, 0.55, 0.6)) -> DataFrame:
    """What a bet must win to pay its costs."""
    return execution.budget(execution.mean_move(load_bars(spark, cfg), list(holds)), list(accuracies), cfg.cost.rate)


@dataclass(frozen=True)
class Check:
    name: str
    passed: bool | None
    detail: str


def audit(spark: SparkSession, cfg: Run, probes: int = 12, null_limit: float = 0.5, record: bool = True) -> list[Check]:
    """Truncated history, single features, shuffled labels, null data and the plan itself."""
    bars = load_bars(spark, cfg)
    build = lambda b: features.build(b, with_smoothed=False)
    names = models.DEFAULT_FEATURES
    funding, metrics = load_auxiliary(spark, cfg, bars)
    whole = features.build(bars)
    if funding is not None:
        whole = features.funding(asof_strict(whole, funding, ["funding_rate"], synthetic.SPACING[cfg.data.interval]))
    if metrics is not None:
        whole = features.positioning(asof_strict(whole, metrics, [c for c in metrics.columns if c not in ("symbol", "ts")], synthetic.SPACING[cfg.data.interval]))
    out = []
    off = {r["feature"]: r["differs"] for r in checks.point_in_time(bars, features.build, None, probes).collect()}
    out.append(Check("point_in_time", not any(off.values()), f"{sum(off.values())} values differ"))
    try:
        unread = checks.lint_lookahead(whole)
        out.append(Check("plan", True, f"not read: {', '.join(unread)}" if unread else ""))
    except checks.LookaheadError as e:
        out.append(Check("plan", False, str(e)))
    rows = _label(cfg, build(bars).drop("lc", "r"))
    leak = [r["feature"] for r in checks.single_feature_auc(rows, names, "y").where("leak").collect()]
    out.append(Check("label_leakage", not leak, ", ".join(leak)))
    p = models.walk_forward(_shuffled_by_time(rows), names, cfg.split)
    r = checks.auc(p.withColumn("one", F.lit(1)), "p", "y", ["one"]).first()
    out.append(Check("shuffled_label", None if r is None or r["auc"] is None else abs(r["auc"] - 0.5) < max(0.02, 2 / max(r["n"], 1) ** 0.5), "" if r is None else f"AUC {r['auc']}"))
    null = dataclasses.replace(cfg, data=dataclasses.replace(cfg.data, source="synthetic", symbol=""), strategies=tuple(s for s in cfg.strategies if s != "buy_hold") or ("sma_cross",))
    best = run(spark, null, record=False).agg(F.max("sharpe")).first()[0]
    out.append(Check("null_data", best is not None and best < null_limit, f"best Sharpe {best}"))
    out.append(_survivorship(bars, cfg))
    if record:
        ledger.record(cfg.ledger, "audit", dataclasses.asdict(cfg), {c.name: c.passed for c in out})
    return out


def _survivorship(bars: DataFrame, cfg: Run, grace: int = 60) -> Check:
    """Whether the universe has symbols that died; of synthetic bars there is nothing to say.

    A single symbol says it by its own last bar.  Several of which none ended early were probably chosen among survivors.
    """
    if cfg.data.source == "synthetic":
        return Check("survivorship", None, "synthetic bars")
    ends = bars.groupBy("symbol").agg(F.max("ts").alias("last"))
    end = F.lit(cfg.data.end or bars.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    n, dead = ends.agg(F.count("*"), F.count_if(F.col("last") < end - F.make_dt_interval(days=F.lit(grace)))).first()
    if n == 1:
        return Check("survivorship", None, "one symbol, which " + ("ended early" if dead else "has survived: its choice may be hindsight"))
    return Check("survivorship", dead > 0, f"{dead} of {n} symbols ended more than {grace} days before the sample")


def _shuffled_by_time(rows: DataFrame, seed: int = 0) -> DataFrame:
    """Labels permuted among a symbol's labelled bars."""
    known = rows.where("y is not null")
    w = Window.partitionBy("symbol")
    a = known.drop("y").withColumn("_k", F.row_number().over(w.orderBy("pos")))
    b = known.select("symbol", "y", F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), F.col("pos")))).alias("_k"))
    return a.join(b, ["symbol", "_k"]).drop("_k")


def neighbourhood(spark: SparkSession, cfg: Run, strategy: str, axes: dict[str, list] | None = None) -> tuple[DataFrame, str, str]:
    """(out-of-sample measures of every cell around a strategy's parameters or sizing, the two axes)."""
    near = robustness.around(strategy)
    axes = axes or near.axes
    one, two = axes
    bars = materialised(load_bars(spark, cfg), "bars")
    if near.sizing:
        held = held_cells(bars, cfg, strategy, near.cells(axes))
    else:
        held = robustness.rule_cells(bars, strategy, axes, cfg.data.bars_per_year)
    key = ["symbol", one, two]
    return execution.summarize(out_of_sample(held.select("symbol", "ts", "open", "pos", one, two), bars, cfg, key), cfg.data.bars_per_year, key), one, two


def robust(spark: SparkSession, cfg: Run, fast=(3, 5, 8, 13), slow=(20, 40, 80, 120), record: bool = True, strategy: str = "sma_cross", axes: dict[str, list] | None = None) -> tuple[str, list[robustness.Gate]]:
    """Other parameters, other years, other symbols; a verdict on the first symbol.  All are measured out of sample, the benchmark too.

    The moving-average rule is tried over ``fast`` and ``slow``, the other rules over ``axes`` or the neighbourhood that they have.
    """
    bars, year = materialised(load_bars(spark, cfg), "bars"), cfg.data.bars_per_year
    if strategy == "sma_cross" and axes is None:
        axes = {"fast": list(fast), "slow": list(slow)}
    grid, one, two = neighbourhood(spark, cfg, strategy, axes)
    middle = {k: v[len(v) // 2] for k, v in (axes or robustness.around(strategy).axes).items()}
    symbol = cfg.data.symbol or bars.agg(F.min("symbol")).first()[0]
    mine = F.col("symbol") == symbol
    cells = [r["sharpe"] for r in grid.where(mine).collect()]
    flips = robustness.sign_flips(grid.where(mine), one, two, "sharpe", ["symbol"]).first()
    changed = {"sizing": dataclasses.replace(cfg.sizing, **middle)} if robustness.around(strategy).sizing else {"params": {strategy: middle}}
    tested = out_of_sample(positions(bars, dataclasses.replace(cfg, **changed), strategy), bars, cfg)
    hold = out_of_sample(execution.buy_hold(bars), bars, cfg)
    years = robustness.stability(execution.by_period(tested.where(mine), year, ["symbol"]), execution.by_period(hold.where(mine), year, ["symbol"]), ["symbol"])
    a, b = (execution.summarize(x, year, ["symbol"]).select("symbol", F.col("sharpe").alias(n)) for x, n in ((tested, "s"), (hold, "h")))
    others = [r["s"] - r["h"] for r in a.join(b, "symbol").where(~mine).collect()]
    gates = [
        robustness.grid_gate(cells, flips["pairs"] if flips else 0, flips["rate"] if flips else None, benchmark=next((r["h"] for r in b.where(mine).collect()), None)),
        robustness.count_gate("stability", [r["excess_sharpe"] for r in years.collect()]),
        robustness.count_gate("transfer", others),
    ]
    verdict = robustness.verdict(gates)
    if record:
        pinned = dataclasses.asdict(dataclasses.replace(cfg, strategies=(strategy,)))  # the verdict is this strategy's alone
        ledger.record(cfg.ledger, "robust", pinned, {g.name: g.outcome for g in gates}, verdict, variants=len(cells) + len(others), notes=f"strategy={strategy}")
    return verdict, gates


def sweep(spark: SparkSession, cfg: Run, entries=(0.52, 0.54, 0.56, 0.58, 0.60), holds=(12, 48, 168, 336, 720), strategy: str = "ml_direction", record: bool = True) -> DataFrame:
    """(long_entry, min_hold, symbol, measures) out of sample of every entry and hold, all cells advanced by one scan of one set of predictions.

    A rule has no entry or hold, so its cells are all alike, as they should be.
    """
    bars = materialised(load_bars(spark, cfg), "bars")
    cells = [{"long_entry": e, "min_hold": h} for e in entries for h in holds]
    if strategy in LEARNT:
        held = held_cells(bars, cfg, strategy, [c | {"short_entry": round(1 - c["long_entry"], 4)} for c in cells])
    else:
        each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in c.items()]) for c in cells])).alias("_c")
        held = positions(bars, cfg, strategy).select("symbol", "ts", "open", "pos", each).select("symbol", "ts", "open", "pos", "_c.*")
    key = ["long_entry", "min_hold", "symbol"]
    out = execution.summarize(out_of_sample(held.select("symbol", "ts", "open", "pos", *key[:2]), bars, cfg, key), cfg.data.bars_per_year, key)
    if record:
        rows = {f"{r['symbol']}/{r['long_entry']}/{r['min_hold']}": r["sharpe"] for r in out.limit(1000).collect()}
        pinned = dataclasses.asdict(dataclasses.replace(cfg, strategies=(strategy,)))
        ledger.record(cfg.ledger, "sweep", pinned, rows, variants=len(cells), notes=f"strategy={strategy}")
    return out


def feature_importance(spark: SparkSession, cfg: Run) -> DataFrame:
    rows = _label(cfg, features.build(load_bars(spark, cfg), with_smoothed=False).drop("lc", "r"))
    return models.importance(rows, models.DEFAULT_FEATURES, cfg.split)


def ablate(spark: SparkSession, cfg: Run, group: list[str], record: bool = True) -> dict[str, float]:
    """AUC of each fold with and without some features, compared as pairs."""
    rows = _label(cfg, features.build(load_bars(spark, cfg), with_smoothed=False).drop("lc", "r"))
    rest = [f for f in models.DEFAULT_FEATURES if f not in group]
    if len(rest) == len(models.DEFAULT_FEATURES) or not rest:
        raise ConfigError(f"none or all of the features: {', '.join(group)}")
    a, b = ({r["fold"]: r["auc"] for r in models.walk_forward_scores(rows, f, cfg.split).collect()} for f in (models.DEFAULT_FEATURES, rest))
    both = sorted(k for k in a.keys() & b.keys() if a[k] == a[k] and b[k] == b[k])
    t, p = stats.one_sample([a[k] - b[k] for k in both])
    mean = lambda d: sum(d[k] for k in both) / max(1, len(both))
    out = {"with": mean(a), "without": mean(b), "t": t, "p": p, "folds": len(both)}
    if record:
        ledger.record(cfg.ledger, "ablate", dataclasses.asdict(cfg), out, variants=2, notes=f"group={','.join(sorted(group))}")
    return out


def resolve_universe(spark: SparkSession, cfg: Run, month: str, pattern: str | None = None) -> list[str]:
    """The symbols that had bars in a month, so that those that died later are among them."""
    return sorted(r["symbol"] for r in src.universe_as_of(load_bars(spark, cfg), month, pattern).collect())


def fetch(spark: SparkSession, cfg: Run, cached: DataFrame | None = None, free: int = 15) -> DataFrame:
    """(symbol, month) that the archive lacks between each symbol's first and last bar; nothing is downloaded.

    With ``cached`` (symbol, ...), more than ``free`` symbols that aren't in it are refused.
    """
    bars = load_bars(spark, cfg)
    if cached is not None:
        coverage.guard(bars, cached, free)
    return coverage.missing_months(bars)


@dataclass(frozen=True)
class Panel:
    """What a cross-section gave: its rows, predictions, folds, books' measures and the dead."""

    rows: DataFrame
    predictions: DataFrame
    folds: DataFrame
    measures: DataFrame
    dead: DataFrame
    features: tuple[str, ...]
    horizon: int
    books: dict[str, DataFrame] = dataclasses.field(default_factory=dict)
    costs: DataFrame | None = None
    k: int = 0


#: Further slippages, in hundredths of a percent, at which the books of a cross-section are measured.
COST_LEVELS = (25.0, 50.0, 100.0)


def xsec(spark: SparkSession, cfg: Run, end: str, names: list[str] | None = None, ks=(2, 3, 4), rebalance: int = 42, horizon: int = 6, top_n: int | None = None, least_bars: int = 500, record: bool = True,
         universe_month: str | None = None, symbols: list[str] | None = None, reference: str | None = None, n_trials: int | None = None) -> Panel:
    """Load a panel, learn which symbols do better than the median, and test books of the best and worst out of sample.

    The universe is ``symbols``, or those that had bars in ``universe_month``, or all.  With ``data.funding`` every position pays the funding
    known at its bar.  ``reference`` adds two books that need no model: that symbol alone, and that symbol against all others.
    """
    names, bars = list(names or models.DEFAULT_FEATURES), load_bars(spark, cfg)
    if symbols or universe_month:
        chosen = symbols or resolve_universe(spark, cfg, universe_month)
        bars = bars.join(F.broadcast(spark.createDataFrame([(s,) for s in chosen], "symbol string")), "symbol", "left_semi")
    build = lambda b: features.build(b, with_smoothed=False)
    rows, dead = panel.load(bars, build, names, end, horizon, top_n, least_bars=least_bars)
    funding, _ = load_auxiliary(spark, cfg, bars)
    if funding is not None:
        rows = panel.funding_per_bar(rows, funding, synthetic.SPACING[cfg.data.interval])
    rows = materialised(rows, "panel")
    p, folds = models.fit_predict_panel(rows, names, cfg.split, horizon, cfg.model.kind, **cfg.model.params)
    low, high = p.agg(F.min("time_pos"), F.max("time_pos")).first()
    inside = rows.join(p.select("ts", "symbol", "p"), ["ts", "symbol"], "left").where(F.col("time_pos").between(low, high)).withColumn("time_pos", F.col("time_pos") - low)
    inside = materialised(inside, "inside")
    learnt = {f"top_{k}": panel.top_book(inside, "p", k, rebalance) for k in ks}
    static = {"reference": panel.only_book(inside, reference), "static": panel.static_book(inside, reference)} if reference else {}
    books = learnt | {"equal_weight": panel.equal_book(inside, rebalance)} | static
    columns = ["symbol", "ts", "time_pos", "w", "ret_next", *(["funding"] if funding is not None else [])]
    every = materialised(functools.reduce(DataFrame.unionByName, [b.select(F.lit(name).alias("book"), *columns) for name, b in books.items()]), "books")
    paid, year = "funding" if funding is not None else None, cfg.data.bars_per_year
    tested = execution.summarize(panel.backtest(every, cfg.cost.rate, paid, by=["book"]), year, ["book"], "time_pos")
    tested = execution.significance(tested, year, n_trials or trials(spark, cfg) + len(books))
    levels = [(cfg.cost.slippage_bps, cfg.cost.rate), *((x, (cfg.cost.fee_bps + x) / 1e4) for x in COST_LEVELS)]
    dearer = [execution.summarize(panel.backtest(every.where(F.col("book") != "equal_weight"), rate, paid, by=["book"]), year, ["book"], "time_pos").select(F.lit(x).alias("slippage_bps"), "book", "sharpe", "total_return") for x, rate in levels]
    if record:
        ledger.record(cfg.ledger, "xsec", dataclasses.asdict(cfg), {r["book"]: r.asDict() for r in tested.collect()}, variants=len(books))
    kept = {name: every.where(F.col("book") == name).drop("book") for name in books}
    return Panel(rows, p, folds, tested, dead, tuple(names), horizon, kept, functools.reduce(DataFrame.unionByName, dearer), ks[0])


def attribution(found: Panel, levels: list[float] | None = None, least: int = 200) -> dict[str, DataFrame]:
    """Where the result of the first book comes from: accuracy and profit of each symbol, the share of the dead, extreme gains against short
    positions, and how concentrated these are."""
    book, one = found.books[f"top_{found.k}"], F.lit(1)
    dead = [r["symbol"] for r in found.dead.select("symbol").collect()]
    gains = checks.pnl(book)
    per_symbol = checks.per_symbol(found.predictions, "p", "y")
    return {
        "per_symbol": per_symbol,
        "best_and_worst": checks.best_and_worst(per_symbol, least=least),
        "contribution": gains.withColumn("dead", F.col("symbol").isin(dead) if dead else one == 0),
        "delisted_share": checks.share_of(gains, F.col("symbol").isin(dead) if dead else one == 0),
        "tail_curve": checks.tail_curve(book, levels or [0.25, 0.5, 1.0, 2.0, 5.0]),
        "tail_census": checks.tail_census(book, 0.5),
        "concentration": checks.concentration(book, 1.0 / found.k),
    }


def verify_panel(cfg: Run, found: Panel, tolerance: float = 0.02) -> list[Check]:
    """Controls of a cross-section: labels shuffled within each time and the dead left out, both fit anew; then where its result comes from."""
    fit = lambda rows: checks.auc(models.fit_predict_panel(rows, list(found.features), cfg.split, found.horizon, cfg.model.kind, **cfg.model.params)[0].withColumn("one", F.lit(1)), "p", "y", ["one"]).first()
    own = checks.auc(found.predictions.withColumn("one", F.lit(1)), "p", "y", ["one"]).first()
    known = checks.shuffled(found.rows, "y", "time_pos").drop("y").withColumnRenamed("y_shuffled", "y")
    mixed = fit(known)
    out = [Check("shuffled_label", abs(mixed["auc"] - 0.5) <= max(tolerance, 2 / mixed["n"] ** 0.5), f"AUC {mixed['auc']:.4f}")]
    n = found.dead.count()
    if n:
        alive = fit(found.rows.join(found.dead.select("symbol"), "symbol", "left_anti"))
        out.append(Check("survivors_only", abs(alive["auc"] - own["auc"]) <= tolerance, f"AUC {own['auc']:.4f}, without {n} dead {alive['auc']:.4f}"))
    else:
        out.append(Check("survivors_only", None, "no symbol died"))
    if not found.books:
        return out
    told = attribution(found)
    edge = told["best_and_worst"].first()
    out.append(Check("per_symbol", None if not edge["symbols"] else edge["lowest"] > 0.5 - tolerance, f"AUC from {edge['lowest']} ({edge['worst']}) to {edge['highest']} ({edge['best']})"))
    part = told["delisted_share"].first()
    out.append(Check("delisted_share", part["share"] <= 0.5 if part["n_dead"] else None, f"{part['share']:.1%} of all gains and losses are of {part['n_dead']} dead"))
    ruin = [r["level"] for r in told["tail_curve"].where("ruinous").collect()]
    out.append(Check("tails", not ruin, f"a gain of {min(ruin):.0%} in a short would be ruinous" if ruin else ""))
    short = told["concentration"].first()
    out.append(Check("concentration", short["share"] <= 0.05, f"{short['share']:.1%} of bars have a short above its nominal size, {short['longest']} in a row at most"))
    return out


def cross_section(spark: SparkSession, cfg: Run, score, ks=(2, 3, 4), rebalance: int = 42) -> DataFrame:
    """(book, measures) of top-minus-bottom books by ``score`` (a function of the panel that adds that column) and of the benchmark."""
    p = score(panel.prices(src.dense(load_bars(spark, cfg)))).persist()
    books = {f"top_{k}": panel.top_book(p, "score", k, rebalance) for k in ks} | {"equal_weight": panel.equal_book(p, rebalance)}
    out = None
    for name, book in books.items():
        r = panel.backtest(book.withColumn("book", F.lit(name)), cfg.cost.rate, by=["book"])
        s = execution.summarize(r, cfg.data.bars_per_year, ["book"], "time_pos")
        out = s if out is None else out.unionByName(s)
    return out
