"""Strategies to positions, positions to returns, returns to measures.

A position decided at a bar's close is filled at the next open: it earns ln(open[t+2] / open[t+1]), and each change of
position costs its size times the rate.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.nulls import clip, finite, safe_div, safe_ln
from ..functions.windows import bars_window, roll, running, zscore
from .. import stats
from . import scans
from .features import log_returns

#: Bars in a year of each spacing.
BARS_PER_YEAR = {"1m": 525_600, "5m": 105_120, "15m": 35_040, "30m": 17_520, "1h": 8_760, "2h": 4_380, "4h": 2_190, "6h": 1_460, "12h": 730, "1d": 365, "1w": 52}
RATE = (10 + 2) / 1e4


def bars_in_a_year(interval: str) -> int:
    found = BARS_PER_YEAR.get(interval)
    if found is None:
        raise ConfigError(f"interval {interval!r} isn't one of {', '.join(BARS_PER_YEAR)}")
    return found


def buy_hold(bars: DataFrame) -> DataFrame:
    return bars.withColumn("pos", F.lit(1.0))


def sma_cross(bars: DataFrame, fast: int = 50, slow: int = 200, allow_short: bool = False, by="symbol") -> DataFrame:
    """Long while the fast mean is above the slow one; flat until the slow one is known."""
    a, b = roll(F.avg, "close", fast, by), roll(F.avg, "close", slow, by)
    return bars.withColumn("pos", F.when(b.isNull(), 0.0).when(a > b, 1.0).otherwise(-1.0 if allow_short else 0.0))


def donchian(bars: DataFrame, entry: int = 96, exit: int = 48, by="symbol") -> DataFrame:
    """Long from a close above the last ``entry`` highs to one below the last ``exit`` lows: the last event decides."""
    w = bars_window(by)
    past = lambda f, x, n: F.when(F.count(x).over(w.rowsBetween(-n, -1)) == n, f(x).over(w.rowsBetween(-n, -1)))
    event = F.when(F.col("close") > past(F.max, "high", entry), 1.0).when(F.col("close") < past(F.min, "low", exit), 0.0)
    latch = F.last("_event", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return bars.withColumn("_event", event).withColumn("pos", F.coalesce(latch, F.lit(0.0))).drop("_event")


def crossover_state(fast: str, slow: str) -> Column:
    """1 while one column is above the other, else -1."""
    return F.when(F.col(fast) > F.col(slow), 1.0).otherwise(-1.0)


def mean_reversion(bars: DataFrame, window: int = 72, entry: float = 2.0, exit: float = 0.5) -> DataFrame:
    return scans.fade(bars.withColumn("z", zscore("close", window)), "z", entry=entry, exit=exit)


def vol_target_size(bars: DataFrame, bars_per_year: int, target: float = 0.5, window: int = 30, most: float = 1.0) -> DataFrame:
    """Add ``want``: the size at which yearly risk is ``target``."""
    b = log_returns(bars)
    sigma = roll(F.stddev_samp, "r", window)
    return b.withColumn("want", F.coalesce(clip(safe_div(F.lit(target), sigma * F.lit(bars_per_year**0.5)), 0.0, most), F.lit(0.0)))


def vol_target(bars: DataFrame, bars_per_year: int, target: float = 0.5, window: int = 30, width: float = 0.1, most: float = 1.0) -> DataFrame:
    return scans.band(vol_target_size(bars, bars_per_year, target, window, most), "want", width=width)


def scale_to_risk(pos: str, sigma: str, target: float, bars_per_year: int, most: float = 1.0) -> Column:
    """A position scaled to constant yearly risk; without a known risk it is 0."""
    if target <= 0:
        return clip(pos, -most, most)
    scale = F.coalesce(clip(safe_div(F.lit(target), F.col(sigma) * F.lit(bars_per_year**0.5)), 0.0, most), F.lit(0.0))
    return clip(F.col(pos) * scale, -most, most)


REGISTRY = {"buy_hold": buy_hold, "sma_cross": sma_cross, "donchian": donchian, "mean_reversion": mean_reversion, "vol_target": vol_target}


def backtest(rows: DataFrame, rate: float | str = RATE, by="symbol", order: str = "ts") -> DataFrame:
    """Add turnover, cost, gross, net and equity to rows with open and pos.  All windows share one sort."""
    w = bars_window(by, order)
    lo = safe_ln("open")
    b = rows.withColumn("pos", F.coalesce("pos", F.lit(0.0))).withColumn("_lo", lo)
    earned = F.coalesce(F.lead("_lo", 2).over(w) - F.lead("_lo", 1).over(w), F.lit(0.0))
    b = b.withColumn("turnover", F.abs(F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(0.0)))).withColumn("gross", F.col("pos") * earned)
    cost = F.col("turnover") * (F.col(rate) if isinstance(rate, str) else F.lit(rate))
    b = b.withColumn("cost", cost).withColumn("net", F.col("gross") - F.col("cost")).drop("_lo")
    return b.withColumn("equity", F.exp(running(F.sum, "net", by, order)))


def restrict(result: DataFrame, mask: str, by="symbol", order: str = "ts") -> DataFrame:
    """Only the masked bars; the trade that closes the last of them, one bar later, is charged to it; equity starts anew."""
    w = bars_window(by, order)
    whole = Window.partitionBy(*([by] if isinstance(by, str) else by))
    last = F.max(F.when(F.col(mask), F.col(order))).over(whole) == F.col(order)
    b = result.withColumn("_cost", F.lead("cost").over(w)).withColumn("_turn", F.lead("turnover").over(w)).withColumn("_last", last & F.col(mask))
    leave = F.col("_last") & (F.coalesce("_cost", F.lit(0.0)) > 0)
    b = b.withColumn("turnover", F.col("turnover") + F.when(leave, F.col("_turn")).otherwise(0.0)).withColumn("_more", F.when(leave, F.col("_cost")).otherwise(0.0))
    b = b.withColumn("cost", F.col("cost") + F.col("_more")).withColumn("net", F.col("net") - F.col("_more")).where(mask).drop("_cost", "_turn", "_last", "_more")
    return b.withColumn("equity", F.exp(running(F.sum, "net", by, order)))


def summarize(result: DataFrame, bars_per_year: int, by: list[str], order: str = "ts") -> DataFrame:
    """One row of measures for each key: two aggregations over one shuffle by the key."""
    year = float(bars_per_year)
    b = result.withColumn("_down", F.col("equity") / running(F.max, "equity", by, order) - 1)
    on = F.abs("pos") > 1e-12
    g = b.groupBy(*by).agg(
        F.count("*").alias("bars"),
        F.sum("net").alias("_sum"),
        F.sum("gross").alias("_gross"),
        F.avg("net").alias("_mean"),
        F.stddev_samp("net").alias("_std"),
        F.sqrt(F.avg(F.pow(F.least("net", F.lit(0.0)), 2))).alias("_under"),
        F.min("_down").alias("max_drawdown"),
        F.count_if(F.col("turnover") > 1e-12).alias("n_trades"),
        F.sum("turnover").alias("_turn"),
        F.sum("cost").alias("_cost"),
        F.avg(on.cast("double")).alias("exposure"),
        F.avg(F.abs("pos")).alias("gross_exposure"),
        F.max(F.abs("pos")).alias("peak_exposure"),
        F.coalesce(F.avg(F.when(on, (F.col("net") > 0).cast("double"))), F.lit(0.0)).alias("hit_rate"),
    )
    root = F.lit(year**0.5)
    total = F.exp("_sum") - 1
    zero = lambda x: F.coalesce(finite(x), F.lit(0.0))
    cagr = F.pow(F.exp("_sum"), F.lit(year) / F.col("bars")) - 1  # not by 1 + total, which has few digits left after a near-total loss
    return g.select(
        *by,
        "bars",
        total.alias("total_return"),
        cagr.alias("cagr"),
        (F.col("_std") * root).alias("ann_vol"),
        zero(safe_div("_mean", "_std") * root).alias("sharpe"),
        zero(safe_div("_mean", "_under") * root).alias("sortino"),
        "max_drawdown",
        F.when(F.col("max_drawdown") < 0, cagr / -F.col("max_drawdown")).otherwise(0.0).alias("calmar"),
        (F.exp("_gross") - 1).alias("gross_return"),
        (F.col("bars") / F.lit(year)).alias("years"),
        zero(safe_div(F.col("_mean") * F.sqrt("bars"), F.col("_std"))).alias("t_stat"),
        "n_trades",
        (F.col("_turn") * year / F.col("bars")).alias("turnover_per_year"),
        (1 - F.exp(-F.col("_cost"))).alias("cost_drag"),
        "exposure",
        "gross_exposure",
        "peak_exposure",
        "hit_rate",
    )


def significance(measures: DataFrame, bars_per_year: int, trials: int = 1) -> DataFrame:
    """Add p_value (two-sided, normal) and deflated_sharpe (less what the best of ``trials`` would have by chance)."""
    best = stats.best_of(trials)

    def run(batches):
        import pyarrow as pa

        for b in batches:  # a row for each strategy and symbol
            p = [stats.normal_p(t) if t else 1.0 for t in b.column("t_stat").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*b.schema.names, "p_value"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in measures.schema)
    out = measures.mapInArrow(run, f"{fields}, p_value double")
    return out.withColumn("deflated_sharpe", F.col("sharpe") - best * F.sqrt(F.lit(float(bars_per_year)) / F.col("bars")))


def by_period(result: DataFrame, bars_per_year: int, by: list[str], unit: str = "year", coverage: float = 0.35) -> DataFrame:
    """Measures of each calendar period that is covered and in which the strategy was active."""
    g = result.groupBy(*by, F.date_format(F.date_trunc(unit, "ts"), "yyyy" if unit == "year" else "yyyy-MM-dd").alias("period")).agg(
        F.count("*").alias("bars"),
        F.sum("net").alias("_sum"),
        F.avg("net").alias("_mean"),
        F.stddev_samp("net").alias("_std"),
        F.count_if(F.abs("net") > 1e-12).alias("_active"),
        F.count_if(F.col("turnover") > 1e-12).alias("n_trades"),
    )
    full = coverage * bars_per_year if unit == "year" else 0
    g = g.where((F.col("bars") >= 2) & (F.col("_std") > 0) & (F.col("bars") >= full) & (F.col("_active") >= F.greatest(F.lit(2.0), 0.01 * F.col("bars"))))
    return g.select(*by, "period", "bars", (F.exp("_sum") - 1).alias("total_return"), (F.col("_mean") / F.col("_std") * F.lit(bars_per_year**0.5)).alias("sharpe"), "n_trades")


def mean_move(bars: DataFrame, holds: list[int]) -> DataFrame:
    """(symbol, hold, move): the mean absolute log return over each holding period, all in one pass."""
    b = log_returns(bars)
    moves = b.withColumns({f"m{h}": F.abs(roll(F.sum, "r", h)) for h in holds}).groupBy("symbol").agg(*[F.avg(f"m{h}").alias(str(h)) for h in holds])
    return moves.unpivot("symbol", [str(h) for h in holds], "hold", "move").withColumn("hold", F.col("hold").cast("int"))


def budget(moves: DataFrame, accuracies: list[float], rate: float = RATE) -> DataFrame:
    """What a directional bet must win: for each hold the accuracy needed, and the edge at given accuracies."""
    trip = 2 * rate
    acc = F.explode(F.array(*[F.lit(a) for a in accuracies]))
    b = moves.withColumn("needed", F.lit(0.5) + safe_div(F.lit(trip), 2 * F.col("move"))).withColumn("accuracy", acc)
    return b.withColumn("edge", (2 * F.col("accuracy") - 1) * F.col("move") - trip)
