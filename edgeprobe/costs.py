"""What trading costs and how long a position must be held to pay for it, on the driver or from measured moves."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions.windows import bars_window
from .operators.features import log_returns
from .sources.shared import materialised, removed


def expected_move(sigma: float, hold: float) -> float:
    """Mean absolute return of a driftless normal walk over ``hold`` bars."""
    return sigma * math.sqrt(hold) * math.sqrt(2 / math.pi)


def round_trip(fee_bps: float = 10.0, slippage_bps: float = 2.0) -> float:
    return 2 * (fee_bps + slippage_bps) / 1e4


def required_accuracy(sigma: float, hold: float, trip: float) -> float:
    """The share of right calls that pays the costs; over 1 if none does."""
    move = expected_move(sigma, hold)
    return 0.5 * (1 + trip / move) if move > 0 else math.inf


def breakeven_hold(sigma: float, accuracy: float, trip: float) -> float:
    """Bars to hold at an accuracy until a normal walk's move pays the costs."""
    edge = 2 * accuracy - 1
    return (trip / (edge * sigma * math.sqrt(2 / math.pi))) ** 2 if edge > 0 and sigma > 0 else math.inf


def measured_breakeven(bars: DataFrame, accuracy: float, trip: float, most: int = 8760, levels: int = 4) -> DataFrame:
    """(symbol, hold): the least hold, by bisection, whose measured mean move pays the costs; NULL if up to ``most`` none does.

    The bars are read once, into prefix sums of their returns; a move over h bars is a difference of two of these.  Every symbol is bisected at
    the same time, and a round measures all holds that the next ``levels`` halvings may ask for, so a year of hours takes five rounds of one
    join by symbol and place.  A hold longer than the history has no measured move, and counts as one that pays.
    """
    spark, edge = bars.sparkSession, 2 * accuracy - 1
    w = bars_window().rowsBetween(Window.unboundedPreceding, 0)
    sums = log_returns(bars).select("symbol", F.row_number().over(bars_window()).alias("at"), F.coalesce(F.sum("r").over(w), F.lit(0.0)).alias("upto"), F.count("r").over(w).alias("n"))
    sums = materialised(sums, "returns", paths := [])
    symbols = [r[0] for r in sums.select("symbol").distinct().collect()]  # one search state for each symbol
    known: dict[tuple, float] = {}

    def measure(holds: dict[str, set[int]]) -> None:
        asked = [(s, h) for s, own in holds.items() for h in own]
        ends = sums.join(spark.createDataFrame(asked, "symbol string, hold int"), "symbol")
        starts = sums.select("symbol", F.col("at").alias("from"), F.col("upto").alias("before"), F.col("n").alias("n_before"))
        both = ends.withColumn("from", F.col("at") - F.col("hold")).join(starts, ["symbol", "from"]).where("n - n_before = hold")
        known.update({(r[0], r[1]): r[2] for r in both.groupBy("symbol", "hold").agg(F.avg(F.abs(F.col("upto") - F.col("before")))).collect()})

    def pays(symbol: str, hold: int) -> bool:
        return (symbol, hold) not in known or edge * known[symbol, hold] >= trip

    def middles(low: int, high: int, deep: int) -> set[int]:
        m = (low + high) // 2
        return {m} | middles(low, m, deep - 1) | middles(m, high, deep - 1) if deep and high - low > 1 else set()

    found: dict[str, int | None] = dict.fromkeys(symbols)
    if edge > 0 and symbols:
        measure({s: {1, most} for s in symbols})
        found |= {s: 1 for s in symbols if pays(s, 1)}
        spans = {s: (1, most) for s in symbols if not pays(s, 1) and pays(s, most)}
        while open_ := {s: x for s, x in spans.items() if x[1] - x[0] > 1}:
            measure({s: middles(*x, levels) for s, x in open_.items()})
            for s, (low, high) in open_.items():
                for _ in range(levels):
                    if high - low > 1:
                        m = (low + high) // 2
                        low, high = (low, m) if pays(s, m) else (m, high)
                spans[s] = low, high
        found |= {s: x[1] for s, x in spans.items()}
    removed(spark, paths)
    return spark.createDataFrame(list(found.items()), "symbol string, hold int")


def duration(hours: float) -> str:
    """A time to hold in words."""
    if not math.isfinite(hours):
        return "never"
    if hours < 48:
        return f"{hours:.1f} hours"
    return f"{hours / 24:.1f} days" if hours < 90 * 24 else f"{hours / 24 / 30.4:.1f} months"


def warnings(horizon: int, min_hold: int, sigma: float, trip: float) -> list[str]:
    """Configurations whose backtest would mean nothing: label and hold that don't go together, costs that can't be paid."""
    out, hold = [], max(min_hold, 1)
    if hold > 4 * horizon or horizon > 4 * hold:
        out.append(f"the label looks {horizon} bars ahead, but positions are held for {hold}")
    need = required_accuracy(sigma, hold, trip)
    if need > 0.56:
        what = "can't be profitable" if need > 1 else f"needs {need:.1%} right calls"
        out.append(f"a hold of {hold} bars {what}; at 52% it would take {breakeven_hold(sigma, 0.52, trip):,.0f} bars")
    return out


def sigma(bars: DataFrame) -> float:
    """Standard deviation of log returns of all bars given."""
    return log_returns(bars).agg(F.stddev_samp("r")).first()[0] or 0.0
