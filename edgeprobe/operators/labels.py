"""Labels: y (1, 0 or missing), t_end (the position at which it is known), ret, sigma."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import clip, safe_div, safe_ln
from ..functions.windows import lead, roll
from .features import log_returns

COLUMNS = ("y", "t_end", "ret", "sigma")


def positions(bars: DataFrame) -> DataFrame:
    """Add ``pos`` (from 0) and ``n`` (the symbol's bars)."""
    w = Window.partitionBy("symbol")
    return bars.withColumn("pos", (F.row_number().over(w.orderBy("ts")) - 1).cast("bigint")).withColumn("n", F.count("*").over(w))


def _base(bars: DataFrame, window: int) -> DataFrame:
    return positions(log_returns(bars)).withColumn("sigma", roll(F.stddev_samp, "r", window))


def next_bar_sign(bars: DataFrame, window: int = 72) -> DataFrame:
    """1 if the next close is higher."""
    b = _base(bars, window).withColumn("ret", lead("r"))
    return b.withColumn("y", F.when(F.col("ret") > 0, 1.0).when(F.col("ret").isNotNull(), 0.0)).withColumn("t_end", F.least(F.col("pos") + 1, F.col("n") - 1))


def forward_return(bars: DataFrame, horizon: int = 24, window: int = 72, deadband: float = 0.5) -> DataFrame:
    """Sign of the return over ``horizon`` bars, where it is over ``deadband`` standard deviations."""
    b = _base(bars, window).withColumn("ret", lead("lc", horizon) - F.col("lc"))
    scaled = safe_div(F.col("ret"), F.col("sigma") * F.lit(horizon**0.5))
    b = b.withColumn("y", F.when(scaled > deadband, 1.0).when(scaled < -deadband, 0.0))
    return b.withColumn("t_end", F.least(F.col("pos") + horizon, F.col("n") - 1))


def triple_barrier(bars: DataFrame, horizon: int = 24, window: int = 72, upper: float = 1.5, lower: float = 1.5) -> DataFrame:
    """Which of two barriers is touched first within ``horizon`` bars; the lower wins ties, else the sign of the return.

    A window of the next ``horizon`` highs and lows is searched within the row: one sort by symbol, no self-join.
    """
    ahead = Window.partitionBy("symbol").orderBy("ts").rowsBetween(1, horizon)
    b = _base(bars, window).withColumn("_next", F.collect_list(F.struct("low", "high", "lc")).over(ahead))
    top, floor = F.col("close") * F.exp(upper * F.col("sigma")), F.col("close") * F.exp(-lower * F.col("sigma"))
    b = b.withColumn("_top", top).withColumn("_floor", floor)
    hits = F.transform("_next", lambda x, i: F.when(x["low"] <= F.col("_floor"), F.struct(i.alias("i"), F.lit(-1).alias("side"))).when(x["high"] >= F.col("_top"), F.struct(i.alias("i"), F.lit(1).alias("side"))))
    b = b.withColumn("_hit", F.get(F.filter(hits, lambda h: h.isNotNull()), F.lit(0)))
    b = b.withColumn("t_end", F.coalesce(F.col("pos") + F.col("_hit.i") + 1, F.least(F.col("pos") + horizon, F.col("n") - 1)))
    step = F.col("t_end") - F.col("pos")
    b = b.withColumn("ret", F.when(step > 0, F.get("_next", (step - 1).cast("int"))["lc"] - F.col("lc")).otherwise(0.0))
    side = F.col("_hit.side")
    y = F.when(side > 0, 1.0).when(side < 0, 0.0).when(F.col("ret") > 0, 1.0).otherwise(0.0)
    known = (F.col("pos") + horizon < F.col("n")) & F.col("sigma").isNotNull()
    return b.withColumn("y", F.when(known, y)).drop("_next", "_top", "_floor", "_hit")


def relative(panel: DataFrame, horizon: int = 5) -> DataFrame:
    """Whether a symbol does better than the median of its time; ``panel`` has lo (log open) at every (symbol, time_pos)."""
    b = panel.withColumn("fwd", lead("lo", 1 + horizon, order="time_pos") - lead("lo", 1, order="time_pos"))
    mid = F.median("fwd").over(Window.partitionBy("time_pos"))
    return b.withColumn("mid", mid).withColumn("y", F.when(F.col("fwd").isNotNull(), (F.col("fwd") > F.col("mid")).cast("double")))


def meta(rows: DataFrame, side: str) -> DataFrame:
    """Whether following ``side`` would have paid."""
    ok = (F.col(side) != 0) & F.col("ret").isNotNull() & F.col("y").isNotNull()
    return rows.withColumn("meta_y", F.when(ok, (F.col(side) * F.col("ret") > 0).cast("double")))


BUILDERS = {"next_bar_sign": next_bar_sign, "fwd_return": forward_return, "triple_barrier": triple_barrier}
