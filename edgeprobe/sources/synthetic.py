"""Synthetic bars without any edge (or with a known one), for controls."""

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ConfigError

#: Seconds between bars of each spacing.
SPACING = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "2h": 7200, "4h": 14_400, "6h": 21_600, "12h": 43_200, "1d": 86_400, "1w": 604_800}


def _normal(*parts):
    """A standard normal number from hashes of the parts (Box-Muller): the same on every run and partitioning."""
    u = lambda salt: (F.pmod(F.xxhash64(*parts, F.lit(salt)), F.lit(2**52)) + 0.5) / F.lit(2.0**52)
    return F.sqrt(-2 * F.ln(u(1))) * F.cos(u(2) * 6.283185307179586)


def random_walk(spark: SparkSession, n: int, symbols: int = 1, interval: str = "1h", sigma: float = 0.004, seed: int = 0, edge: float = 0.0) -> DataFrame:
    """``symbols`` series of ``n`` bars; ``edge`` is the share of the last bar's return that comes again (autoregression of order one).

    Such a return is a sum of past shocks with falling weights, summed as far back as they count in double precision.
    """
    if interval not in SPACING:
        raise ConfigError(f"unknown interval {interval!r}")
    if not -1 < edge < 1:
        raise ConfigError("edge must be between -1 and 1")
    b = spark.range(n * symbols).select(F.concat(F.lit("SYN"), (F.col("id") % symbols).cast("string")).alias("symbol"), F.floor(F.col("id") / symbols).alias("k"))
    w = Window.partitionBy("symbol").orderBy("k")
    b = b.withColumn("e", _normal(F.lit(seed), "symbol", "k") * sigma)
    back = math.ceil(math.log(1e-18) / math.log(abs(edge))) if edge else 0
    shocks = F.collect_list("e").over(w.rowsBetween(-back, 0))
    b = b.withColumn("r", F.aggregate(shocks, F.lit(0.0), lambda r, e: r * edge + e) if edge else F.col("e"))
    b = b.withColumn("close", 30_000 * F.exp(F.sum("r").over(w.rowsBetween(Window.unboundedPreceding, 0)))).withColumn("open", F.coalesce(F.lag("close").over(w), F.lit(30_000.0)))
    reach = lambda salt: F.abs(_normal(F.lit(seed + salt), "symbol", "k")) * sigma / 2
    return b.select(
        "symbol",
        F.timestamp_seconds(F.lit(1_577_836_800) + F.col("k") * SPACING[interval]).cast("timestamp_ntz").alias("ts"),
        "open",
        (F.greatest("open", "close") * F.exp(reach(1))).alias("high"),
        (F.least("open", "close") * F.exp(-reach(2))).alias("low"),
        "close",
        (100 * F.exp(_normal(F.lit(seed + 3), "symbol", "k") / 2)).alias("volume"),
        F.floor(1000 * F.exp(_normal(F.lit(seed + 4), "symbol", "k") / 2)).cast("double").alias("trades"),
    )


def funding(bars: DataFrame, seed: int = 0) -> DataFrame:
    """A rate every eight hours over the bars' span."""
    span = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    t = span.select("symbol", F.explode(F.sequence("a", "b", F.make_dt_interval(hours=F.lit(8)))).alias("ts"))
    return t.withColumn("funding_rate", 1e-4 + 3e-4 * _normal(F.lit(seed), "symbol", F.col("ts").cast("string"))).withColumn("funding_hours", F.lit(8.0))


def metrics(bars: DataFrame, seed: int = 0) -> DataFrame:
    """Hourly open interest, a random walk with drift, and positioning ratios that are noise, over the bars' span and an hour more."""
    span = bars.groupBy("symbol").agg(F.min("ts").alias("a"), (F.max("ts") + F.make_dt_interval(hours=F.lit(1))).alias("b"))
    t = span.select("symbol", F.posexplode(F.sequence("a", "b", F.make_dt_interval(hours=F.lit(1)))).alias("k", "ts"))
    noise = lambda salt: _normal(F.lit(seed + 202 + salt), "symbol", "k")
    walk = F.sum(0.0002 + 0.01 * noise(0)).over(Window.partitionBy("symbol").orderBy("k"))
    t = t.withColumn("open_interest", 1e5 * F.exp(walk))
    ratio = lambda mean, spread, salt: F.abs(mean + spread * noise(salt))
    return t.select(
        "symbol",
        "ts",
        "open_interest",
        (F.col("open_interest") * 30_000).alias("oi_value"),
        ratio(2.5, 0.4, 1).alias("top_trader_accounts_ls"),
        ratio(1.2, 0.2, 2).alias("top_trader_positions_ls"),
        ratio(2.0, 0.3, 3).alias("all_accounts_ls"),
        ratio(1.0, 0.2, 4).alias("taker_buy_sell_ratio"),
    )
