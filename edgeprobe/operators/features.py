"""Point-in-time features: 32 of the bars and 14 of funding and positioning."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import finite, safe_div, safe_ln
from ..functions.windows import lag, roll, skew, zscore
from . import scans
from .blocks import block_of, with_previous


def log_returns(bars: DataFrame) -> DataFrame:
    """Add ``lc`` (log close) and ``r`` (its change)."""
    return bars.withColumn("lc", safe_ln("close")).withColumn("r", F.col("lc") - lag("lc"))


def momentum(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"ret_{n}": roll(F.sum, "r", n) for n in (1, 2, 3, 6, 12, 24, 72)})


def volatility(rows: DataFrame) -> DataFrame:
    out = rows.withColumns({f"vol_{n}": roll(F.stddev_samp, "r", n) for n in (12, 24, 72, 168)})
    return out.withColumn("volratio", safe_div("vol_12", "vol_168"))


def stretch(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"z_{n}": zscore("close", n) for n in (12, 24, 72, 168)})


def channel(rows: DataFrame) -> DataFrame:
    place = lambda n: safe_div(F.col("close") - roll(F.min, "low", n), roll(F.max, "high", n) - roll(F.min, "low", n))
    return rows.withColumns({f"donch_{n}": place(n) for n in (24, 72)})


def shape(rows: DataFrame) -> DataFrame:
    span = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    return rows.withColumns(
        {
            "hl_range": span / F.col("close"),
            "upper_wick": (F.col("high") - F.greatest("open", "close")) / span,
            "lower_wick": (F.least("open", "close") - F.col("low")) / span,
            "body": (F.col("close") - F.col("open")) / span,
        }
    )


def flow(rows: DataFrame, n: int = 72) -> DataFrame:
    out = rows.withColumn("_size", safe_div("volume", "trades")).withColumn("_impact", safe_div(F.abs("r"), F.col("volume")))
    found = {"vol_z": "volume", "trade_z": "trades", "avg_trade": "_size", "amihud": "_impact"}
    return out.withColumns({name: finite(zscore(x, n)) for name, x in found.items()}).drop("_size", "_impact")


def higher(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ret_skew_72", skew("r", 72))


def calendar(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hour", F.hour("ts").cast("double")).withColumn("dow", F.weekday("ts").cast("double"))


def smoothed(rows: DataFrame) -> DataFrame:
    """(symbol, ts, rsi_14, atr_pct, macd_n): recursive means, folded over blocks of time without a Python call.

    The signal line is a mean of a mean; with weights a and b it is a fixed combination of the two simple means, as both begin at the first close.
    """
    b = rows.select("symbol", "ts", "high", "low", "close").withColumn("_block", block_of("ts"))
    b = with_previous(b, ["close"], ["symbol"])
    before, change = F.col("_prev.close"), F.col("close") - F.col("_prev.close")
    rise, fall = (F.when(x > 0, x).when(x.isNotNull(), 0.0) for x in (change, -change))
    reach = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    b = b.withColumns({"_rise": rise, "_fall": fall, "_reach": reach}).drop("_prev")
    fast, slow, signal = 2 / 13, 2 / 27, 2 / 10
    m = scans.means(b, {"_u": ("_rise", 1 / 14), "_d": ("_fall", 1 / 14), "_a": ("_reach", 1 / 14), "_f": ("close", fast), "_s": ("close", slow), "_g": ("close", signal)})
    line = lambda mean, a: (F.lit(signal * (1 - a)) * F.col(mean) - F.lit(a * (1 - signal)) * F.col("_g")) / F.lit(signal - a)
    moved = F.col("_u") + F.col("_d")
    return m.select(
        "symbol", "ts",
        F.when(moved == 0, 50.0).otherwise(safe_div(100 * F.col("_u"), moved)).alias("rsi_14"),
        safe_div("_a", "close").alias("atr_pct"),
        safe_div(F.col("_f") - F.col("_s") - (line("_f", fast) - line("_s", slow)), F.col("close")).alias("macd_n"),
    )


def build(bars: DataFrame, with_smoothed: bool = True) -> DataFrame:
    """All 32; the native ones share one ordering, hence one sort."""
    out = log_returns(bars)
    for part in (momentum, volatility, stretch, channel, shape, flow, higher, calendar):
        out = part(out)
    return out.join(smoothed(bars), ["symbol", "ts"]) if with_smoothed else out


def funding(rows: DataFrame, rate: str = "funding_rate") -> DataFrame:
    """Five features of a funding rate that has been joined as of the bar's close."""
    out = rows.withColumn("funding", F.col(rate))
    return out.withColumns(
        {"funding_ma_3": roll(F.avg, rate, 3), "funding_ma_21": roll(F.avg, rate, 21), "funding_z": zscore(rate, 90), "funding_cum_7d": roll(F.sum, rate, 42)}
    )


def positioning(rows: DataFrame) -> DataFrame:
    """Nine features of open interest, long/short ratios and taker flow; those whose columns are missing are left out."""
    out, has = rows, set(rows.columns)
    if "open_interest" in has:
        out = out.withColumn("_oi", safe_ln("open_interest")).withColumn("_lc", safe_ln("close"))
        out = out.withColumns({"oi_chg_6": F.col("_oi") - lag("_oi", 6), "oi_chg_24": F.col("_oi") - lag("_oi", 24), "oi_z": zscore("_oi", 168)})
        out = out.withColumn("oi_price_div", F.signum("oi_chg_24") * F.signum(F.col("_lc") - lag("_lc", 24))).drop("_oi", "_lc")
    if "all_accounts_ls" in has:
        out = out.withColumn("ls_accounts", F.col("all_accounts_ls"))
    if "top_trader_positions_ls" in has:
        out = out.withColumn("ls_top_positions", F.col("top_trader_positions_ls"))
    if {"all_accounts_ls", "top_trader_positions_ls"} <= has:
        out = out.withColumn("ls_spread", F.col("top_trader_positions_ls") - F.col("all_accounts_ls"))
    if "taker_buy_sell_ratio" in has:
        out = out.withColumn("taker_ratio", F.col("taker_buy_sell_ratio")).withColumn("taker_z", zscore("taker_buy_sell_ratio", 72))
    return out
