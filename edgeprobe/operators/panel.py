"""Panels in long form: ranks, screens, books and their returns, with (symbol, time_pos) as the key."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import safe_div, safe_ln
from ..functions.windows import lead, mean_rank, roll
from ..errors import InsufficientDataError
from ..sources import bars as src
from ..sources.shared import materialised
from . import labels
from .asof import asof_strict
from .execution import RATE


def at_time():
    """All symbols of one time."""
    return Window.partitionBy("time_pos")


def load(bars: DataFrame, build, features: list[str], end: str, horizon: int = 6, top_n: int | None = None, window: int = 180, least_bars: int = 500) -> tuple[DataFrame, DataFrame]:
    """((ts, symbol, time_pos, ranked features, y, prices), (symbol, last_ts) of the dead).

    Symbols need ``least_bars``; with ``top_n`` what isn't among the most traded of its time, by volume in money so far, has
    neither features nor returns.  Features are of each symbol's own bars, then ranked among the symbols of a time.
    """
    long_enough = bars.groupBy("symbol").count().where(F.col("count") >= least_bars)
    if long_enough.limit(3).count() < 3:
        raise InsufficientDataError("a cross-section needs at least 3 symbols with enough bars")
    dead = src.delisted_by_bars(bars, end, least_bars)
    bars = materialised(bars.join(long_enough.select("symbol"), "symbol", "left_semi"), "bars")
    grid = prices(src.dense(bars))
    if top_n:
        money = liquidity_screen(grid.withColumn("volume", F.col("volume") * F.col("close")), top_n, window, max(1, window // 3))
        grid = money.withColumn("ret_next", F.when(F.col("in_screen"), F.col("ret_next"))).withColumn("alive", F.col("ret_next").isNotNull())
    else:
        grid = grid.withColumn("in_screen", F.lit(True))
    grid = materialised(labels.relative(grid, horizon).select("ts", "symbol", "time_pos", "open", "close", "lo", "volume", "ret_next", "alive", "in_screen", "y"), "panel")
    own = build(bars).select("ts", "symbol", *features).join(grid.where("in_screen").select("ts", "symbol"), ["ts", "symbol"], "left_semi")
    ranks = rank_pct(own, features).groupBy("ts", "symbol").pivot("feature", features).agg(F.first("rank"))
    return grid.join(ranks, ["ts", "symbol"], "left"), dead


def prices(dense: DataFrame) -> DataFrame:
    """Add lo (log open), ret_next (what a position decided now earns) and alive."""
    b = dense.withColumn("lo", safe_ln("open"))
    b = b.withColumn("ret_next", lead("lo", 2, order="time_pos") - lead("lo", 1, order="time_pos"))
    return b.withColumn("alive", F.col("ret_next").isNotNull())


def funding_per_bar(panel: DataFrame, funding: DataFrame, bar_seconds: int) -> DataFrame:
    """Add ``funding``: the rate known at a bar's close, paid every eight hours, as far as a bar goes; 0 where none is known."""
    out = asof_strict(panel, funding, ["funding_rate"], bar_seconds)
    return out.withColumn("funding", F.coalesce(F.col("funding_rate") * F.lit(bar_seconds / 28_800), F.lit(0.0))).drop("funding_rate")


def rank_pct(panel: DataFrame, features: list[str], least: int = 3) -> DataFrame:
    """(ts, symbol, feature, rank): average-tie rank over the number of values; times with few symbols are left out.

    Many features take one window: they are rows, not columns.
    """
    rows = panel.unpivot(["ts", "symbol"], features, "feature", "value")
    w = Window.partitionBy("ts", "feature")
    rows = rows.withColumn("rank", mean_rank(["ts", "feature"], "value") / F.count("value").over(w)).withColumn("_n", F.count("value").over(w))
    return rows.where(F.col("_n") >= least).select("ts", "symbol", "feature", "rank")


def liquidity_screen(panel: DataFrame, top_n: int, window: int, least: int) -> DataFrame:
    """Add trail (mean volume so far) and in_screen: among the ``top_n`` by average-tie rank of their time."""
    b = panel.withColumn("trail", roll(F.avg, "volume", window, order="time_pos", least=least))
    b = b.withColumn("_neg", -F.col("trail"))
    return b.withColumn("volume_rank", mean_rank(["time_pos"], "_neg")).withColumn("in_screen", F.coalesce(F.col("volume_rank") <= top_n, F.lit(False))).drop("_neg")


def neutralise(weights: DataFrame, w: str = "w", allow_short: bool = True) -> DataFrame:
    """Each side over its gross; without both sides (or the long one, if alone) the whole time is flat."""
    up = F.sum(F.greatest(F.col(w), F.lit(0.0))).over(at_time())
    down = F.sum(F.greatest(-F.col(w), F.lit(0.0))).over(at_time())
    b = weights.withColumn("_up", up).withColumn("_down", down)
    if not allow_short:
        return b.withColumn(w, F.when(F.col("_up") > 0, F.col(w) / F.col("_up")).otherwise(0.0)).drop("_up", "_down")
    both = (F.col("_up") > 0) & (F.col("_down") > 0)
    out = F.when(both & (F.col(w) > 0), F.col(w) / F.col("_up")).when(both & (F.col(w) < 0), F.col(w) / F.col("_down")).otherwise(0.0)
    return b.withColumn(w, out).drop("_up", "_down")


def top_book(panel: DataFrame, score: str, k: int = 3, rebalance: int = 42, allow_short: bool = True) -> DataFrame:
    """Long the k best, short the k worst at every rebalance; ties go to the symbol that sorts first.

    A rebalance with fewer than 2k scores keeps the last book.  In between the book is held by symbols that are alive,
    each side at unit gross.
    """
    n = F.count(score).over(at_time())
    best = F.row_number().over(at_time().orderBy(F.col(score).desc_nulls_last(), "symbol"))
    worst = F.row_number().over(at_time().orderBy(F.col(score).asc_nulls_last(), F.desc("symbol")))
    chosen = F.when(F.col(score).isNull(), 0.0).when(best <= k, 1.0 / k).when(F.lit(allow_short) & (worst <= k), -1.0 / k).otherwise(0.0)
    b = panel.withColumn("_w", F.when((F.col("time_pos") % rebalance == 0) & (n >= 2 * k), chosen))
    past = Window.partitionBy("symbol").orderBy("time_pos").rowsBetween(Window.unboundedPreceding, 0)
    held = F.coalesce(F.last("_w", ignorenulls=True).over(past), F.lit(0.0))
    return neutralise(b.withColumn("w", F.when(F.col("alive"), held).otherwise(0.0)).drop("_w"), "w", allow_short)


def equal_book(panel: DataFrame, rebalance: int = 42) -> DataFrame:
    """1/alive at every rebalance; a symbol that dies is out until the next."""
    b = panel.withColumn("_block", F.floor(F.col("time_pos") / rebalance)).withColumn("_live", F.col("alive").cast("int"))
    share = F.when(F.col("alive"), safe_div(F.lit(1.0), F.sum("_live").over(at_time()).cast("double"))).otherwise(0.0)
    in_block = Window.partitionBy("symbol", "_block").orderBy("time_pos")
    b = b.withColumn("_share", share).withColumn("_first", F.first("_share").over(in_block))
    still = F.min("_live").over(in_block.rowsBetween(Window.unboundedPreceding, 0))
    return b.withColumn("w", F.col("_first") * still).drop("_block", "_live", "_share", "_first")


def static_book(panel: DataFrame, reference: str) -> DataFrame:
    """Long one symbol, short all others that are alive in equal parts."""
    other = F.col("alive") & (F.col("symbol") != reference)
    n = F.sum(other.cast("int")).over(at_time())
    w = F.when((F.col("symbol") == reference) & F.col("alive"), 1.0).when(other, -1.0 / n).otherwise(0.0)
    return panel.withColumn("w", w)


def only_book(panel: DataFrame, reference: str) -> DataFrame:
    return panel.withColumn("w", F.when((F.col("symbol") == reference) & F.col("alive"), 1.0).otherwise(0.0))


def backtest(book: DataFrame, rate: float = RATE, funding: str | None = None, by: list[str] | None = None, extra: Column | None = None) -> DataFrame:
    """(time_pos, ts, gross, turnover, cost, pos, net, equity): sums over symbols, then one running sum over times.

    The running sum has as many rows as there are times, the symbols being combined map-side before.
    """
    keys = by or []
    own = Window.partitionBy(*keys, "symbol").orderBy("time_pos")
    b = book.withColumn("_turn", F.abs(F.col("w") - F.coalesce(F.lag("w").over(own), F.lit(0.0))))
    paid = F.col("w") * F.coalesce(F.col(funding), F.lit(0.0)) if funding else F.lit(0.0)
    g = b.groupBy(*keys, "time_pos", "ts").agg(
        F.sum(F.col("w") * F.coalesce("ret_next", F.lit(0.0))).alias("gross"), F.sum("_turn").alias("turnover"), F.sum(paid).alias("_paid"), F.sum(F.abs("w")).alias("pos")
    )
    g = g.withColumn("cost", F.col("turnover") * (rate if extra is None else extra) + F.col("_paid")).withColumn("net", F.col("gross") - F.col("cost")).drop("_paid")
    return g.withColumn("equity", F.exp(F.sum("net").over(Window.partitionBy(*keys).orderBy("time_pos").rowsBetween(Window.unboundedPreceding, 0))))
