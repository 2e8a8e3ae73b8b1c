"""Bars (symbol, ts, open, high, low, close, volume, trades) from tables of events or trades."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.windows import lag
from .shared import materialised


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aggregate_bars(trades: DataFrame, unit: str, order: list[str]) -> DataFrame:
    """Bars of one calendar unit from (symbol, ts, price, size), first and last by ``order``.  One shuffle, combined map-side."""
    key = F.struct(*order)
    return trades.groupBy("symbol", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("ts")).agg(
        F.min_by("price", key).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", key).alias("close"),
        F.sum("size").alias("volume"),
        F.count("*").cast("double").alias("trades"),
    )


def event_bars(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    """Bars of each event type; values of 0 or less have no logarithm and are left out by the scan."""
    e = table(spark, sf_dir, "events").where("value > 0")
    e = e.select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("price"), F.col("value").alias("size"), F.col("ts").alias("at"))
    return aggregate_bars(e, unit, ["at", "event_id"])


def nation_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each supplier nation: unit prices, quantities as volume."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    t = table(spark, sf_dir, "lineitem").select("l_shipdate", *order)
    t = t.join(supplier, t.l_suppkey == supplier.s_suppkey).join(nation, F.col("s_nationkey") == nation.n_nationkey)
    t = t.select(F.col("n_name").alias("symbol"), F.col("l_shipdate").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"), *order)
    return aggregate_bars(t, "day", order)


def integrity(bars: DataFrame) -> DataFrame:
    """Counts of broken rules for each symbol, in one aggregation."""
    bad = lambda c: F.count_if(c)
    low = F.least("open", "high", "low", "close")
    return bars.groupBy("symbol").agg(
        F.count("*").alias("n_bars"),
        bad(F.col("high") < F.greatest("open", "close", "low")).alias("bad_high"),
        bad(F.col("low") > F.least("open", "close", "high")).alias("bad_low"),
        bad(low <= 0).alias("not_positive"),
        (F.count("*") - F.count_distinct("ts")).alias("repeated"),
    )


def gaps(bars: DataFrame, seconds: int) -> DataFrame:
    """How many bars are missing between a symbol's first and last, and in how many gaps."""
    step = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(lag("ts").cast("timestamp"))) / F.lit(1e6 * seconds)
    b = bars.select("symbol", F.greatest(step - 1, F.lit(0.0)).alias("missing"))
    return b.groupBy("symbol").agg(F.sum("missing").cast("bigint").alias("missing"), F.count_if(F.col("missing") > 0).alias("n_gaps"))


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``: an aggregation, so that a hot key is combined before it is shuffled."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")


def from_epoch(column: Column) -> Column:
    """A time from milliseconds or, over 1e15, microseconds."""
    return F.when(column > 1_000_000_000_000_000, F.timestamp_micros(column)).otherwise(F.timestamp_millis(column)).cast("timestamp_ntz")


def universe_as_of(bars: DataFrame, month: str, pattern: str | None = None) -> DataFrame:
    """Symbols that have a bar in a month (``yyyy-MM``), perhaps those that match a pattern as a whole."""
    b = bars.where((F.col("ts") >= F.lit(f"{month}-01").cast("timestamp_ntz")) & (F.col("ts") < F.add_months(F.lit(f"{month}-01").cast("date"), 1).cast("timestamp_ntz")))
    return (b.where(F.col("symbol").rlike(f"^(?:{pattern})$")) if pattern else b).select("symbol").distinct()


def delisted(bars: DataFrame, end: str, grace_months: int = 2) -> DataFrame:
    """Symbols whose last month is before ``end`` less some months of grace, as text."""
    limit = F.date_format(F.add_months(F.lit(f"{end}-01").cast("date"), -grace_months), "yyyy-MM")
    last = bars.groupBy("symbol").agg(F.date_format(F.max("ts"), "yyyy-MM").alias("last_month"))
    return last.where(F.col("last_month") < limit)


def delisted_by_bars(bars: DataFrame, end: str, least: int = 500, days: int = 60) -> DataFrame:
    """(symbol, last_ts) of the symbols with ``least`` bars whose last is more than ``days`` before the first of the month ``end``."""
    limit = F.date_sub(F.lit(f"{end}-01").cast("date"), days).cast("timestamp_ntz")
    last = bars.groupBy("symbol").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    return last.where((F.col("n") >= least) & (F.col("last_ts") < limit)).select("symbol", "last_ts")


#: Most symbols that are broadcast to the times of a panel; more are joined by a shuffle.
SENT_SYMBOLS = 100_000


def dense(bars: DataFrame) -> DataFrame:
    """Every symbol at every time of any symbol, with ``time_pos`` from 0; what has no bar is NULL.

    The bars are written once, as they are used three times.  The grid is as large as the panel itself: each time is
    exploded into the list of symbols, whose number is checked.  Times are numbered over one row for each time.
    """
    bars = materialised(bars, "bars")
    times = bars.select("ts").distinct()
    times = times.withColumn("time_pos", F.row_number().over(Window.orderBy("ts")) - 1)
    symbols = [r["symbol"] for r in bars.select("symbol").distinct().limit(SENT_SYMBOLS + 1).collect()]
    if len(symbols) > SENT_SYMBOLS:
        grid = times.crossJoin(bars.select("symbol").distinct())
    else:
        kind = bars.schema["symbol"].dataType
        listed = F.array(*[F.lit(x).cast(kind) for x in sorted(symbols, key=lambda x: (x is not None, x))]) if symbols else F.array().cast(f"array<{kind.simpleString()}>")
        grid = times.withColumn("symbol", F.explode(listed))
    return grid.join(bars, ["symbol", "ts"], "left")
