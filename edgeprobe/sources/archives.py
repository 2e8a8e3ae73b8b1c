"""Local archives of an exchange: klines, funding and metrics, as CSV or as CSV in a zip file.

The symbol is read from a file's name (``SYMBOL-...``).  Files are read by Spark as binary, a file a row, so they may lie in any
store; each is a month or a day of one symbol, a few megabytes.  Of rows with the same time the first wins, by file name and line.
Files that can't be read are left out; a folder without any gives an empty frame.
"""

from __future__ import annotations

import csv
import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bars import from_epoch, keep_first

# The columns of kline files, which may have no header, and the names that metrics get.
KLINES = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote", "ignore")
METRICS = {
    "sum_open_interest": "open_interest",
    "sum_open_interest_value": "oi_value",
    "count_toptrader_long_short_ratio": "top_trader_accounts_ls",
    "sum_toptrader_long_short_ratio": "top_trader_positions_ls",
    "count_long_short_ratio": "all_accounts_ls",
    "sum_taker_long_short_vol_ratio": "taker_buy_sell_ratio",
}


def _lines(content: bytes, names: tuple[str, ...] | None):
    """The rows of a CSV file, or of the first file in a zip, as dictionaries; ``names`` where there is no header."""
    if content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            content = z.read(z.namelist()[0])
    rows = csv.reader(io.StringIO(content.decode("utf-8", "replace")))
    head = None
    for row in rows:
        if head is None:
            plain = names and row and row[0].strip().isdigit()
            head = list(names) if plain else [c.strip() for c in row]
            if not plain:
                continue
        yield dict(zip(head, row, strict=False))


def _read(spark: SparkSession, path: str, columns: tuple[str, ...], names: tuple[str, ...] | None = None) -> DataFrame:
    """(symbol, file, line, the columns as text) of all files below a path."""

    def run(batches):
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    rows = list(_lines(content.as_py(), names))
                except (zipfile.BadZipFile, IndexError, csv.Error):
                    continue
                symbol = file.rsplit("/", 1)[-1].split("-", 1)[0]
                cells = [pa.array([r.get(c) for r in rows], pa.string()) for c in columns]
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([symbol] * n, pa.string()), pa.array([file] * n, pa.string()), pa.array(range(n), pa.int64()), *cells], names=["symbol", "file", "line", *columns])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{csv,zip}").load(path)
    return files.select("path", "content").mapInArrow(run, f"symbol string, file string, line bigint, {', '.join(f'{c} string' for c in columns)}")


def _number(c: str):
    return F.expr(f"try_cast(trim({c}) as double)")


def klines(spark: SparkSession, path: str) -> DataFrame:
    """Bars of every symbol below a path; times in milliseconds or microseconds."""
    raw = _read(spark, path, KLINES, KLINES).where(F.col("open_time").rlike("^[0-9]+$"))
    cols = [_number(c).alias(c) for c in ("open", "high", "low", "close", "volume", "trades")]
    return keep_first(raw.select("symbol", from_epoch(F.col("open_time").cast("bigint")).alias("ts"), *cols, "file", "line"), ["symbol", "ts"], ["file", "line"]).drop("file", "line")


def funding(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, ts, funding_rate, funding_hours)."""
    raw = _read(spark, path, ("calc_time", "funding_interval_hours", "last_funding_rate")).where(F.col("calc_time").rlike("^[0-9]+$"))
    rows = raw.select("symbol", from_epoch(F.col("calc_time").cast("bigint")).alias("ts"), _number("last_funding_rate").alias("funding_rate"), _number("funding_interval_hours").alias("funding_hours"), "file", "line")
    return keep_first(rows, ["symbol", "ts"], ["file", "line"]).drop("file", "line")


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, ts, open interest and ratios); a column that a file doesn't have is NULL."""
    raw = _read(spark, path, ("create_time", *METRICS))
    rows = raw.select("symbol", F.expr("try_cast(create_time as timestamp_ntz)").alias("ts"), *[_number(c).alias(n) for c, n in METRICS.items()], "file", "line").where("ts is not null")
    return keep_first(rows, ["symbol", "ts"], ["file", "line"]).drop("file", "line")


def before_last_close(aux: DataFrame, bars: DataFrame, seconds: int) -> DataFrame:
    """Auxiliary rows from before the close of their symbol's last bar."""
    end = bars.groupBy("symbol").agg((F.max("ts") + F.make_dt_interval(secs=F.lit(seconds))).alias("_end"))
    return aux.join(end, "symbol").where(F.col("ts") < F.col("_end")).drop("_end")
