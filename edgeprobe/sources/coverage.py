"""What an archive of bars covers: months that are missing, symbols that are too few to fetch, universes that differ."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataUnavailableError


def read_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """Parquet without the files that can't be read."""
    return spark.read.option("ignoreCorruptFiles", True).parquet(path)


def months(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", F.date_format("ts", "yyyy-MM").alias("month")).distinct()


def missing_months(bars: DataFrame) -> DataFrame:
    """(symbol, month) between a symbol's first and last bar that has none: a calendar less what is there."""
    span = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    first = lambda c: F.trunc(F.col(c).cast("date"), "month")
    plan = span.select("symbol", F.explode(F.sequence(first("a"), first("b"), F.make_ym_interval(F.lit(0), F.lit(1)))).alias("m"))
    return plan.select("symbol", F.date_format("m", "yyyy-MM").alias("month")).join(months(bars), ["symbol", "month"], "left_anti")


def guard(wanted: DataFrame, cached: DataFrame, free: int = 15) -> None:
    """Refuse to fetch more than ``free`` symbols that aren't there yet."""
    n = wanted.select("symbol").distinct().join(cached.select("symbol").distinct(), "symbol", "left_anti").count()
    if n > free:
        raise DataUnavailableError(f"{n} symbols would have to be fetched; the limit is {free}")


def survivorship(traded: DataFrame, universe: DataFrame, delisted: DataFrame) -> DataFrame:
    """One row: symbols traded, of the universe but not traded, traded and later delisted, and whether any of the dead is in."""
    n = traded.agg(F.count_distinct("symbol").alias("traded"))
    left = universe.select("symbol").distinct().join(traded.select("symbol").distinct(), "symbol", "left_anti").agg(F.count("*").alias("left_out"))
    dead = traded.select("symbol").distinct().join(delisted.select("symbol").distinct(), "symbol", "left_semi").agg(F.count("*").alias("dead"))
    return n.crossJoin(left).crossJoin(dead).withColumn("passes", (F.col("dead") > 0) | (F.col("left_out") == 0))  # three rows of counts


def save_metrics(measures: DataFrame, folder: str, name: str) -> str:
    """A small table of measures as a JSON file."""
    path = Path(folder)
    path.mkdir(parents=True, exist_ok=True)
    out = path / f"{name}.json"
    out.write_text(json.dumps([r.asDict() for r in measures.collect()], indent=1, default=str))
    return str(out)
