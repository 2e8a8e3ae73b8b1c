"""Bars from a stream of events, with a watermark for late ones."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Files that arrive in a folder, as (symbol, ts, event_id, price)."""
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return e.where("value > 0").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"))


def stream_bars(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Open, high, low, close, volume and trades of each window; a window is final once the watermark has passed it.

    State is one row for each symbol and open window.
    """
    order = F.struct("ts", "event_id")
    g = events.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w"))
    bars = g.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("price").alias("volume"), F.count("*").cast("double").alias("trades"))
    return bars.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume", "trades")
