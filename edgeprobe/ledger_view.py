"""What the ledger holds, in one table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import ledger


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """(command, runs, configurations, killed, without_variants)."""
    g = ledger.load(spark, folder).groupBy("command")
    return g.agg(F.count("*").alias("runs"), F.count_distinct("config_hash").alias("configurations"), F.count_if(F.col("verdict") == "KILLED").alias("killed"), F.count_if(F.col("variants").isNull()).alias("without_variants"))
