"""As-of join: the latest auxiliary row strictly before a bar's close."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks


def asof_strict(bars: DataFrame, aux: DataFrame, columns: list[str], bar_seconds: int, days: int = blocks.DAYS) -> DataFrame:
    """Add ``columns`` of the latest row of ``aux`` (symbol, ts, ...) with ts < bar's ts + ``bar_seconds``.

    Both sides are put in one order by time, a bar before an auxiliary row of the same time, and the latest
    auxiliary row is carried along whole, so its own missing values stay missing; of several at one time it is the one with the
    largest values.  A symbol's history is cut into blocks of ``days``: a task carries rows along within its blocks only, and a block begins
    with the last auxiliary row of the blocks before it, which is known from one row for each block.  So no task has a whole symbol and no pairs of rows are made.
    """
    keep = bars.columns
    close = F.col("ts") + F.make_dt_interval(secs=F.lit(bar_seconds))
    kind = aux.select(F.struct(*columns).alias("x")).schema["x"].dataType
    b = bars.select(F.col("symbol").alias("_s"), close.alias("_t"), F.lit(0).alias("_tag"), F.struct(*keep).alias("_bar"), F.lit(None).cast(kind).alias("_aux"))
    a = aux.select(F.col("symbol").alias("_s"), F.col("ts").alias("_t"), F.lit(1).alias("_tag"), F.lit(None).cast(b.schema["_bar"].dataType).alias("_bar"), F.struct(*columns).alias("_aux"))
    both = b.unionByName(a).withColumn("_block", blocks.block_of("_t", days))
    last = both.groupBy("_s", "_block").agg(F.max_by("_aux", F.when(F.col("_aux").isNotNull(), F.struct("_t", "_aux"))).alias("_carried"))
    carried = blocks.before(last, "_carried", ["_s"])
    own = both.withColumn("_aux", F.last("_aux", ignorenulls=True).over(blocks.inside(["_s"], "_t", "_tag", "_aux"))).where("_tag = 0")
    out = own.join(carried, ["_s", "_block"], "left").withColumn("_aux", F.coalesce("_aux", "_carried"))
    return out.select("_bar.*", *[F.col(f"_aux.{c}").alias(c) for c in columns])
