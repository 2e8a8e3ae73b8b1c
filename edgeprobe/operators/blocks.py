"""Histories in blocks of time, so that a symbol's rows are spread over tasks.

What has to be known at the beginning of a block is told by earlier blocks: a block is boiled down to one row, a prefix
pass over a symbol's blocks makes of these what each block starts from, and the rows of a block are joined with it.  A block is a number of whole days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Days of a block: 720 hour bars.
DAYS = 30


def block_of(ts: str | Column, days: int = DAYS) -> Column:
    """The block of a time."""
    return F.floor(F.datediff(ts, F.lit("1970-01-01").cast("date")) / F.lit(days))


def inside(by: list[str], *order: str) -> WindowSpec:
    """The rows of a block up to the current one."""
    return Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def before(blocks: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, _block, value): from a row for each block, the latest value that isn't null of the blocks before it."""
    w = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(*by, "_block", F.last(value, ignorenulls=True).over(w).alias(value))


def with_previous(rows: DataFrame, columns: list[str], by: list[str], order: str = "ts") -> DataFrame:
    """Add ``_prev`` (a struct): the columns of the row before, be it in the same block or an earlier one."""
    w = Window.partitionBy(*by, "_block").orderBy(order)
    own = F.struct(*columns)
    last = rows.groupBy(*by, "_block").agg(F.max_by(own, order).alias("_carried"))
    out = rows.join(before(last, "_carried", by), [*by, "_block"], "left")
    return out.withColumn("_prev", F.coalesce(F.lag(own).over(w), "_carried")).drop("_carried")
