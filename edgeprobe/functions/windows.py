"""Windows over one symbol's bars.  Every frame ends at the current row, so nothing looks ahead."""

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .nulls import finite, safe_div


def bars_window(by: str | list[str] = "symbol", order: str = "ts") -> WindowSpec:
    return Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(order)


def roll(f, x: str, rows: int, by="symbol", order="ts", least: int | None = None) -> Column:
    """f over the last ``rows`` bars; NULL unless ``least`` (all, by default) of them have a value."""
    w = bars_window(by, order).rowsBetween(-(rows - 1), 0)
    return F.when(F.count(x).over(w) >= (rows if least is None else least), f(F.col(x)).over(w))


def zscore(x: str, rows: int, by="symbol", order="ts") -> Column:
    return safe_div(F.col(x) - roll(F.avg, x, rows, by, order), roll(F.stddev_samp, x, rows, by, order))


def skew(x: str, rows: int, by="symbol", order="ts") -> Column:
    """Sample skewness with the small-sample correction."""
    return finite(roll(F.skewness, x, rows, by, order)) * ((rows * (rows - 1)) ** 0.5 / (rows - 2))


def lag(x: str, k: int = 1, by="symbol", order="ts") -> Column:
    return F.lag(x, k).over(bars_window(by, order))


def lead(x: str, k: int = 1, by="symbol", order="ts") -> Column:
    return F.lead(x, k).over(bars_window(by, order))


def running(f, x: str, by="symbol", order="ts") -> Column:
    return f(F.col(x)).over(bars_window(by, order).rowsBetween(Window.unboundedPreceding, 0))


def last_known(x: str, by="symbol", order="ts") -> Column:
    """The latest value so far."""
    return F.last(x, ignorenulls=True).over(bars_window(by, order).rowsBetween(Window.unboundedPreceding, 0))


def mean_rank(partition: list[str], x: str) -> Column:
    """Rank among the non-missing values of the partition, ties averaged; NULL for NULL."""
    w = Window.partitionBy(*partition)
    ties = F.count(x).over(Window.partitionBy(*partition, x))
    return F.when(F.col(x).isNotNull(), F.rank().over(w.orderBy(F.col(x).asc_nulls_last())) + (ties - 1) / 2)
