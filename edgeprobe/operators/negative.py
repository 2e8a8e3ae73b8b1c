"""A pair that every check must tell apart: a backtest that leaks in two ways, and the same done honestly."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import lag, running
from . import execution
from .features import log_returns


def label_leaky(bars: DataFrame) -> DataFrame:
    """Whether this bar rose, which ``ret_1`` says as well; ``y``."""
    return log_returns(bars).withColumn("y", F.coalesce((F.col("r") > 0).cast("int"), F.lit(0)))


def backtest_leaky(bars: DataFrame) -> DataFrame:
    """Long in every bar that rose, filled for nothing at the close before it: ``equity``."""
    b = log_returns(bars).withColumn("pos", F.coalesce((F.col("r") > 0).cast("double"), F.lit(0.0)))
    return b.withColumn("net", F.col("pos") * F.coalesce("r", F.lit(0.0))).withColumn("equity", F.exp(running(F.sum, "net")))


def backtest_honest(bars: DataFrame, rate: float = execution.RATE) -> DataFrame:
    """The same rule known at the close, filled at the next open and paid for."""
    b = bars.withColumn("pos", F.coalesce((F.col("close") > lag("close")).cast("double"), F.lit(0.0)))
    return execution.backtest(b, rate)
