"""Rules for missing values, in one place: NULL is the only missing value, never NaN."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x) -> Column:
    """NULL for NaN and infinities."""
    x = _col(x)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def safe_div(a, b) -> Column:
    """a / b; NULL where b is 0 or either is missing."""
    return _col(a) / F.nullif(_col(b), F.lit(0.0))


def safe_ln(x) -> Column:
    """Natural logarithm; NULL for what has none."""
    x = _col(x)
    return F.when(x > 0, F.ln(x))


def clip(x, low: float | None = None, high: float | None = None) -> Column:
    """x within bounds; NULL stays NULL (least and greatest alone would skip it)."""
    x = _col(x)
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(x.isNotNull(), out)
