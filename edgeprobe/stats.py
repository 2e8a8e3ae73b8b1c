"""Small statistics on the driver: normal, binomial and Student's t, without further libraries."""

from __future__ import annotations

import math
from statistics import NormalDist, mean, stdev

_NORMAL = NormalDist()


def normal_p(z: float) -> float:
    """Two-sided p-value of a standard normal statistic."""
    return 2 * (1 - _NORMAL.cdf(abs(z)))


def binomial_cdf(k: int, n: int, p: float) -> float:
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(min(k, n) + 1)) if k >= 0 else 0.0


def _beta_part(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_part(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d, out = 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d or 1e-30)
        c = 1 + step / c or 1e-30
        out *= c * d
        if abs(c * d - 1) < 1e-13:
            break
    return front * (out - 1)


def t_p(t: float, df: int) -> float:
    """Two-sided p-value of Student's t."""
    return _beta_part(df / 2, 0.5, df / (df + t * t))


def one_sample(values: list[float]) -> tuple[float, float]:
    """t and p of the mean against 0."""
    if len(values) < 2 or not (s := stdev(values)):
        return 0.0, 1.0
    t = mean(values) / (s / math.sqrt(len(values)))
    return t, t_p(t, len(values) - 1)


def best_of(trials: int) -> float:
    """The expected largest of so many standard normal numbers."""
    if trials < 2:
        return 0.0
    g = 0.5772156649015329
    return (1 - g) * _NORMAL.inv_cdf(1 - 1 / trials) + g * _NORMAL.inv_cdf(1 - 1 / (trials * math.e))


def deflated_sharpe(sharpe: float, n: int, bars_per_year: int, trials: int) -> float:
    """A yearly Sharpe ratio less what the best of so many trials would have by chance."""
    return sharpe - best_of(trials) * math.sqrt(bars_per_year / n)
