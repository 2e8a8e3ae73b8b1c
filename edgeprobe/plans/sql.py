"""Pieces of the SQL that stands beside the queries, and one way to lay out a result on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import finite

#: Hour bars of event types.
EB = """eb AS (SELECT e.event_type AS symbol, date_trunc('hour', e.ts) AS ts, first(e.value ORDER BY e.ts, e.event_id) AS open, max(e.value) AS high,
 min(e.value) AS low, last(e.value ORDER BY e.ts, e.event_id) AS close, sum(e.value) AS volume, count(*)::DOUBLE AS trades
 FROM events e WHERE e.value > 0 GROUP BY 1, 2)"""
#: The same with position, log close and log return.
EL = EB + """, el0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n, ln(close) AS lc FROM eb),
el AS (SELECT *, lc - lag(lc) OVER (PARTITION BY symbol ORDER BY ts) AS r FROM el0)"""
#: Day bars of nations.
NB = """nt AS (SELECT n_name AS symbol, date_trunc('day', l_shipdate)::TIMESTAMP AS ts, l_extendedprice / l_quantity AS price, l_quantity AS size, l_orderkey, l_linenumber,
 l_partkey, l_suppkey, l_extendedprice, l_quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
nb AS (SELECT symbol, ts, first(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS open, max(price) AS high, min(price) AS low,
 last(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS close, sum(size) AS volume, count(*)::DOUBLE AS trades FROM nt GROUP BY 1, 2)"""
#: The dense panel of nations, with next returns.
PN = NB + """, tm AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS time_pos FROM (SELECT DISTINCT ts FROM nb)),
dn AS (SELECT tm.ts, tm.time_pos, s.symbol, open, high, low, close, volume, trades FROM tm CROSS JOIN (SELECT DISTINCT symbol FROM nb) s LEFT JOIN nb ON nb.symbol = s.symbol AND nb.ts = tm.ts),
pn0 AS (SELECT *, ln(open) AS lo FROM dn),
pn1 AS (SELECT *, lead(lo, 2) OVER (PARTITION BY symbol ORDER BY time_pos) - lead(lo, 1) OVER (PARTITION BY symbol ORDER BY time_pos) AS ret_next FROM pn0),
pn AS (SELECT *, ret_next IS NOT NULL AS alive, lag(lo, 3) OVER (PARTITION BY symbol ORDER BY time_pos) - lo AS score FROM pn1)"""


def w(rows: int, by: str = "symbol", order: str = "ts") -> str:
    return f"(PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def roll(f: str, x: str, rows: int, by: str = "symbol", order: str = "ts", least: int | None = None) -> str:
    return f"CASE WHEN count({x}) OVER {w(rows, by, order)} >= {least or rows} THEN {f}({x}) OVER {w(rows, by, order)} END"


def z(x: str, rows: int) -> str:
    return f"(({x}) - {roll('avg', x, rows)}) / nullif({roll('stddev_samp', x, rows)}, 0)"


def backtest(source: str, by: str = "symbol", order: str = "ts", rate: str = "0.0012") -> str:
    """CTEs bt0..bt over a source with open and pos."""
    p = f"PARTITION BY {by} ORDER BY {order}"
    return f"""bt0 AS (SELECT *, ln(open) AS lo_ FROM {source}),
bt1 AS (SELECT *, abs(pos - coalesce(lag(pos) OVER ({p}), 0)) AS turnover, pos * coalesce(lead(lo_, 2) OVER ({p}) - lead(lo_, 1) OVER ({p}), 0) AS gross FROM bt0),
bt2 AS (SELECT *, turnover * {rate} AS cost, gross - turnover * {rate} AS net FROM bt1),
bt AS (SELECT *, exp(sum(net) OVER ({p} ROWS UNBOUNDED PRECEDING)) AS equity FROM bt2)"""


def summarize(source: str, by: str, year: int, order: str = "ts") -> str:
    """CTE sm: the measures of each key."""
    return f"""sm0 AS (SELECT *, equity / max(equity) OVER (PARTITION BY {by} ORDER BY {order} ROWS UNBOUNDED PRECEDING) - 1 AS down FROM {source}),
sm1 AS (SELECT {by}, count(*) AS bars, sum(net) AS s, sum(gross) AS gs, avg(net) AS m, stddev_samp(net) AS sd, sqrt(avg(power(least(net, 0), 2))) AS u, min(down) AS max_drawdown,
 count(*) FILTER (turnover > 1e-12) AS n_trades, sum(turnover) AS tu, sum(cost) AS co, avg((abs(pos) > 1e-12)::INT) AS exposure, avg(abs(pos)) AS gross_exposure, max(abs(pos)) AS peak_exposure,
 coalesce(avg((net > 0)::INT) FILTER (abs(pos) > 1e-12), 0) AS hit_rate FROM sm0 GROUP BY {by}),
sm AS (SELECT *, exp(s) - 1 AS total_return, power(exp(s), {year}.0 / bars) - 1 AS cagr, sd * sqrt({year}) AS ann_vol, coalesce(m / nullif(sd, 0) * sqrt({year}), 0) AS sharpe,
 coalesce(m / nullif(u, 0) * sqrt({year}), 0) AS sortino, coalesce(m * sqrt(bars) / nullif(sd, 0), 0) AS t_stat, tu * {year} / bars AS turnover_per_year, 1 - exp(-co) AS cost_drag,
 CASE WHEN max_drawdown < 0 THEN (power(exp(s), {year}.0 / bars) - 1) / -max_drawdown ELSE 0 END AS calmar, exp(gs) - 1 AS gross_return, bars / {year}.0 AS years FROM sm1)"""


MEASURES = "bars& total_return= cagr= ann_vol# sharpe# sortino# max_drawdown# t_stat# n_trades& turnover_per_year# cost_drag# exposure# gross_exposure# peak_exposure# hit_rate# calmar= gross_return= years#"


def _items(spec: str) -> list[tuple[str, str]]:
    return [(c.rstrip("~#&="), c[-1] if c[-1] in "~#&=" else "") for c in spec.split()]


def laid_out(df: DataFrame, spec: str) -> DataFrame:
    """Columns by a list such as ``symbol ts~ close# n&``: ~ a time as text, # rounded to 6 places, & a bigint."""
    how = {
        "~": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"),
        "#": lambda c: F.round(F.col(c).cast("double") + F.lit(1.23e-7), 6) + F.lit(0.0),
        "=": lambda c: F.when(finite(F.col(c).cast("double")).isNotNull(), F.format_string("%.6e", F.col(c).cast("double"))),
        "&": lambda c: F.col(c).cast("bigint"),
        "": F.col,
    }
    return df.select(*[how[k](c).alias(c) for c, k in _items(spec)])


def select(spec: str) -> str:
    how = {"~": "strftime({0}, '%Y-%m-%d %H:%M:%S')", "#": "round(({0})::DOUBLE + 1.23e-7, 6) + 0.0", "=": "CASE WHEN isfinite(({0})::DOUBLE) THEN printf('%.6e', ({0})::DOUBLE) END", "&": "({0})::BIGINT", "": "{0}"}
    return ", ".join(f"{how[k].format(c)} AS {c}" for c, k in _items(spec))
