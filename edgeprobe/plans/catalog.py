"""Every registered query: what it computes in Spark, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.windows import lag, zscore
from .. import costs
from ..operators import audit, execution, features, labels, ledger, models, negative, panel, robustness, scans, validation
from ..operators.asof import asof_strict
from ..sources import bars as src
from ..sources import coverage, synthetic
from ..sources.shared import materialised
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
HOUR_YEAR, DAY_YEAR = 8760, 365


def query(spec: str, ctes: str | None = None, source: str = "", where: str = ""):
    """Register a function of (spark, sf_dir) with its columns and, if SQL can say it, CTEs and the one to select from."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: S.laid_out(f(spark, sf_dir), spec)
        if ctes is not None:
            SQL[f.__name__] = f"WITH RECURSIVE {ctes} SELECT {S.select(spec)} FROM {source}{' WHERE ' + where if where else ''}"
        return f

    return add


def hours(spark, sf_dir):
    return src.event_bars(spark, sf_dir)


def nations(spark, sf_dir):
    """The dense panel with a simple reversal score; only its bars are written, since a grid reads them three times."""
    p = panel.prices(src.dense(src.nation_bars(spark, sf_dir)))
    return p.withColumn("score", lag("lo", 3, order="time_pos") - F.col("lo"))


# ---- sources


@query("symbol ts~ open# high# low# close# volume# trades#", S.EB, "eb")
def bars_hourly(spark, sf_dir):
    return hours(spark, sf_dir)


@query("symbol ts~ open# high# low# close# volume# trades#", S.NB, "nb")
def bars_daily_nation(spark, sf_dir):
    return src.nation_bars(spark, sf_dir)


@query("symbol n_bars& bad_high& bad_low& not_positive& repeated&", S.EB + """, i AS (SELECT symbol, count(*) AS n_bars, count(*) FILTER (high < greatest(open, close, low)) AS bad_high,
 count(*) FILTER (low > least(open, close, high)) AS bad_low, count(*) FILTER (least(open, high, low, close) <= 0) AS not_positive, count(*) - count(DISTINCT ts) AS repeated FROM eb GROUP BY 1)""", "i")
def bars_integrity(spark, sf_dir):
    return src.integrity(hours(spark, sf_dir))


@query("symbol missing& n_gaps&", S.EB + """, g AS (SELECT symbol, greatest(date_diff('second', lag(ts) OVER (PARTITION BY symbol ORDER BY ts), ts) / 3600.0 - 1, 0) AS m FROM eb),
 i AS (SELECT symbol, sum(m) AS missing, count(*) FILTER (m > 0) AS n_gaps FROM g GROUP BY 1)""", "i")
def bar_gaps(spark, sf_dir):
    return src.gaps(hours(spark, sf_dir), 3600)


@query("user_id& event_type event_id& value#", """i AS (SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1)""", "i")
def bars_dedupe_first(spark, sf_dir):
    e = src.table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return src.keep_first(e, ["user_id", "event_type"], ["ts", "event_id"])


@query("event_id& ts~", "i AS (SELECT event_id, date_trunc('millisecond', ts) AS ts FROM events)", "i")
def epoch_unit_detect(spark, sf_dir):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    raw = F.when(F.col("event_id") % 2 == 0, F.floor(micros / 1000)).otherwise(micros)
    return src.table(spark, sf_dir, "events").select("event_id", src.from_epoch(raw.cast("bigint")).alias("ts"))


@query("symbol", S.NB + ", i AS (SELECT DISTINCT symbol FROM nb WHERE ts >= TIMESTAMP '1995-03-01' AND ts < TIMESTAMP '1995-04-01' AND regexp_full_match(symbol, '[A-Z].*'))", "i")
def universe_as_of(spark, sf_dir):
    return src.universe_as_of(src.nation_bars(spark, sf_dir), "1995-03", "[A-Z].*")


_LAST = "sl AS (SELECT l_partkey::VARCHAR AS symbol, strftime(max(l_shipdate), '%Y-%m') AS last_month FROM lineitem GROUP BY 1)"


@query("symbol last_month", _LAST + ", i AS (SELECT * FROM sl WHERE last_month < '2001-09')", "i")
def delisted_symbols(spark, sf_dir):
    t = src.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("symbol"), F.col("l_shipdate").alias("ts"))
    return src.delisted(t, "2001-11")


@query("symbol last_ts~", "i AS (SELECT l_partkey::VARCHAR AS symbol, max(l_shipdate)::TIMESTAMP AS last_ts FROM lineitem GROUP BY 1 HAVING count(*) >= 20 AND max(l_shipdate) < DATE '2001-11-01' - 60)", "i")
def delisted_by_bars(spark, sf_dir):
    t = src.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("symbol"), F.col("l_shipdate").alias("ts"))
    return src.delisted_by_bars(t, "2001-11", least=20)


@query("symbol n& missing&", S.PN + ", i AS (SELECT symbol, count(*) AS n, count(*) FILTER (open IS NULL) AS missing FROM dn GROUP BY 1)", "i")
def dense_grid(spark, sf_dir):
    return src.dense(src.nation_bars(spark, sf_dir)).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("open").isNull()).alias("missing"))


_SUPP = "ls AS (SELECT DISTINCT l_suppkey::VARCHAR AS symbol, strftime(l_shipdate, '%Y-%m') AS month, date_trunc('month', l_shipdate) AS m FROM lineitem)"


def _suppliers(spark, sf_dir):
    return src.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_shipdate").alias("ts"))


@query("symbol month", _SUPP + """, cal AS (SELECT symbol, unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS m FROM ls GROUP BY 1), o AS (SELECT symbol, strftime(m, '%Y-%m') AS month FROM cal ANTI JOIN ls USING (symbol, m))""", "o")
def missing_months(spark, sf_dir):
    return coverage.missing_months(_suppliers(spark, sf_dir))


@query("traded& left_out& dead& passes", _SUPP + """, tr AS (SELECT DISTINCT symbol FROM ls WHERE month = '1995-03'), un AS (SELECT DISTINCT symbol FROM ls WHERE month <= '1995-03'), de AS (SELECT symbol FROM ls GROUP BY 1 HAVING max(month) < '1998-11'),
 k AS (SELECT (SELECT count(*) FROM tr) AS traded, (SELECT count(*) FROM un ANTI JOIN tr USING (symbol)) AS left_out, (SELECT count(*) FROM tr SEMI JOIN de USING (symbol)) AS dead), o AS (SELECT *, dead > 0 OR left_out = 0 AS passes FROM k)""", "o")
def survivorship_check(spark, sf_dir):
    t = _suppliers(spark, sf_dir)
    return coverage.survivorship(src.universe_as_of(t, "1995-03"), t.where("ts < timestamp_ntz '1995-04-01'"), src.delisted(t, "1998-12", 1))


# ---- features


def _features(name: str, part, columns: str, exprs: dict[str, str], base: str = S.EL, source: str = "el"):
    spec = f"symbol ts~ {columns}"
    QUERIES[name] = lambda spark, sf_dir: S.laid_out(part(features.log_returns(hours(spark, sf_dir))), spec)
    chosen = ", ".join(f"{v} AS {k}" for k, v in exprs.items())
    SQL[name] = f"WITH {base}, f AS (SELECT symbol, ts, {chosen} FROM {source}) SELECT {S.select(spec)} FROM f"


_features("ret_momentum", features.momentum, " ".join(f"ret_{n}#" for n in (1, 2, 3, 6, 12, 24, 72)), {f"ret_{n}": S.roll("sum", "r", n) for n in (1, 2, 3, 6, 12, 24, 72)})
_features("rolling_vol", features.volatility, "vol_12# vol_24# vol_72# vol_168#", {f"vol_{n}": S.roll("stddev_samp", "r", n) for n in (12, 24, 72, 168)})
_features("vol_ratio", features.volatility, "volratio#", {"volratio": f"({S.roll('stddev_samp', 'r', 12)}) / nullif({S.roll('stddev_samp', 'r', 168)}, 0)"})
_features("rolling_zscore", features.stretch, "z_12# z_24# z_72# z_168#", {f"z_{n}": S.z("close", n) for n in (12, 24, 72, 168)})
_features("donchian_position", features.channel, "donch_24# donch_72#", {f"donch_{n}": f"(close - {S.roll('min', 'low', n)}) / nullif({S.roll('max', 'high', n)} - {S.roll('min', 'low', n)}, 0)" for n in (24, 72)})
_features("bar_shape", features.shape, "hl_range# upper_wick# lower_wick# body#", {
    "hl_range": "nullif(high - low, 0) / close", "upper_wick": "(high - greatest(open, close)) / nullif(high - low, 0)",
    "lower_wick": "(least(open, close) - low) / nullif(high - low, 0)", "body": "(close - open) / nullif(high - low, 0)",
})
_features("rolling_skew", features.higher, "ret_skew_72#", {"ret_skew_72": S.roll("skewness", "r", 72)})
_features("calendar_features", features.calendar, "hour# dow#", {"hour": "hour(ts)", "dow": "isodow(ts) - 1"})
_EX = S.EL + ", ex AS (SELECT *, volume / nullif(trades, 0) AS size_, abs(r) / nullif(volume, 0) AS impact_ FROM el)"
_features("flow_zscores", features.flow, "vol_z# trade_z# avg_trade#", {"vol_z": S.z("volume", 72), "trade_z": S.z("trades", 72), "avg_trade": S.z("size_", 72)}, _EX, "ex")
_features("amihud", features.flow, "amihud#", {"amihud": S.z("impact_", 72)}, _EX, "ex")

_EWM = S.EL + """, d AS (SELECT symbol, ts, pos, high, low, close, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS ch, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM el),
d2 AS (SELECT *, greatest(ch, 0) AS up, greatest(-ch, 0) AS dn, greatest(high - low, coalesce(abs(high - pc), high - low), coalesce(abs(low - pc), high - low)) AS tr FROM d),
rec AS (SELECT symbol, ts, pos, close, NULL::DOUBLE AS u, NULL::DOUBLE AS v, tr AS a, close AS f, close AS s, 0.0::DOUBLE AS g FROM d2 WHERE pos = 0
 UNION ALL SELECT d2.symbol, d2.ts, d2.pos, d2.close, CASE WHEN rec.u IS NULL THEN d2.up ELSE rec.u * 13 / 14 + d2.up / 14 END, CASE WHEN rec.v IS NULL THEN d2.dn ELSE rec.v * 13 / 14 + d2.dn / 14 END,
 rec.a * 13 / 14 + d2.tr / 14, rec.f * 11 / 13 + d2.close * 2 / 13, rec.s * 25 / 27 + d2.close * 2 / 27,
 rec.g * 8 / 10 + ((rec.f * 11 / 13 + d2.close * 2 / 13) - (rec.s * 25 / 27 + d2.close * 2 / 27)) * 2 / 10 FROM rec JOIN d2 ON d2.symbol = rec.symbol AND d2.pos = rec.pos + 1),
ew AS (SELECT symbol, ts, CASE WHEN u + v = 0 THEN 50 ELSE 100 * u / (u + v) END AS rsi_14, a / close AS atr_pct, (f - s - g) / close AS macd_n FROM rec)"""


@query("symbol ts~ rsi_14#", _EWM, "ew")
def rsi_wilder(spark, sf_dir):
    return features.smoothed(hours(spark, sf_dir))


@query("symbol ts~ atr_pct#", _EWM, "ew")
def atr_pct(spark, sf_dir):
    return features.smoothed(hours(spark, sf_dir))


@query("symbol ts~ macd_n#", _EWM, "ew")
def macd_norm(spark, sf_dir):
    return features.smoothed(hours(spark, sf_dir))


def _aux(spark, sf_dir):
    """An auxiliary series: every event, of those at one time the one with the largest id."""
    e = src.table(spark, sf_dir, "events").where("value > 0").groupBy("event_type", "ts").agg(F.max_by("value", "event_id").alias("value"), F.max_by("user_id", "event_id").alias("user_id"))
    return e.select(F.col("event_type").alias("symbol"), "ts", "value", (F.col("value") / 1e6).alias("funding_rate"), F.col("value").alias("open_interest"),
                    (F.col("value") / 50).alias("all_accounts_ls"), (F.col("user_id") / F.lit(100.0)).alias("top_trader_positions_ls"), (F.col("value") / (F.col("user_id") + 1)).alias("taker_buy_sell_ratio"))


_ASOF = S.EL + """, ax AS (SELECT event_type AS symbol, ts, arg_max(value, event_id) AS value, arg_max(value, event_id) / 1e6 AS rate, arg_max(user_id, event_id) AS user_id FROM events WHERE value > 0 GROUP BY 1, 2),
aj AS (SELECT el.*, ax.value, ax.rate, ax.user_id FROM el ASOF LEFT JOIN ax ON el.symbol = ax.symbol AND el.ts + INTERVAL 1 HOUR > ax.ts)"""


@query("symbol ts~ close# value#", _ASOF, "aj")
def asof_strict_join(spark, sf_dir):
    return asof_strict(hours(spark, sf_dir), _aux(spark, sf_dir), ["value"], 3600)


@query("symbol ts~ funding# funding_ma_3# funding_ma_21# funding_z# funding_cum_7d#", _ASOF + f""", f AS (SELECT symbol, ts, rate AS funding, {S.roll('avg', 'rate', 3)} AS funding_ma_3, {S.roll('avg', 'rate', 21)} AS funding_ma_21,
 {S.z('rate', 90)} AS funding_z, {S.roll('sum', 'rate', 42)} AS funding_cum_7d FROM aj)""", "f")
def funding_features(spark, sf_dir):
    return features.funding(asof_strict(hours(spark, sf_dir), _aux(spark, sf_dir), ["funding_rate"], 3600))


_OI = _ASOF + f""", oi AS (SELECT *, ln(value) AS lv, value / 50 AS acc, user_id / 100.0 AS top, value / (user_id + 1) AS tk FROM aj),
f0 AS (SELECT *, lv - lag(lv, 6) OVER (PARTITION BY symbol ORDER BY ts) AS oi_chg_6, lv - lag(lv, 24) OVER (PARTITION BY symbol ORDER BY ts) AS oi_chg_24, lc - lag(lc, 24) OVER (PARTITION BY symbol ORDER BY ts) AS c24 FROM oi),
f AS (SELECT symbol, ts, oi_chg_6, oi_chg_24, {S.z('lv', 168)} AS oi_z, sign(oi_chg_24) * sign(c24) AS oi_price_div, acc AS ls_accounts, top AS ls_top_positions, top - acc AS ls_spread, tk AS taker_ratio, {S.z('tk', 72)} AS taker_z FROM f0)"""


@query("symbol ts~ oi_chg_6# oi_chg_24# oi_z# oi_price_div#", _OI, "f")
def oi_features(spark, sf_dir):
    return features.positioning(asof_strict(hours(spark, sf_dir), _aux(spark, sf_dir), ["open_interest"], 3600))


@query("symbol ts~ ls_accounts# ls_top_positions# ls_spread# taker_ratio# taker_z#", _OI, "f")
def positioning_features(spark, sf_dir):
    return features.positioning(asof_strict(hours(spark, sf_dir), _aux(spark, sf_dir), ["all_accounts_ls", "top_trader_positions_ls", "taker_buy_sell_ratio"], 3600))


# ---- labels

_LB = S.EL + f", lb AS (SELECT *, {S.roll('stddev_samp', 'r', 72)} AS sigma FROM el)"
_LABEL = "symbol ts~ y# t_end& ret# sigma#"


@query(_LABEL, _LB + ", q AS (SELECT *, lead(r) OVER (PARTITION BY symbol ORDER BY ts) AS ret FROM lb), o AS (SELECT symbol, ts, CASE WHEN ret > 0 THEN 1 WHEN ret IS NOT NULL THEN 0 END AS y, least(pos + 1, n - 1) AS t_end, ret, sigma FROM q)", "o")
def label_next_sign(spark, sf_dir):
    return labels.next_bar_sign(hours(spark, sf_dir))


@query(_LABEL, _LB + """, q AS (SELECT *, lead(lc, 24) OVER (PARTITION BY symbol ORDER BY ts) - lc AS ret FROM lb),
o AS (SELECT symbol, ts, CASE WHEN ret / nullif(sigma * sqrt(24), 0) > 0.5 THEN 1 WHEN ret / nullif(sigma * sqrt(24), 0) < -0.5 THEN 0 END AS y, least(pos + 24, n - 1) AS t_end, ret, sigma FROM q)""", "o")
def label_fwd_deadband(spark, sf_dir):
    return labels.forward_return(hours(spark, sf_dir))


_TB = _LB + """, hit AS (SELECT a.symbol, a.pos, min(b.pos) AS at FROM lb a JOIN lb b ON a.symbol = b.symbol AND b.pos BETWEEN a.pos + 1 AND a.pos + 24
 AND (b.low <= a.close * exp(-1.5 * a.sigma) OR b.high >= a.close * exp(1.5 * a.sigma)) GROUP BY 1, 2),
q AS (SELECT a.*, coalesce(h.at, least(a.pos + 24, a.n - 1)) AS t_end, h.at FROM lb a LEFT JOIN hit h ON a.symbol = h.symbol AND a.pos = h.pos),
o AS (SELECT q.symbol, q.ts, q.t_end, e.lc - q.lc AS ret, q.sigma, CASE WHEN q.pos + 24 < q.n AND q.sigma IS NOT NULL THEN CASE WHEN q.at IS NOT NULL AND e.low <= q.close * exp(-1.5 * q.sigma) THEN 0
 WHEN q.at IS NOT NULL THEN 1 WHEN e.lc - q.lc > 0 THEN 1 ELSE 0 END END AS y FROM q JOIN lb e ON e.symbol = q.symbol AND e.pos = q.t_end)"""


@query(_LABEL, _TB, "o")
def label_triple_barrier(spark, sf_dir):
    return labels.triple_barrier(hours(spark, sf_dir))


_RL = S.PN + """, fw AS (SELECT *, lead(lo, 6) OVER (PARTITION BY symbol ORDER BY time_pos) - lead(lo, 1) OVER (PARTITION BY symbol ORDER BY time_pos) AS fwd FROM pn),
rl AS (SELECT *, CASE WHEN fwd IS NOT NULL THEN (fwd > median(fwd) OVER (PARTITION BY time_pos))::INT END AS y FROM fw)"""


@query("symbol time_pos& fwd# y#", _RL, "rl", "y IS NOT NULL")
def relative_label(spark, sf_dir):
    return labels.relative(nations(spark, sf_dir)).where("y is not null")


def _sides(b):
    return execution.sma_cross(b, 5, 20, allow_short=True)


_SMA = S.EL + f", ma AS (SELECT *, {S.roll('avg', 'close', 5)} AS a, {S.roll('avg', 'close', 20)} AS b FROM el), sma AS (SELECT *, CASE WHEN b IS NULL THEN 0 WHEN a > b THEN 1 ELSE 0 END::DOUBLE AS pos_, CASE WHEN b IS NULL THEN 0 WHEN a > b THEN 1 ELSE -1 END::DOUBLE AS side FROM ma)"


@query("symbol ts~ side# meta_y#", _SMA + ", q AS (SELECT *, lead(r) OVER (PARTITION BY symbol ORDER BY ts) AS ret FROM sma), o AS (SELECT symbol, ts, side, CASE WHEN side <> 0 AND ret IS NOT NULL THEN (side * ret > 0)::INT END AS meta_y FROM q)", "o")
def label_meta(spark, sf_dir):
    b = _sides(hours(spark, sf_dir)).withColumnRenamed("pos", "side")
    return labels.meta(labels.next_bar_sign(b), "side")


# ---- validation


@query("symbol new_pos& new_end&", S.EL + """, k AS (SELECT *, least(pos + 5, n - 1) AS t_end, pos % 3 <> 0 AS keep FROM el), c AS (SELECT *, count(*) FILTER (keep) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS np,
 count(*) FILTER (keep) OVER (PARTITION BY symbol) AS nk FROM k), o AS (SELECT a.symbol, a.np AS new_pos, greatest(least(b.np, a.nk - 1), a.np) AS new_end FROM c a JOIN c b ON a.symbol = b.symbol AND a.t_end = b.pos WHERE a.keep)""", "o")
def remap_t_end(spark, sf_dir):
    b = labels.positions(hours(spark, sf_dir)).withColumn("t_end", F.least(F.col("pos") + 5, F.col("n") - 1)).withColumn("keep", F.col("pos") % 3 != 0)
    return validation.after_filter(b, "keep")


@query("symbol pos& weight#", S.EL + """, s AS (SELECT symbol, pos, least(pos + 1 + pos % 7, n - 1) AS fin FROM el), cc AS (SELECT e.symbol, e.pos, count(*) AS c FROM el e JOIN s ON s.symbol = e.symbol AND e.pos BETWEEN s.pos AND s.fin GROUP BY 1, 2),
o AS (SELECT s.symbol, s.pos, avg(1.0 / c) AS weight FROM s JOIN cc ON cc.symbol = s.symbol AND cc.pos BETWEEN s.pos AND s.fin GROUP BY 1, 2)""", "o")
def uniqueness_weights(spark, sf_dir):
    b = labels.positions(hours(spark, sf_dir)).withColumn("t_end", F.least(F.col("pos") + 1 + F.col("pos") % 7, F.col("n") - 1))
    return validation.uniqueness(b)


def _fold_input(spark, sf_dir, scheme):
    b = labels.next_bar_sign(hours(spark, sf_dir))
    split = validation.Split(n_folds=4, min_train=200, embargo=3, scheme=scheme, train_window=150, least=20)
    return b, split


_FOLD = S.EL + """, nn AS (SELECT min(n) AS n FROM el), fd AS (SELECT k + 1 AS fold, 200 + k * ((n - 200) // 4) AS test_lo, 200 + (k + 1) * ((n - 200) // 4) AS test_hi FROM nn, range(4) t(k)),
tr AS (SELECT symbol, pos, least(pos + 1, n - 1) AS t_end FROM el)"""


@query("symbol fold& train& test& purged&", _FOLD + """, o AS (SELECT symbol, fold, count(*) FILTER (pos < test_lo AND t_end < test_lo - 3) AS train, count(*) FILTER (pos >= test_lo AND pos < test_hi) AS test,
 max(test_lo) - count(*) FILTER (pos < test_lo AND t_end < test_lo - 3) AS purged FROM tr, fd GROUP BY 1, 2)""", "o")
def walk_forward_folds(spark, sf_dir):
    b, split = _fold_input(spark, sf_dir, "expanding")
    return _described(b, split)


@query("symbol fold& train& test& purged&", _FOLD + """, o AS (SELECT symbol, fold, count(*) FILTER (pos < test_lo AND pos >= test_lo - 150 AND t_end < test_lo - 3) AS train, count(*) FILTER (pos >= test_lo AND pos < test_hi) AS test,
 150 - count(*) FILTER (pos < test_lo AND pos >= test_lo - 150 AND t_end < test_lo - 3) AS purged FROM tr, fd GROUP BY 1, 2)""", "o")
def purge_counts(spark, sf_dir):
    b, split = _fold_input(spark, sf_dir, "rolling")
    return _described(b, split)


def _described(b, split):
    n = b.groupBy("symbol").count().agg(F.min("count")).first()[0]  # one number: fold bounds are literals of the plan
    a = validation.assign(b, validation.fold_bounds(n, split))
    parts = a.groupBy("symbol", "fold", "train_lo", "test_lo").agg(F.count_if(F.col("part") == "train").alias("train"), F.count_if(F.col("part") == "test").alias("test"))
    return parts.withColumn("purged", F.col("test_lo") - F.col("train_lo") - F.col("train"))


@query("fold& train& test&", S.PN + """, nn AS (SELECT count(*) AS n FROM tm), fd AS (SELECT k + 1 AS fold, 600 + k * ((n - 600) // 5) AS lo, 600 + (k + 1) * ((n - 600) // 5) AS hi FROM nn, range(5) t(k)),
o AS (SELECT fold, count(*) FILTER (time_pos < lo - 7) AS train, count(*) FILTER (time_pos >= lo AND time_pos < hi) AS test FROM tm, fd GROUP BY 1)""", "o")
def time_folds(spark, sf_dir):
    times = nations(spark, sf_dir).select("time_pos").distinct()
    n = times.count()
    bounds = validation.fold_bounds(n, validation.Split(n_folds=5, min_train=600, embargo=2, least=50), horizon=5)
    return validation.describe(validation.assign(times, bounds, known_at="time_pos", pos="time_pos"))


# ---- positions


@query("symbol ts~ pos#", _SMA + ", o AS (SELECT symbol, ts, pos_ AS pos FROM sma)", "o")
def pos_sma(spark, sf_dir):
    return execution.sma_cross(hours(spark, sf_dir), 5, 20)


_DON = S.EL + """, ev AS (SELECT *, CASE WHEN close > CASE WHEN count(high) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) = 24 THEN max(high) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) END THEN 1
 WHEN close < CASE WHEN count(low) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) = 12 THEN min(low) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) END THEN 0 END AS ev FROM el),
don AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 0)::DOUBLE AS pos_ FROM ev)"""


@query("symbol ts~ pos#", _DON + ", o AS (SELECT symbol, ts, pos_ AS pos FROM don)", "o")
def pos_donchian(spark, sf_dir):
    return execution.donchian(hours(spark, sf_dir), 24, 12)


def _recursive(source: str, state: str, start: str, step: str) -> str:
    """A CTE chain rc over a source with symbol, ts, pos (0..) and x; s is the state before."""
    return f"""rs AS (SELECT symbol, ts, pos, x FROM {source}), rz AS (SELECT symbol, -1::BIGINT AS pos, {start} FROM (SELECT DISTINCT symbol FROM rs)),
rc AS (SELECT symbol, NULL::TIMESTAMP AS ts, pos, {state} FROM rz UNION ALL SELECT rs.symbol, rs.ts, rs.pos, {step} FROM rc s JOIN rs ON rs.symbol = s.symbol AND rs.pos = s.pos + 1)"""


_ZED = S.EL + f", zz AS (SELECT *, {S.z('close', 24)} AS x FROM el)"
_FADE = _recursive("zz", "p", "0.0::DOUBLE AS p", """CASE WHEN rs.x IS NULL THEN s.p WHEN s.p = 0 AND rs.x <= -1.5 THEN 1 WHEN s.p = 0 AND rs.x >= 1.5 THEN -1 WHEN s.p > 0 AND rs.x >= -0.5 THEN 0 WHEN s.p < 0 AND rs.x <= 0.5 THEN 0 ELSE s.p END""")


@query("symbol ts~ pos#", f"{_ZED}, {_FADE}, o AS (SELECT symbol, ts, p AS pos FROM rc WHERE pos >= 0)", "o")
def pos_meanrev(spark, sf_dir):
    return execution.mean_reversion(hours(spark, sf_dir), 24, 1.5, 0.5)


_WANT = S.EL + f", sg AS (SELECT *, {S.roll('stddev_samp', 'r', 30)} AS sd FROM el), wt AS (SELECT *, coalesce(least(greatest(40 / nullif(sd * sqrt(8760), 0), 0), 1), 0) AS x FROM sg)"
_BAND = _recursive("wt", "p", "0.0::DOUBLE AS p", "CASE WHEN abs(rs.x - s.p) > 0.05 THEN rs.x ELSE s.p END")


@query("symbol ts~ want# pos#", f"{_WANT}, {_BAND}, o AS (SELECT rc.symbol, rc.ts, wt.x AS want, rc.p AS pos FROM rc JOIN wt ON wt.symbol = rc.symbol AND wt.pos = rc.pos)", "o")
def pos_voltarget(spark, sf_dir):
    return execution.vol_target(hours(spark, sf_dir), HOUR_YEAR, target=40.0, width=0.05)


_PROB = S.EL + f", pb AS (SELECT *, CASE WHEN pos % 11 <> 0 THEN 0.5 + ({S.z('close', 12)}) / 10 END AS x FROM el)"


def _probability(b):
    p = labels.positions(b).withColumn("_z", zscore("close", 12))
    return p.withColumn("p", F.when(F.col("pos") % 11 != 0, 0.5 + F.col("_z") / 10)).withColumnRenamed("pos", "k").select("symbol", "ts", "k", "p", "open", "close")


_HYST = _recursive("pb", "p, held", "0.0::DOUBLE AS p, 0::BIGINT AS held", """CASE WHEN w <> s.p AND s.held >= 4 THEN w ELSE s.p END, CASE WHEN w <> s.p AND s.held >= 4 THEN 0 ELSE s.held + 1 END""").replace(
    "FROM rc s JOIN rs ON rs.symbol = s.symbol AND rs.pos = s.pos + 1",
    "FROM rc s JOIN rs ON rs.symbol = s.symbol AND rs.pos = s.pos + 1 JOIN LATERAL (SELECT CASE WHEN rs.x IS NULL THEN s.p WHEN s.p <= 0 AND rs.x >= 0.56 THEN 1 WHEN s.p >= 0 AND rs.x <= 0.44 THEN -1 WHEN s.p > 0 AND rs.x < 0.5 THEN 0 WHEN s.p < 0 AND rs.x > 0.5 THEN 0 ELSE s.p END AS w) ON true",
)


@query("symbol ts~ pos#", f"{_PROB}, {_HYST}, o AS (SELECT symbol, ts, p AS pos FROM rc WHERE pos >= 0)", "o")
def scan_hysteresis(spark, sf_dir):
    return scans.hysteresis(_probability(hours(spark, sf_dir)), "p", min_hold=4)


_SIDE = _SMA + ", sx AS (SELECT symbol, ts, pos, CASE WHEN pos % 13 <> 5 THEN side END AS x FROM sma)"
_HOLD = _recursive("sx", "p, held, want", "0.0::DOUBLE AS p, 6::BIGINT AS held, 0.0::DOUBLE AS want", """CASE WHEN coalesce(rs.x, s.want) <> s.p AND s.held >= 6 THEN coalesce(rs.x, s.want) ELSE s.p END,
 CASE WHEN coalesce(rs.x, s.want) <> s.p AND s.held >= 6 THEN 0 ELSE s.held + 1 END, coalesce(rs.x, s.want)""")


@query("symbol ts~ pos#", f"{_SIDE}, {_HOLD}, o AS (SELECT symbol, ts, p AS pos FROM rc WHERE pos >= 0)", "o")
def scan_min_hold(spark, sf_dir):
    b = labels.positions(_sides(hours(spark, sf_dir)).withColumnRenamed("pos", "side"))
    b = b.withColumn("want", F.when(F.col("pos") % 13 != 5, F.col("side"))).select("symbol", "ts", "want")
    return scans.min_hold(b, "want", bars=6)


_ZB = S.EL + f", zb AS (SELECT *, {S.z('close', 24)} AS x FROM el)"


@query("symbol ts~ pos#", f"{_ZB}, {_recursive('zb', 'p', '0.0::DOUBLE AS p', 'CASE WHEN abs(rs.x - s.p) > 0.75 THEN rs.x ELSE s.p END')}, o AS (SELECT symbol, ts, p AS pos FROM rc WHERE pos >= 0)", "o")
def scan_band(spark, sf_dir):
    return scans.band(hours(spark, sf_dir).withColumn("z", zscore("close", 24)).select("symbol", "ts", "z"), "z", width=0.75)


# ---- execution and measures

_SP = _SMA + ", sp AS (SELECT symbol, ts, open, pos AS k, n, pos_ AS pos FROM sma)"
_BT = f"{_SP}, {S.backtest('sp')}"


def _tested(spark, sf_dir):
    return execution.backtest(execution.sma_cross(hours(spark, sf_dir), 5, 20))


@query("symbol ts~ pos# turnover# cost# gross# net# equity#", _BT, "bt")
def backtest_bars(spark, sf_dir):
    return _tested(spark, sf_dir)


_RS = _BT + """, ms AS (SELECT *, k >= 100 AND k < 300 AS inside FROM bt), mx AS (SELECT *, max(k) FILTER (inside) OVER (PARTITION BY symbol) AS lastk, lead(cost) OVER (PARTITION BY symbol ORDER BY ts) AS nc, lead(turnover) OVER (PARTITION BY symbol ORDER BY ts) AS nt_ FROM ms),
rr AS (SELECT symbol, ts, k, pos, gross, turnover + CASE WHEN k = lastk AND coalesce(nc, 0) > 0 THEN nt_ ELSE 0 END AS turnover, cost + CASE WHEN k = lastk THEN coalesce(nc, 0) ELSE 0 END AS cost, net - CASE WHEN k = lastk THEN coalesce(nc, 0) ELSE 0 END AS net FROM mx WHERE inside),
rt AS (SELECT *, exp(sum(net) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS equity FROM rr)"""


def _restricted(spark, sf_dir):
    b = _tested(spark, sf_dir)
    k = F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1
    b = b.withColumn("k", k).withColumn("inside", (F.col("k") >= 100) & (F.col("k") < 300))
    return execution.restrict(b, "inside")


@query("symbol ts~ turnover# cost# net# equity#", _RS, "rt")
def restrict_exit_charge(spark, sf_dir):
    return _restricted(spark, sf_dir)


@query("symbol " + S.MEASURES, f"{_RS}, {S.summarize('rt', 'symbol', HOUR_YEAR)}", "sm")
def metrics_summary(spark, sf_dir):
    return execution.summarize(_restricted(spark, sf_dir), HOUR_YEAR, ["symbol"])


@query("symbol ts~ drawdown#", _BT + ", o AS (SELECT symbol, ts, equity / max(equity) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM bt)", "o")
def drawdown(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return _tested(spark, sf_dir).withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1)


def _nation_sma(spark, sf_dir):
    return execution.backtest(execution.sma_cross(src.nation_bars(spark, sf_dir), 10, 40))


_NS = S.NB + f", nm AS (SELECT *, {S.roll('avg', 'close', 10)} AS a, {S.roll('avg', 'close', 40)} AS b FROM nb), np AS (SELECT symbol, ts, open, CASE WHEN b IS NULL THEN 0 WHEN a > b THEN 1 ELSE 0 END::DOUBLE AS pos FROM nm), {S.backtest('np')}"


def _periods(bt: str, out: str) -> str:
    return f"""{out}0 AS (SELECT symbol, strftime(ts, '%Y') AS period, count(*) AS bars, sum(net) AS s, avg(net) AS m, stddev_samp(net) AS sd, count(*) FILTER (abs(net) > 1e-12) AS act, count(*) FILTER (turnover > 1e-12) AS n_trades FROM {bt} GROUP BY 1, 2),
{out} AS (SELECT *, exp(s) - 1 AS total_return, m / sd * sqrt(365) AS sharpe FROM {out}0 WHERE bars >= 2 AND sd > 0 AND bars >= 0.35 * 365 AND act >= greatest(2, 0.01 * bars))"""


@query("symbol period bars& total_return= sharpe# n_trades&", f"{_NS}, {_periods('bt', 'o')}", "o")
def by_year(spark, sf_dir):
    return execution.by_period(_nation_sma(spark, sf_dir), DAY_YEAR, ["symbol"])


@query("symbol period total_return= sharpe# n_trades& total_return_hold= sharpe_hold# excess_sharpe#", f"""{_NS}, {_periods('bt', 'py')}, hb AS (SELECT symbol, ts, open, 1.0::DOUBLE AS pos FROM nb), {S.backtest('hb').replace('bt', 'ht')}, {_periods('ht', 'ph')},
o AS (SELECT h.symbol, h.period, coalesce(p.total_return, 0) AS total_return, coalesce(p.sharpe, 0) AS sharpe, coalesce(p.n_trades, 0) AS n_trades, h.total_return AS total_return_hold, h.sharpe AS sharpe_hold, coalesce(p.sharpe, 0) - h.sharpe AS excess_sharpe FROM py p RIGHT JOIN ph h ON p.symbol = h.symbol AND p.period = h.period)""", "o")
def period_stability(spark, sf_dir):
    held = execution.backtest(execution.buy_hold(src.nation_bars(spark, sf_dir)))
    return robustness.stability(execution.by_period(_nation_sma(spark, sf_dir), DAY_YEAR, ["symbol"]), execution.by_period(held, DAY_YEAR, ["symbol"]), ["symbol"])


@query("symbol " + S.MEASURES, f"{_NS}, {S.summarize('bt', 'symbol', DAY_YEAR)}", "sm")
def cross_symbol_transfer(spark, sf_dir):
    return execution.summarize(_nation_sma(spark, sf_dir), DAY_YEAR, ["symbol"])


_HOLDS = (1, 6, 24, 72)
_MV = S.EL + ", mv AS (" + " UNION ALL ".join(f"SELECT symbol, {h} AS hold, avg(abs(m)) AS move FROM (SELECT symbol, {S.roll('sum', 'r', h)} AS m FROM el) GROUP BY 1, 2" for h in _HOLDS) + ")"


@query("symbol hold& move# needed# accuracy# edge#", _MV + ", o AS (SELECT symbol, hold, move, 0.5 + 0.0024 / nullif(2 * move, 0) AS needed, accuracy, (2 * accuracy - 1) * move - 0.0024 AS edge FROM mv, (VALUES (0.51), (0.53), (0.55), (0.6)) t(accuracy))", "o")
def cost_budget(spark, sf_dir):
    return execution.budget(execution.mean_move(hours(spark, sf_dir), list(_HOLDS)), [0.51, 0.53, 0.55, 0.6])


@query("symbol fast& slow& " + S.MEASURES, S.EL + ", gm AS (SELECT *, " + ", ".join(f"{S.roll('avg', 'close', n)} AS m{n}" for n in (3, 5, 8, 20, 40)) + " FROM el), gp AS (" + " UNION ALL ".join(
    f"SELECT symbol, ts, open, {x} AS fast, {y} AS slow, CASE WHEN m{y} IS NULL THEN 0 WHEN m{x} > m{y} THEN 1 ELSE 0 END::DOUBLE AS pos FROM gm" for x in (3, 5, 8) for y in (5, 20, 40) if x < y) + f"), {S.backtest('gp', 'symbol, fast, slow')}, {S.summarize('bt', 'symbol, fast, slow', HOUR_YEAR)}", "sm")
def param_grid_sharpe(spark, sf_dir):
    return robustness.sma_grid(hours(spark, sf_dir), [3, 5, 8], [5, 20, 40], HOUR_YEAR)


@query("symbol pairs& rate#", S.EL + ", gm AS (SELECT *, " + ", ".join(f"{S.roll('avg', 'close', n)} AS m{n}" for n in (3, 5, 8, 20, 40)) + " FROM el), gp AS (" + " UNION ALL ".join(
    f"SELECT symbol, ts, open, {x} AS fast, {y} AS slow, CASE WHEN m{y} IS NULL THEN 0 WHEN m{x} > m{y} THEN 1 ELSE 0 END::DOUBLE AS pos FROM gm" for x in (3, 5, 8) for y in (5, 20, 40) if x < y) + f"""), {S.backtest('gp', 'symbol, fast, slow')}, {S.summarize('bt', 'symbol, fast, slow', HOUR_YEAR)},
 nbr AS (SELECT symbol, sharpe, lag(sharpe) OVER (PARTITION BY symbol, fast ORDER BY slow) AS b FROM sm UNION ALL SELECT symbol, sharpe, lag(sharpe) OVER (PARTITION BY symbol, slow ORDER BY fast) FROM sm),
 o AS (SELECT symbol, count(*) AS pairs, avg((sign(sharpe) <> sign(b))::INT) AS rate FROM nbr WHERE b IS NOT NULL GROUP BY 1)""", "o")
def sign_flip_rate(spark, sf_dir):
    grid = robustness.sma_grid(hours(spark, sf_dir), [3, 5, 8], [5, 20, 40], HOUR_YEAR)
    return robustness.sign_flips(grid, "fast", "slow", "sharpe", ["symbol"])


@query("symbol ac_ret# ac_abs#", S.EL + """, ac AS (SELECT symbol, r, lag(r) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM el), o AS (SELECT symbol, corr(r, p) AS ac_ret, corr(abs(r), abs(p)) AS ac_abs FROM ac GROUP BY 1)""", "o")
def autocorrelation(spark, sf_dir):
    b = features.log_returns(hours(spark, sf_dir)).withColumn("p", lag("r"))
    return b.groupBy("symbol").agg(F.corr("r", "p").alias("ac_ret"), F.corr(F.abs("r"), F.abs("p")).alias("ac_abs"))


@query("symbol ts~ scaled#", _SMA + f", vs AS (SELECT *, {S.roll('stddev_samp', 'r', 24)} AS sg FROM sma), o AS (SELECT symbol, ts, greatest(least(side * coalesce(least(greatest(60 / nullif(sg * sqrt(8760), 0), 0), 1), 0), 1), -1) AS scaled FROM vs)", "o")
def risk_scaled_position(spark, sf_dir):
    b = features.volatility(features.log_returns(_sides(hours(spark, sf_dir))))
    return b.withColumn("scaled", execution.scale_to_risk("pos", "vol_24", 60.0, HOUR_YEAR))


@query("symbol ts~ turnover# cost# equity#", S.EL + f", bh AS (SELECT symbol, ts, open, 1.0::DOUBLE AS pos FROM el), {S.backtest('bh')}", "bt")
def buy_hold_backtest(spark, sf_dir):
    return execution.backtest(execution.buy_hold(hours(spark, sf_dir)))


@query("symbol sharpe#", f"{_NS}, {S.summarize('bt', 'symbol', DAY_YEAR)}, o AS (SELECT symbol, sharpe FROM sm ORDER BY round(sharpe, 6) DESC, symbol LIMIT 5)", "o")
def best_symbols(spark, sf_dir):
    s = execution.summarize(_nation_sma(spark, sf_dir), DAY_YEAR, ["symbol"])
    return s.orderBy(F.round("sharpe", 6).desc(), "symbol").limit(5)


# ---- panel


@query("symbol ts~ rank#", S.PN + """, rk AS (SELECT symbol, ts, (rank() OVER (PARTITION BY ts ORDER BY volume) + (count(*) OVER (PARTITION BY ts, volume) - 1) / 2.0) / count(*) OVER (PARTITION BY ts) AS rank, count(*) OVER (PARTITION BY ts) AS c
 FROM dn WHERE volume IS NOT NULL)""", "rk", "c >= 3")
def xs_rank_pct(spark, sf_dir):
    return panel.rank_pct(nations(spark, sf_dir), ["volume"]).where("rank is not null")


_SCREEN = S.PN + f""", lq0 AS (SELECT *, {S.roll('avg', 'volume', 30, order='time_pos', least=10)} AS trail FROM dn),
lq AS (SELECT *, CASE WHEN trail IS NOT NULL THEN rank() OVER (PARTITION BY time_pos ORDER BY -trail NULLS LAST) + (count(*) OVER (PARTITION BY time_pos, trail) - 1) / 2.0 END AS volume_rank FROM lq0)"""


@query("symbol time_pos& trail# volume_rank#", _SCREEN, "lq", "volume_rank <= 5.5")
def liquidity_screen(spark, sf_dir):
    return panel.liquidity_screen(nations(spark, sf_dir), 5, 30, 10).where("volume_rank <= 5.5")


def _top_sql(k: int, rebalance: int) -> str:
    return f"""tb0 AS (SELECT *, time_pos // {rebalance} AS blk, count(score) OVER (PARTITION BY time_pos) AS ns, row_number() OVER (PARTITION BY time_pos ORDER BY score DESC NULLS LAST, symbol) AS best,
 row_number() OVER (PARTITION BY time_pos ORDER BY score NULLS LAST, symbol DESC) AS worst FROM pn),
tb1 AS (SELECT symbol, blk, CASE WHEN ns >= {2 * k} THEN CASE WHEN score IS NULL THEN 0 WHEN best <= {k} THEN 1.0 / {k} WHEN worst <= {k} THEN -1.0 / {k} ELSE 0 END END::DOUBLE AS wv FROM tb0 WHERE time_pos % {rebalance} = 0),
tb2 AS (SELECT symbol, blk, coalesce(last_value(wv IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY blk ROWS UNBOUNDED PRECEDING), 0) AS held FROM tb1),
tb3 AS (SELECT p.*, CASE WHEN p.alive THEN coalesce(t.held, 0) ELSE 0 END AS w0 FROM pn p LEFT JOIN tb2 t ON p.symbol = t.symbol AND p.time_pos // {rebalance} = t.blk),
tb4 AS (SELECT *, sum(greatest(w0, 0)) OVER (PARTITION BY time_pos) AS up, sum(greatest(-w0, 0)) OVER (PARTITION BY time_pos) AS dn FROM tb3),
tb AS (SELECT *, CASE WHEN up > 0 AND dn > 0 AND w0 > 0 THEN w0 / up WHEN up > 0 AND dn > 0 AND w0 < 0 THEN w0 / dn ELSE 0 END AS w FROM tb4)"""


_TOP = S.PN + ", " + _top_sql(3, 10)


def _book(spark, sf_dir):
    return panel.top_book(nations(spark, sf_dir), "score", 3, 10)


@query("symbol time_pos& w#", _TOP, "tb", "w <> 0")
def topk_book(spark, sf_dir):
    return _book(spark, sf_dir).where("w <> 0")


@query("symbol time_pos& w#", S.PN + """, n0 AS (SELECT *, CASE WHEN alive THEN coalesce(score, 0) ELSE 0 END AS w0 FROM pn), n1 AS (SELECT *, sum(greatest(w0, 0)) OVER (PARTITION BY time_pos) AS up, sum(greatest(-w0, 0)) OVER (PARTITION BY time_pos) AS dn FROM n0),
o AS (SELECT symbol, time_pos, CASE WHEN up > 0 AND dn > 0 AND w0 > 0 THEN w0 / up WHEN up > 0 AND dn > 0 AND w0 < 0 THEN w0 / dn ELSE 0 END AS w FROM n1)""", "o", "w <> 0")
def neutralise(spark, sf_dir):
    p = nations(spark, sf_dir).withColumn("w", F.when(F.col("alive"), F.coalesce("score", F.lit(0.0))).otherwise(0.0))
    return panel.neutralise(p).where("w <> 0")


_EQ = S.PN + """, q0 AS (SELECT *, time_pos // 10 AS blk, alive::INT AS live, CASE WHEN alive THEN 1.0 / sum(alive::INT) OVER (PARTITION BY time_pos) ELSE 0 END AS share FROM pn),
eq AS (SELECT symbol, ts, time_pos, ret_next, first_value(share) OVER (PARTITION BY symbol, blk ORDER BY time_pos) * min(live) OVER (PARTITION BY symbol, blk ORDER BY time_pos ROWS UNBOUNDED PRECEDING) AS w FROM q0)"""


@query("symbol time_pos& w#", _EQ, "eq", "w <> 0")
def equal_weight_book(spark, sf_dir):
    return panel.equal_book(nations(spark, sf_dir), 10).where("w <> 0")


_STATIC = S.PN + """, st0 AS (SELECT *, alive AND symbol <> 'NATION_7' AS oth FROM pn), st AS (SELECT symbol, ts, time_pos, ret_next, CASE WHEN symbol = 'NATION_7' AND alive THEN 1 WHEN oth THEN -1.0 / sum(oth::INT) OVER (PARTITION BY time_pos) ELSE 0 END AS w FROM st0)"""


@query("symbol time_pos& w#", _STATIC, "st", "w <> 0")
def static_book(spark, sf_dir):
    return panel.static_book(nations(spark, sf_dir), "NATION_7").where("w <> 0")


@query("symbol time_pos& w#", S.PN + ", o AS (SELECT symbol, time_pos, 1.0 AS w FROM pn WHERE symbol = 'NATION_7' AND alive)", "o")
def only_book(spark, sf_dir):
    return panel.only_book(nations(spark, sf_dir), "NATION_7").where("w <> 0")


def _panel_bt(book: str, out: str, rate: str = "0.0008", key: str = "", group: str = "") -> str:
    p = f"PARTITION BY {key + ', ' if key else ''}symbol ORDER BY time_pos"
    run = f"{'PARTITION BY ' + key + ' ' if key else ''}ORDER BY time_pos ROWS UNBOUNDED PRECEDING"
    return f"""{out}0 AS (SELECT *, abs(w - coalesce(lag(w) OVER ({p}), 0)) AS tv FROM {book}),
{out}1 AS (SELECT {group}time_pos, ts, sum(w * coalesce(ret_next, 0)) AS gross, sum(tv) AS turnover, sum(abs(w)) AS pos FROM {out}0 GROUP BY ALL),
{out}2 AS (SELECT *, turnover * {rate} AS cost, gross - turnover * {rate} AS net FROM {out}1), {out} AS (SELECT *, exp(sum(net) OVER ({run})) AS equity FROM {out}2)"""


@query("time_pos& gross# turnover# cost# net# pos#", _TOP + ", " + _panel_bt("tb", "bk"), "bk")
def panel_backtest(spark, sf_dir):
    return panel.backtest(_book(spark, sf_dir), 8e-4)


@query("time_pos& cost# net#", _TOP + """, fu AS (SELECT *, coalesce(volume, 0) / 1e7 AS funding FROM tb), fv AS (SELECT *, abs(w - coalesce(lag(w) OVER (PARTITION BY symbol ORDER BY time_pos), 0)) AS tv FROM fu),
o AS (SELECT time_pos, sum(tv) * 0.0008 + sum(w * funding) AS cost, sum(w * coalesce(ret_next, 0)) - sum(tv) * 0.0008 - sum(w * funding) AS net FROM fv GROUP BY 1)""", "o")
def panel_funding(spark, sf_dir):
    return panel.backtest(_book(spark, sf_dir).withColumn("funding", F.col("volume") / 1e7), 8e-4, "funding")


@query("time_pos& net# pos#", _EQ + ", " + _panel_bt("eq", "bk"), "bk")
def equal_weight_benchmark(spark, sf_dir):
    return panel.backtest(panel.equal_book(nations(spark, sf_dir), 10), 8e-4)


_SLIP = (3.0, 25.0, 50.0, 100.0)


@query("slippage# " + S.MEASURES, _TOP + ", cs AS (SELECT tb.*, slippage FROM tb, (VALUES " + ", ".join(f"({x})" for x in _SLIP) + ") t(slippage)), " + _panel_bt("cs", "bk", "(5 + slippage) / 1e4", "slippage", "slippage, ") + ", " + S.summarize("bk", "slippage", DAY_YEAR, "time_pos"), "sm")
def cost_sensitivity(spark, sf_dir):
    book = _book(spark, sf_dir).select("symbol", "ts", "time_pos", "w", "ret_next")
    levels = book.withColumn("slippage", F.explode(F.array(*[F.lit(x) for x in _SLIP])))
    tested = panel.backtest(levels, by=["slippage"], extra=(F.col("slippage") + 5) / 1e4)
    return execution.summarize(tested, DAY_YEAR, ["slippage"], "time_pos")


# ---- audit


def _scored(spark, sf_dir):
    panel_ = nations(spark, sf_dir)
    p = panel.rank_pct(panel_, ["score"]).where("rank is not null").select("ts", "symbol", F.col("rank").alias("p"))
    y = labels.relative(panel_).where("y is not null").select("ts", "symbol", "time_pos", "y")
    return y.join(p, ["ts", "symbol"])


_SCORED = _RL + """, sk AS (SELECT symbol, ts, (rank() OVER (PARTITION BY ts ORDER BY score) + (count(*) OVER (PARTITION BY ts, score) - 1) / 2.0) / count(*) OVER (PARTITION BY ts) AS p, count(*) OVER (PARTITION BY ts) AS c FROM pn WHERE score IS NOT NULL),
sd AS (SELECT r.symbol, r.ts, r.time_pos, r.y, k.p FROM rl r JOIN sk k ON r.symbol = k.symbol AND r.ts = k.ts WHERE r.y IS NOT NULL AND k.c >= 3)"""


def _auc_sql(source: str, x: str, by: str, out: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    ties = f"PARTITION BY {by}, {x}" if by else f"PARTITION BY {x}"
    keys = f"{by}, " if by else ""
    return f"""{out}0 AS (SELECT *, rank() OVER ({part}ORDER BY {x}) + (count(*) OVER ({ties}) - 1) / 2.0 AS rk FROM {source} WHERE {x} IS NOT NULL AND y IS NOT NULL),
{out} AS (SELECT {keys}count(*) AS n, (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0)::DOUBLE AS auc FROM {out}0 GROUP BY ALL)"""


@query("fold& n& auc#", _SCORED + ", fo AS (SELECT *, time_pos // 400 AS fold FROM sd), " + _auc_sql("fo", "p", "fold", "au"), "au")
def auc_per_fold(spark, sf_dir):
    return audit.auc(_scored(spark, sf_dir).withColumn("fold", F.floor(F.col("time_pos") / 400)), "p", "y", ["fold"])


@query("n& auc#", _SCORED + ", po AS (SELECT *, 1 AS one FROM sd), " + _auc_sql("po", "p", "one", "au"), "au")
def auc_pooled(spark, sf_dir):
    return audit.auc(_scored(spark, sf_dir).withColumn("one", F.lit(1)), "p", "y", ["one"])


@query("symbol n& auc# accuracy# base_rate# lift#", _SCORED + ", " + _auc_sql("sd", "p", "symbol", "au") + """, ac AS (SELECT symbol, avg(((p >= 0.5)::INT = y)::INT) AS accuracy, greatest(avg(y), 1 - avg(y)) AS base_rate FROM sd GROUP BY 1),
 o AS (SELECT au.*, accuracy, base_rate, accuracy - base_rate AS lift FROM au JOIN ac USING (symbol))""", "o")
def auc_per_symbol(spark, sf_dir):
    return audit.per_symbol(_scored(spark, sf_dir), "p", "y")


_SF = _LB + f""", nx AS (SELECT symbol, ts, ret_1, vol_24, leak, CASE WHEN nr > 0 THEN 1 WHEN nr IS NOT NULL THEN 0 END AS y FROM (SELECT *, r AS ret_1, {S.roll('stddev_samp', 'r', 24)} AS vol_24, lead(r) OVER (PARTITION BY symbol ORDER BY ts) AS nr, lead(r) OVER (PARTITION BY symbol ORDER BY ts) AS leak FROM lb)),
lg AS (SELECT y, feature, value FROM nx UNPIVOT (value FOR feature IN (ret_1, vol_24, leak)))"""


@query("feature n& auc# leak", _SF + ", " + _auc_sql("lg", "value", "feature", "au0x") + ", o AS (SELECT feature, n, greatest(auc, 1 - auc) AS auc, greatest(auc, 1 - auc) > 0.65 AS leak FROM au0x WHERE n >= 100)", "o")
def single_feature_auc(spark, sf_dir):
    b = features.volatility(features.momentum(labels.next_bar_sign(hours(spark, sf_dir)))).withColumn("leak", F.col("ret"))
    return audit.single_feature_auc(b, ["ret_1", "vol_24", "leak"], "y")


_PNL = _TOP + ", pl AS (SELECT symbol, sum(w * coalesce(ret_next, 0)) AS pnl FROM tb GROUP BY 1)"


@query("symbol pnl#", _PNL, "pl")
def pnl_contribution(spark, sf_dir):
    return audit.pnl(_book(spark, sf_dir))


@query("share# n_dead&", _PNL + ", o AS (SELECT coalesce(sum(abs(pnl)) FILTER (symbol < 'NATION_15') / nullif(sum(abs(pnl)), 0), 0) AS share, count(*) FILTER (symbol < 'NATION_15') AS n_dead FROM pl)", "o")
def delisted_share(spark, sf_dir):
    return audit.share_of(audit.pnl(_book(spark, sf_dir)), F.col("symbol") < "NATION_15")


_CENSUS = _TOP + ", cn AS (SELECT count(ret_next) AS n, count(*) FILTER (exp(ret_next) - 1 > 0.65) AS extreme, count(*) FILTER (w < 0 AND ret_next IS NOT NULL) AS short_bars, count(*) FILTER (exp(ret_next) - 1 > 0.65 AND w < 0) AS hits FROM tb), wo AS (SELECT min(exp(r) - 1) AS worst_bar FROM (SELECT sum(w * coalesce(ret_next, 0)) AS r FROM tb GROUP BY time_pos))"


@query("n& extreme& short_bars& hits& expected# worst_bar#", _CENSUS + ", o AS (SELECT *, extreme * short_bars / nullif(n, 0)::DOUBLE AS expected FROM cn, wo)", "o")
def tail_census(spark, sf_dir):
    return audit.tail_census(_book(spark, sf_dir), 0.65)


_LEVELS = (0.25, 0.5, 0.65, 1.0, 2.0, 1e6)


@query("level# seen& estimated expected# cost_of_one= ruinous", _TOP + ", a AS (SELECT count(ret_next) AS n, max(CASE WHEN w < 0 THEN -w ELSE 0 END) AS most, count(*) FILTER (w < 0 AND ret_next IS NOT NULL) AS sb FROM tb), o AS (" + " UNION ALL ".join(
    f"SELECT {x}::DOUBLE AS level, seen, seen > 0 AS estimated, CASE WHEN seen > 0 THEN seen ELSE 3 END / n::DOUBLE * sb AS expected, {x} * most AS cost_of_one, {x} * most >= 1 AS ruinous FROM a, (SELECT count(*) FILTER (exp(ret_next) - 1 > {x}) AS seen FROM tb)" for x in _LEVELS) + ")", "o")
def tail_curve(spark, sf_dir):
    return audit.tail_curve(_book(spark, sf_dir), list(_LEVELS))


_CONC = _TOP + """, mt AS (SELECT time_pos, max(CASE WHEN w < 0 THEN -w ELSE 0 END) AS most FROM tb GROUP BY 1), fl AS (SELECT *, most > 0.3333333 + 1e-9 AS over_ FROM mt), il AS (SELECT over_, time_pos - row_number() OVER (PARTITION BY over_ ORDER BY time_pos) AS run FROM fl),
ln AS (SELECT coalesce(max(c), 0) AS longest FROM (SELECT count(*) AS c FROM il WHERE over_ GROUP BY run)), o AS (SELECT max(most) AS max_short, count(*) FILTER (over_) AS bars, count(*) FILTER (over_) / count(*)::DOUBLE AS share, (SELECT longest FROM ln) AS longest FROM fl)"""


@query("max_short# bars& share# longest&", _CONC, "o")
def concentration_runs(spark, sf_dir):
    return audit.concentration(_book(spark, sf_dir), 0.3333333)


@query("feature differs&")
def point_in_time_audit(spark, sf_dir):
    return audit.point_in_time(hours(spark, sf_dir), features.build, None, 12)


_SHUFFLED = _SCORED + """, sa AS (SELECT *, row_number() OVER (PARTITION BY time_pos ORDER BY symbol) AS k FROM sd), sb AS (SELECT time_pos, y AS z, row_number() OVER (PARTITION BY time_pos ORDER BY md5('0|' || time_pos || '|' || symbol), symbol) AS k FROM sd),
 po AS (SELECT sa.p, sb.z AS y, 1 AS one FROM sa JOIN sb USING (time_pos, k))"""


@query("n& auc#", _SHUFFLED + ", " + _auc_sql("po", "p", "one", "au"), "au")
def shuffled_label_auc(spark, sf_dir):
    rows = audit.shuffled(_scored(spark, sf_dir), "y", "time_pos")
    return audit.auc(rows.withColumn("one", F.lit(1)), "p", "y_shuffled", ["one"])


@query("n& auc#", _SCORED + ", po AS (SELECT *, 1 AS one FROM sd WHERE symbol >= 'NATION_15'), " + _auc_sql("po", "p", "one", "au"), "au")
def survivors_only_auc(spark, sf_dir):
    return audit.auc(_scored(spark, sf_dir).where("symbol >= 'NATION_15'").withColumn("one", F.lit(1)), "p", "y", ["one"])


# ---- ledger

_RUNS = [("a1", "run", "s=1;data.source=live", 7), ("a1", "run", "s=1;data.source=live", 5), ("a1", "xsec", "s=1;data.source=live", None), ("b2", "run", "s=2;k=3;data.source=live", 25), ("c3", "run", "s=2;k=4;data.source=synthetic", 99), ("d4", "sweep", "s=2;k=4;data.source=live", 0)]
_RUNS_SQL = "ru AS (SELECT * FROM (VALUES " + ", ".join(f"('{h}', '{c}', '{g}', {'NULL' if v is None else v})" for h, c, g, v in _RUNS) + ") t(config_hash, command, config, variants))"


def _runs(spark):
    return spark.createDataFrame(_RUNS, "config_hash string, command string, config string, variants int").withColumn("config", F.str_to_map("config", F.lit(";"), F.lit("=")))


@query("trials&", _RUNS_SQL + ", o AS (SELECT 3 + sum(v) AS trials FROM (SELECT max(greatest(coalesce(variants, 1), 1)) AS v FROM ru WHERE config NOT LIKE '%data.source=synthetic%' GROUP BY config_hash, command))", "o")
def ledger_trials(spark, sf_dir):
    return ledger.count_trials(_runs(spark), prior=3)


@query("config_hash command distance&", _RUNS_SQL + """, kv AS (SELECT row_number() OVER () AS id, config_hash, command, unnest(string_split(config, ';')) AS x FROM ru), kk AS (SELECT id, config_hash, command, split_part(x, '=', 1) AS k, split_part(x, '=', 2) AS v FROM kv),
 me AS (SELECT * FROM (VALUES ('s', '2'), ('k', '9'), ('data.source', 'live')) t(k, v)), ids AS (SELECT DISTINCT id, config_hash, command FROM kk), al AS (SELECT DISTINCT i.id, i.config_hash, i.command, k FROM ids i, (SELECT k FROM kk UNION SELECT k FROM me)),
 df AS (SELECT a.id, a.config_hash, a.command, a.k, kk.v IS DISTINCT FROM me.v AS d FROM al a LEFT JOIN kk ON a.id = kk.id AND a.k = kk.k LEFT JOIN me ON a.k = me.k),
 o AS (SELECT config_hash, command, count(*) FILTER (d) AS distance FROM df GROUP BY id, 1, 2 HAVING count(*) FILTER (d) BETWEEN 1 AND 3 AND count(*) FILTER (d AND k LIKE 'data.%') = 0)""", "o")
def near_miss_configs(spark, sf_dir):
    return ledger.near_misses(_runs(spark), {"s": "2", "k": "9", "data.source": "live"})


@query("best highest# worst lowest# symbols&", _SCORED + ", " + _auc_sql("sd", "p", "symbol", "au") + ", o AS (SELECT arg_min(symbol, (-auc, symbol)) AS best, max(auc) AS highest, arg_min(symbol, (auc, symbol)) AS worst, min(auc) AS lowest, count(*) AS symbols FROM au WHERE n >= 100 AND auc IS NOT NULL)", "o")
def best_and_worst(spark, sf_dir):
    return audit.best_and_worst(audit.auc(_scored(spark, sf_dir), "p", "y", ["symbol"]))


# ---- the negative pair

_LEAKY = S.EL + """, lk AS (SELECT symbol, exp(sum(CASE WHEN r > 0 THEN r ELSE 0 END)) AS leaky FROM el GROUP BY 1), hp AS (SELECT symbol, ts, open, coalesce((close > lag(close) OVER (PARTITION BY symbol ORDER BY ts))::INT, 0)::DOUBLE AS pos FROM el), """ + S.backtest("hp") + ", hn AS (SELECT symbol, exp(sum(net)) AS honest FROM bt GROUP BY 1), o AS (SELECT symbol, leaky, honest FROM lk JOIN hn USING (symbol))"


@query("symbol leaky= honest=", _LEAKY, "o")
def leaky_and_honest(spark, sf_dir):
    b = hours(spark, sf_dir)
    last = lambda df, name: df.groupBy("symbol").agg(F.max_by("equity", "ts").alias(name))
    return last(negative.backtest_leaky(b), "leaky").join(last(negative.backtest_honest(b), "honest"), "symbol")


# ---- costs


_MOVES = S.EL + """, cm AS (SELECT symbol, lc, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS at FROM el),
mv AS (SELECT a.symbol, h, avg(abs(a.lc - b.lc)) AS move FROM cm a, (SELECT unnest(range(1, 241)) AS h) JOIN cm b ON b.symbol = a.symbol AND b.at = a.at - h GROUP BY 1, 2),
ps AS (SELECT symbol, h, coalesce(0.1 * move >= 0.0024, true) AS ok FROM (SELECT DISTINCT symbol FROM cm) JOIN (SELECT unnest(range(1, 241)) AS h) ON true LEFT JOIN mv USING (symbol, h)),
bi AS (SELECT s.symbol, CASE WHEN o.ok THEN 0 ELSE 1 END AS low, CASE WHEN o.ok THEN 1 ELSE 240 END AS high, m.ok OR o.ok AS pays FROM (SELECT DISTINCT symbol FROM cm) s JOIN ps o ON o.symbol = s.symbol AND o.h = 1 JOIN ps m ON m.symbol = s.symbol AND m.h = 240
 UNION ALL SELECT bi.symbol, CASE WHEN ok THEN low ELSE h END, CASE WHEN ok THEN h ELSE high END, pays FROM bi JOIN ps ON ps.symbol = bi.symbol AND ps.h = (low + high) // 2 WHERE high - low > 1),
bh AS (SELECT symbol, CASE WHEN bool_and(pays) THEN min(high) END AS hold FROM bi GROUP BY 1)"""


@query("symbol hold&", _MOVES, "bh")
def breakeven_hold(spark, sf_dir):
    return costs.measured_breakeven(hours(spark, sf_dir), 0.55, costs.round_trip(), most=240)


# ---- models (no SQL can say these)


@query("fold& train& test& auc#")
def panel_auc(spark, sf_dir):
    names = ["ret_1", "ret_3", "ret_6", "vol_12", "z_12", "donch_24", "body", "hl_range"]
    rows, _ = panel.load(src.nation_bars(spark, sf_dir), lambda b: features.build(b, with_smoothed=False), names, "2001-11", horizon=5, least_bars=100)
    return models.fit_predict_panel(rows, names, validation.Split(n_folds=3, min_train=900, embargo=2, least=50), 5)[1]


@query("symbol fold& train& test& accuracy# auc#")
def ml_direction(spark, sf_dir):
    b = features.build(hours(spark, sf_dir), with_smoothed=False)
    return models.walk_forward_scores(models.with_label(b, labels.next_bar_sign), models.DEFAULT_FEATURES, validation.Split(n_folds=4, min_train=250, embargo=1, least=20), each=True)


@query("symbol feature drop#")
def permutation_importance(spark, sf_dir):
    b = features.build(hours(spark, sf_dir), with_smoothed=False)
    return models.importance(models.with_label(b, labels.next_bar_sign), models.DEFAULT_FEATURES, validation.Split(n_folds=4, min_train=250, embargo=1, least=20), each=True)


@query("symbol " + S.MEASURES)
def null_control(spark, sf_dir):
    b = execution.backtest(execution.sma_cross(synthetic.random_walk(spark, 4000, 4), 20, 80))
    return execution.summarize(b, HOUR_YEAR, ["symbol"])
