"""Queries over strategies, custom regimes and blocked signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantspan.operators import regimes as reg
from quantspan.operators import signals as sig
from quantspan.operators import strategies as st
from quantspan.plans import sql as q
from quantspan.plans.bars import MOVES, NY, RSI, TR, codes
from quantspan.sources import bars as src

QUERIES: dict = {}
SQL: dict[str, str] = {}
LB = 15


def add(name: str, sql: str | None, f) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


def before(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({q.W})"


def seeded(x: str, alpha: float, first: int) -> str:
    """A seeded mean of a column whose first value is at bar ``first``."""
    r = 1 - alpha
    return (
        f"(CASE WHEN bar_idx >= {first} THEN power({r!r}, bar_idx - {first}) * sum(CASE WHEN bar_idx = {first} THEN {x} "
        f"WHEN bar_idx > {first} THEN {alpha!r} * {x} * power({r!r}, {first} - bar_idx) END) OVER ({q.W}) END)"
    )


def raw(long: str, short: str, source: str) -> str:
    return f" SELECT asset, bar_idx, CASE WHEN coalesce({long}, false) THEN 1 WHEN coalesce({short}, false) THEN -1 ELSE 0 END AS raw FROM {source}"


def moved(long: str, short: str, source: str) -> str:
    """The signal of the bar before; the first bar keeps its own."""
    side = f"CASE WHEN coalesce({long}, false) THEN 1 WHEN coalesce({short}, false) THEN -1 ELSE 0 END"
    return f" SELECT asset, bar_idx, coalesce(lag(side) OVER ({q.W}), side) AS raw FROM (SELECT *, {side} AS side FROM {source})"


def rsi_of(n: int) -> str:
    return MOVES.replace(q.ewm("greatest(ch, 0)", 1 / 14, 14), q.ewm("greatest(ch, 0)", 1 / n, n)).replace(q.ewm("greatest(-ch, 0)", 1 / 14, 14), q.ewm("greatest(-ch, 0)", 1 / n, n))


def crossing(gap: str) -> tuple[str, str]:
    return f"({before(gap)} > 0 AND {before(gap, 2)} <= 0)", f"({before(gap)} < 0 AND {before(gap, 2)} >= 0)"


def range_of(n: int, source: str) -> str:
    return f", ra AS (SELECT *, {TR} AS tr FROM {source}), rb AS (SELECT *, {q.ewm('tr', 1 / n, n)} AS atr FROM ra)"


W = f"WITH {q.BARS}"
STEP = f", d0 AS (SELECT *, close - {before('close')} AS ds, close / {before('close')} - 1 AS ret FROM bars)"
up, down = crossing("gap")
STRATEGY_SQL = {
    "ema_cross": f"WITH {q.crossed(LB)} SELECT asset, bar_idx, raw FROM raws",
    "atr_cross_rsi": W + MOVES + f", h AS (SELECT *, {RSI} AS rsi FROM g)" + range_of(LB, "h")
    + f", rc AS (SELECT *, {q.full('avg', 'atr', 3)} - {seeded('atr', q.span(50), LB - 1)} AS gap FROM rb)" + raw(f"{up} AND {before('rsi')} >= 50", f"{down} AND {before('rsi')} >= 50", "rc"),
    "sma_cross_rsi": W + STEP + f", e AS (SELECT *, {seeded('greatest(ds, 0)', 1 / 14, 1)} AS ga, {seeded('greatest(-ds, 0)', 1 / 14, 1)} AS lo, {q.full('avg', 'close', LB)} AS f, {q.full('avg', 'close', 3 * LB)} AS s FROM d0), "
    + "h AS (SELECT *, 100 - 100 / (1 + ga / nullif(lo, 0)) AS rsi FROM e)" + raw(f"{before('f')} > {before('s')} AND {before('rsi')} >= 50", f"{before('f')} < {before('s')} AND {before('rsi')} < 50", "h"),
    "batch_ema_cross": W + f", e AS (SELECT *, {q.ema('close', q.span(LB))} AS f, {q.ema('close', q.span(4 * LB))} AS s FROM bars)" + moved("f > s", "f < s", "e"),
    "batch_atr_cross": W + rsi_of(LB) + f", h AS (SELECT *, {RSI} AS rsi, {q.full('avg', 'close', LB)} AS f, {q.full('avg', 'close', 4 * LB)} AS s FROM g)" + range_of(LB, "h")
    + moved("f > s + atr AND rsi >= 50", "f < s - atr AND rsi <= 50", "rb"),
    "batch_macd": W + f", e AS (SELECT *, {q.ema('close', q.span(LB))} - {q.ema('close', q.span(st.macd_lengths(LB)[1]))} AS m FROM bars), f AS (SELECT *, {q.ema('m', q.span(st.macd_lengths(LB)[2]))} AS s FROM e)" + moved("m > s", "m < s", "f"),
    "batch_rsi": W + rsi_of(LB) + f", h AS (SELECT *, {RSI} AS rsi FROM g)" + moved("rsi < 35", "rsi > 65", "h"),
    "batch_stochastic": W + f", h AS (SELECT *, 100 * (close - {q.full('min', 'low', LB)}) / nullif({q.full('max', 'high', LB)} - {q.full('min', 'low', LB)}, 0) AS k FROM bars)" + moved("k < 20", "k > 80", "h"),
    "volume_confirmed_cross": W + f", e AS (SELECT *, {q.ema('close', q.span(12))} - {q.ema('close', q.span(26))} AS gap, volume > 1.5 * {q.full('avg', 'volume', 20)} AS loud FROM bars)" + raw(f"{before('loud')} AND {up}", f"{before('loud')} AND {down}", "e"),
    "vwap_reversion": W + f", s0 AS (SELECT *, {NY}::DATE AS day FROM bars), s1 AS (SELECT *, CASE WHEN {before('day')} = day THEN 0 ELSE 1 END AS fresh FROM s0), s2 AS (SELECT *, sum(fresh) OVER ({q.W}) AS session FROM s1), "
    + "s3 AS (SELECT *, sum((high + low + close) / 3 * volume) OVER (PARTITION BY asset, session ORDER BY bar_idx) / sum(volume) OVER (PARTITION BY asset, session ORDER BY bar_idx) AS vw FROM s2), s4 AS (SELECT *, (close - vw) / vw AS away FROM s3)"
    + raw(f"{before('away')} <= -0.01", f"{before('away')} >= 0.01", "s4"),
    "obv_divergence": W + f", p0 AS (SELECT *, coalesce(sign(close - {before('close')}), 0) * volume AS fl FROM bars), p1 AS (SELECT *, sum(fl) OVER ({q.W}) AS obv FROM p0), p2 AS (SELECT *, close - {before('close', 14)} AS mv, obv - {before('obv', 14)} AS dr FROM p1)"
    + raw(f"{before('mv')} < 0 AND {before('dr')} > 0", f"{before('mv')} > 0 AND {before('dr')} < 0", "p2"),
    "volume_breakout": W + f", c0 AS (SELECT *, volume / nullif({q.full('avg', 'volume', 20)}, 0) >= 2 AS loud, CASE WHEN count(high) OVER {q.rows(20, 1)} = 20 THEN close > max(high) OVER {q.rows(20, 1)} END AS ab, CASE WHEN count(low) OVER {q.rows(20, 1)} = 20 THEN close < min(low) OVER {q.rows(20, 1)} END AS be FROM bars)"
    + raw(f"bar_idx >= 22 AND {before('loud')} AND {before('ab')}", f"bar_idx >= 22 AND {before('loud')} AND {before('be')}", "c0"),
    "ml_precomputed": W + STEP + f", z0 AS (SELECT *, {q.full('avg', 'ret', 50)} / nullif({q.full('stddev_samp', 'ret', 50)}, 0) AS z FROM d0), z1 AS (SELECT *, 1 / (1 + exp(-2 * coalesce({before('z')}, 0))) AS pred FROM z0)"
    + raw(f"{before('pred')} >= 0.55", f"{before('pred')} <= 0.45", "z1"),
    "ml_callback": W + f", z0 AS (SELECT *, ln(close) - ln({before('close')}) AS st FROM bars), z1 AS (SELECT *, {q.full('stddev_pop', 'st', LB - 1)} AS sd FROM z0), "
    + f"z2 AS (SELECT *, CASE WHEN bar_idx > {LB} AND {before('sd')} > 0 THEN 1 / (1 + exp(-(0.6 * {before('st', 3)} + 0.3 * {before('st', 2)} + 0.1 * {before('st')}) / {before('sd')})) END AS pred FROM z1)" + raw("pred >= 0.55", "pred <= 0.45", "z2"),
    "ml_logistic": None, "ml_forest": None,
}
for _name, _sql in STRATEGY_SQL.items():
    add(f"s13_{_name}", _sql, lambda s, d, n=_name: st.signals(src.bars_from_events(s, d), n, LB).select("asset", "bar_idx", "raw"))

# --- regimes -------------------------------------------------------------------------------------
VOL = W + STEP + f", v0 AS (SELECT *, {q.full('stddev_samp', 'ret', 50)} AS s0 FROM d0), v1 AS (SELECT *, {before('s0')} AS sd, {before('close')} - {before('close', 51)} AS tr, {before('ret')} AS r1 FROM v0)"
MED = f", v2 AS (SELECT *, CASE WHEN count(sd) OVER {q.rows(250)} = 250 THEN quantile_cont(sd, 0.5) OVER {q.rows(250)} END AS cut FROM v1)"
add("w24_two_regimes", VOL + MED + " SELECT asset, bar_idx, CASE WHEN sd > cut THEN 'Volatile' ELSE 'Calm' END AS regime FROM v2", lambda s, d: reg.volatility(src.bars_from_events(s, d)).select("asset", "bar_idx", "regime"))
add("w24_four_regimes", VOL + MED + " SELECT asset, bar_idx, CASE WHEN sd > cut THEN 'Vol' ELSE 'Calm' END || CASE WHEN tr > 0 THEN 'Up' ELSE 'Down' END AS regime FROM v2", lambda s, d: reg.volatility_trend(src.bars_from_events(s, d)).select("asset", "bar_idx", "regime"))
SCORE = VOL + ", u0 AS (SELECT *, coalesce(r1, 0) / nullif(sd, 0) AS sc FROM v1), u1 AS (SELECT *, coalesce(sc, 0) AS score FROM u0), u2 AS (SELECT asset, quantile_cont(score, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM u1 GROUP BY 1)"
add("w25_quantile_regimes", SCORE + " SELECT u1.asset, bar_idx, CASE WHEN len(list_distinct(e)) < 6 THEN 'R0' WHEN score <= e[2] THEN 'R0' WHEN score <= e[3] THEN 'R1' WHEN score <= e[4] THEN 'R2' WHEN score <= e[5] THEN 'R3' ELSE 'R4' END AS regime FROM u1 JOIN u2 ON u1.asset = u2.asset",
    lambda s, d: reg.quantiles(src.bars_from_events(s, d)).select("asset", "bar_idx", "regime"))
add("s13_ml_clusters", None, lambda s, d: reg.clusters(src.bars_from_events(s, d)).select("asset", "bar_idx", "regime"))

# --- blocked signals -----------------------------------------------------------------------------
BLOCKED = [("Ranging", "short"), (None, "long"), ("Downtrend", None)]


def filtered(s, d, blocked):
    rows = sig.regimes(codes(s, d))
    return reg.filtered(rows, s.createDataFrame(blocked, "regime string, side string")).select("asset", "bar_idx", "raw", "kept")


SIDES = "CASE raw WHEN 1 THEN 'long' WHEN -1 THEN 'short' END"
REGIMES = f", e AS (SELECT *, {q.ema('close', q.span(200))} AS e FROM codes), z AS (SELECT *, CASE WHEN {before('close')} > {before('e')} THEN 1 WHEN {before('close')} < {before('e')} THEN -1 ELSE 0 END AS sd FROM e), r AS (SELECT *, CASE WHEN sum((sd = 1)::INT) OVER {q.rows(8)} = 8 THEN 'Uptrend' WHEN sum((sd = -1)::INT) OVER {q.rows(8)} = 8 THEN 'Downtrend' ELSE 'Ranging' END AS regime FROM z)"
add("p7_blocked_pair", f"WITH {q.crossed()}{REGIMES} SELECT asset, bar_idx, raw, CASE WHEN regime = 'Ranging' AND raw = -1 THEN 0 ELSE raw END AS kept FROM r", lambda s, d: filtered(s, d, BLOCKED[:1]))
add("p7_blocked_all", f"WITH {q.crossed()}{REGIMES} SELECT asset, bar_idx, raw, CASE WHEN raw = 1 OR regime = 'Downtrend' OR (regime = 'Ranging' AND raw = -1) THEN 0 ELSE raw END AS kept FROM r", lambda s, d: filtered(s, d, BLOCKED))
# Entries are flips of the kept signals; a side that may not enter still ends the other's trades.
UNBLOCKED = f"WITH {q.crossed()}{REGIMES}, bl AS (SELECT * REPLACE (CASE WHEN regime = 'Ranging' AND raw = -1 THEN 0 ELSE raw END AS raw) FROM r), bh AS (SELECT * EXCLUDE (held, code), coalesce(last_value(nullif(raw, 0) IGNORE NULLS) OVER ({q.W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM bl)"
add("j16_kept_flips", f"{UNBLOCKED} SELECT asset, bar_idx, CASE WHEN raw <> 0 AND raw <> held THEN CASE raw WHEN 1 THEN 1 ELSE 3 END ELSE 0 END AS code FROM bh",
    lambda s, d: sig.flips(reg.filtered(sig.regimes(codes(s, d)), s.createDataFrame(BLOCKED[:1], "regime string, side string")).drop("code", "raw").withColumnRenamed("kept", "raw")).select("asset", "bar_idx", F.col("code")))
