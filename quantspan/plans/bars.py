"""Queries over bars, indicators, signals and trades."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspan.config import Costs
from quantspan.functions.windows import lag, rolling, w
from quantspan.operators import indicators as ind
from quantspan.operators import signals as sig
from quantspan.operators import simulate as sim
from quantspan.operators.sequential import simulate_sequential
from quantspan.plans import sql as q
from quantspan.sources import bars as src

QUERIES: dict = {}
SQL: dict[str, str] = {}
ID = ["asset", "bar_idx"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(x: Column | str, digits: int = 6) -> Column:
    return F.round(x, digits)


def of_bars(name: str, columns: Callable[[], dict[str, Column]], sql_columns: dict[str, str], digits: int = 6, before=None, ctes: str = "", source: str = "bars") -> None:
    """A query of columns over bars, made when it runs as they need a session, and the same in SQL."""

    def run(spark, sf_dir):
        bars = src.bars_from_events(spark, sf_dir)
        bars = before(bars) if before else bars
        return bars.select(*ID, *(rounded(c, digits).alias(k) if digits else c.alias(k) for k, c in columns().items()))

    shown = ", ".join(f"round({v}, {digits}) AS {k}" if digits else f"{v} AS {k}" for k, v in sql_columns.items())
    query(name, f"WITH {q.BARS}{ctes} SELECT asset, bar_idx, {shown} FROM {source}")(run)


@query("s19_tick_bars", f"WITH {q.BARS} SELECT asset, time, bar_idx, open, high, low, close, volume FROM bars")
def tick_bars(spark, sf_dir):
    return src.bars_from_events(spark, sf_dir).select("asset", "time", "bar_idx", "open", "high", "low", "close", "volume")


ORDER_BARS = "SELECT o_orderpriority AS asset, date_trunc('day', o_orderdate)::TIMESTAMP AS time, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close, count(*)::DOUBLE AS volume FROM orders GROUP BY 1, 2"


@query("s18_daily_bars", f"SELECT *, row_number() OVER (PARTITION BY asset ORDER BY time) - 1 AS bar_idx FROM ({ORDER_BARS})")
def daily_bars(spark, sf_dir):
    return src.bars_from_orders(spark, sf_dir)


GRID = f"""WITH {q.BARS}, ends AS (SELECT asset, min(time) AS a, max(time) AS b FROM bars GROUP BY 1), grid AS (SELECT asset, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS time FROM ends),
filled AS (SELECT g.asset, g.time, open, high, low, volume, last_value(close IGNORE NULLS) OVER (PARTITION BY g.asset ORDER BY g.time ROWS UNBOUNDED PRECEDING) AS c FROM grid g LEFT JOIN bars b ON g.asset = b.asset AND g.time = b.time)"""


@query("s4_regular_grid", f"{GRID} SELECT asset, time, coalesce(open, c) AS open, coalesce(high, c) AS high, coalesce(low, c) AS low, c AS close, coalesce(volume, 0) AS volume, row_number() OVER (PARTITION BY asset ORDER BY time) - 1 AS bar_idx FROM filled")
def grid(spark, sf_dir):
    return src.regular_grid(src.bars_from_events(spark, sf_dir))


@query("s2_panel_common_times", f"WITH {q.BARS}, t AS (SELECT time FROM bars GROUP BY time HAVING count(DISTINCT asset) = (SELECT count(DISTINCT asset) FROM bars)) SELECT asset, time, open, high, low, close, volume, row_number() OVER (PARTITION BY asset ORDER BY time) - 1 AS bar_idx FROM bars WHERE time IN (SELECT time FROM t)")
def common(spark, sf_dir):
    return src.common_times(src.bars_from_events(spark, sf_dir))


DELTAS = f"WITH {q.BARS}, d AS (SELECT asset, time, epoch(time)::BIGINT - lag(epoch(time)::BIGINT) OVER (PARTITION BY asset ORDER BY time) AS delta FROM bars), c AS (SELECT asset, delta, count(*) AS n, min(time) AS first_time FROM d WHERE delta IS NOT NULL GROUP BY 1, 2), m AS (SELECT asset, delta, n FROM c QUALIFY row_number() OVER (PARTITION BY asset ORDER BY n DESC, first_time) = 1)"
query("s4_modal_interval", f"{DELTAS} SELECT asset, delta, n::BIGINT AS n FROM m")(lambda s, d: src.modal_interval(src.bars_from_events(s, d)))
query("s5_first_gap", f"{DELTAS} SELECT d.asset, min(d.time) AS gap_time, count(*)::BIGINT AS gaps FROM d JOIN m ON d.asset = m.asset WHERE d.delta <> m.delta GROUP BY 1")(lambda s, d: src.first_gap(src.bars_from_events(s, d)))
query("p1_age_dataset", f"WITH {q.BARS} SELECT asset, bar_idx, close FROM (SELECT *, count(*) OVER (PARTITION BY asset) AS n FROM bars) WHERE bar_idx < n - 100")(lambda s, d: src.bars_from_events(s, d).withColumn("n", F.count("*").over(Window.partitionBy("asset"))).where("bar_idx < n - 100").select("asset", "bar_idx", "close"))


@query("p2_in_out_split", f"WITH {q.BARS}, s AS (SELECT *, count(*) OVER (PARTITION BY asset) AS n FROM bars) SELECT asset, CASE WHEN bar_idx >= n - 200 THEN 'OOS' ELSE 'IS' END AS sample, CASE WHEN bar_idx >= n - 200 THEN bar_idx - (n - 200) ELSE bar_idx - (n - 500) END AS idx, close FROM s WHERE bar_idx >= n - 500")
def split(spark, sf_dir):
    bars = src.bars_from_events(spark, sf_dir)
    sized = bars.join(bars.groupBy("asset").agg(F.count("*").alias("n")), "asset").where("bar_idx >= n - 500")
    out = F.col("bar_idx") >= F.col("n") - 200
    return sized.select("asset", F.when(out, "OOS").otherwise("IS").alias("sample"), (F.col("bar_idx") - F.col("n") + F.when(out, 200).otherwise(500)).alias("idx"), "close")


def local() -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("time"))


NY = "((time AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')"
MINUTES = f"(hour({NY}) * 60 + minute({NY}))"
minutes = lambda: F.hour(local()) * 60 + F.minute(local())
of_bars("p4_in_session", lambda: {"in_session": minutes().between(480, 1009)}, {"in_session": f"{MINUTES} BETWEEN 480 AND 1009"}, 0)
of_bars("p5_session_mask", lambda: {"session_end": F.coalesce(minutes().between(480, 1010) & ~F.coalesce(F.lead(minutes().between(480, 1010)).over(w()), F.lit(False)), F.lit(False))}, {"session_end": f"({MINUTES} BETWEEN 480 AND 1010) AND NOT coalesce(lead({MINUTES} BETWEEN 480 AND 1010) OVER ({q.W}), false)"}, 0)
of_bars("p6_funding_mask", lambda: {"funded": sim.funding_bar()}, {"funded": "hour(time) IN (0, 8, 16) AND minute(time) = 0"}, 0)

of_bars("w1_lag_diff_change", lambda: {"shifted": lag("close", 3), "diff": F.col("close") - lag("close"), "change": F.try_divide(F.col("close"), lag("close")) - 1}, {"shifted": f"lag(close, 3) OVER ({q.W})", "diff": f"close - lag(close) OVER ({q.W})", "change": f"close / lag(close) OVER ({q.W}) - 1"})
of_bars("w2_rolling", lambda: {"mean": rolling(F.avg, "close", 20), "low": rolling(F.min, "close", 20), "high": rolling(F.max, "close", 20), "total": rolling(F.sum, "volume", 20), "sd": rolling(F.stddev_samp, "close", 20), "var0": rolling(F.var_pop, "close", 20)}, {"mean": q.full("avg", "close", 20), "low": q.full("min", "close", 20), "high": q.full("max", "close", 20), "total": q.full("sum", "volume", 20), "sd": q.full("stddev_samp", "close", 20), "var0": q.full("var_pop", "close", 20)}, 8)
of_bars("w2_rolling_median", lambda: {"median": rolling(lambda x: F.percentile(x, 0.5), "close", 21)}, {"median": f"CASE WHEN count(close) OVER {q.rows(21)} = 21 THEN quantile_cont(close, 0.5) OVER {q.rows(21)} END"})
of_bars("w3_ema", lambda: {"ema_20": F.col("ema_20"), "ema_50": F.col("ema_50"), "ema_200": F.col("ema_200")}, {f"ema_{n}": q.ema("close", q.span(n)) for n in (20, 50, 200)}, before=lambda b: ind.emas(b, [20, 50, 200]))
of_bars("w4_ewm_adjusted", lambda: {"mean": F.col("mean")}, {"mean": q.ewm("close", 1 / 14, 14)}, before=lambda b: ind.with_ewm(b, [ind.Ewm("mean", "close", 1 / 14, True, 14)]))
of_bars("w5_sma", lambda: {"sma": ind.sma(30)}, {"sma": q.full("avg", "close", 30)})
of_bars("w6_macd", lambda: {"macd": F.col("macd"), "signal": F.col("macd_signal"), "hist": F.col("macd_hist")}, {"macd": "m", "signal": q.ema("m", 0.2), "hist": f"m - {q.ema('m', 0.2)}"}, 5, ind.macd, f", x AS (SELECT *, {q.ema('close', q.span(12))} - {q.ema('close', q.span(26))} AS m FROM bars)", "x")
MOVES = f", d AS (SELECT *, coalesce(close - lag(close) OVER ({q.W}), 0) AS ch FROM bars), g AS (SELECT *, {q.ewm('greatest(ch, 0)', 1 / 14, 14)} AS mg, {q.ewm('greatest(-ch, 0)', 1 / 14, 14)} AS ml FROM d)"
RSI = "(CASE WHEN ml = 0 AND mg = 0 THEN NULL WHEN ml = 0 THEN 100 ELSE 100 - 100 / (1 + mg / ml) END)"
of_bars("w7_rsi", lambda: {"rsi": F.col("rsi")}, {"rsi": RSI}, 5, ind.rsi, MOVES, "g")
TR = f"greatest(high - low, abs(high - lag(close) OVER ({q.W})), abs(low - lag(close) OVER ({q.W})))"
of_bars("w8_atr", lambda: {"atr": F.col("atr")}, {"atr": q.ewm("tr", 1 / 14, 14)}, 6, ind.atr, f", d AS (SELECT *, {TR} AS tr FROM bars)", "d")
of_bars("w9_stochastic", lambda: {"k": ind.stochastic(14)}, {"k": f"100 * (close - {q.full('min', 'low', 14)}) / nullif({q.full('max', 'high', 14)} - {q.full('min', 'low', 14)}, 0)"})
of_bars("w10_typical_price", lambda: {"tp": ind.typical_price()}, {"tp": "(high + low + close) / 3"})
of_bars("w11_volume", lambda: {"sma": rolling(F.avg, "volume", 20), "ema": F.col("vema"), "relative": ind.relative_volume(20)}, {"sma": q.full("avg", "volume", 20), "ema": q.ema("volume", q.span(20)), "relative": f"volume / nullif({q.full('avg', 'volume', 20)}, 0)"}, before=lambda b: ind.with_ewm(b, [ind.span("vema", "volume", 20)]))
of_bars("w12_volume_zscore", lambda: {"z": ind.volume_zscore(20)}, {"z": f"CASE WHEN {q.full('var_pop', 'volume', 20)} > 1e-300 THEN (volume - {q.full('avg', 'volume', 20)}) / sqrt({q.full('var_pop', 'volume', 20)}) END"})
of_bars("w13_obv", lambda: {"obv": ind.obv()}, {"obv": f"sum(coalesce(sign(close - pc), 0) * volume) OVER ({q.W})"}, 6, lambda b: b.withColumn("previous_close", lag("close")), f", p AS (SELECT *, lag(close) OVER ({q.W}) AS pc FROM bars)", "p")
MFM = "(CASE WHEN high = low THEN 0 ELSE ((close - low) - (high - close)) / (high - low) END)"
of_bars("w14_ad_line", lambda: {"ad": ind.ad_line()}, {"ad": f"sum({MFM} * volume) OVER ({q.W})"})
FLOW = f", t AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), u AS (SELECT *, tp * volume AS fl, tp - lag(tp) OVER ({q.W}) AS ch FROM t), v AS (SELECT *, sum(CASE WHEN ch > 0 THEN fl ELSE 0 END) OVER {q.rows(14)} AS up, sum(CASE WHEN ch < 0 THEN fl ELSE 0 END) OVER {q.rows(14)} AS down FROM u)"
of_bars("w15_mfi", lambda: {"mfi": F.col("mfi")}, {"mfi": "CASE WHEN bar_idx < 14 OR (up = 0 AND down = 0) THEN NULL WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END"}, 6, ind.mfi, FLOW, "v")
of_bars("w16_vwap_rolling", lambda: {"vwap": ind.vwap_rolling(20)}, {"vwap": f"CASE WHEN count(close) OVER {q.rows(20)} = 20 THEN sum((high + low + close) / 3 * volume) OVER {q.rows(20)} / sum(volume) OVER {q.rows(20)} END"})
SESS = f", s AS (SELECT *, sum(CASE WHEN lag_day IS NULL OR lag_day <> day THEN 1 ELSE 0 END) OVER ({q.W}) AS session FROM (SELECT *, lag(day) OVER ({q.W}) AS lag_day FROM (SELECT *, {NY}::DATE AS day FROM bars)))"
of_bars("w17_vwap_session", lambda: {"vwap": F.col("vwap"), "session": F.col("session").cast("double")}, {"vwap": "sum((high + low + close) / 3 * volume) OVER (PARTITION BY asset, session ORDER BY bar_idx) / sum(volume) OVER (PARTITION BY asset, session ORDER BY bar_idx)", "session": "session::DOUBLE"}, 6, ind.vwap_session, SESS, "s")
of_bars("w18_session_resets", lambda: {"reset": ind.session_resets(17)}, {"reset": "coalesce(lag_day <> day, true)"}, 0, None, f", s AS (SELECT *, lag(day) OVER ({q.W}) AS lag_day FROM (SELECT *, ({NY} - INTERVAL 17 HOUR)::DATE AS day FROM bars))", "s")


def codes(spark, sf_dir, slow: int = 50) -> DataFrame:
    return sig.flips(sig.ema_cross(src.bars_from_events(spark, sf_dir), slow))


query("w19_flips", f"WITH {q.crossed()} SELECT asset, bar_idx, raw, code FROM codes")(lambda s, d: codes(s, d).select(*ID, "raw", "code"))
query("w20_ema_cross", f"WITH {q.crossed(35)} SELECT asset, bar_idx, raw FROM raws")(lambda s, d: sig.ema_cross(src.bars_from_events(s, d), 35).select(*ID, "raw"))
query("p10_drift_entries", f"WITH {q.crossed()} SELECT asset, bar_idx, CASE WHEN lag(code) OVER ({q.W}) IN (1, 3) THEN lag(code) OVER ({q.W}) ELSE 0 END AS code FROM codes")(lambda s, d: sig.drifted(codes(s, d)).select(*ID, "code"))


def regime_sql(shift: int) -> str:
    c, e = (f"lag({x}) OVER ({q.W})" if shift else x for x in ("close", "e"))
    return f", e AS (SELECT *, {q.ema('close', q.span(200))} AS e FROM bars), z AS (SELECT *, CASE WHEN {c} > {e} THEN 1 WHEN {c} < {e} THEN -1 ELSE 0 END AS sd FROM e), r AS (SELECT *, CASE WHEN sum((sd = 1)::INT) OVER {q.rows(8)} = 8 THEN 'Uptrend' WHEN sum((sd = -1)::INT) OVER {q.rows(8)} = 8 THEN 'Downtrend' ELSE 'Ranging' END AS regime FROM z)"


query("w22_regimes", f"WITH {q.BARS}{regime_sql(1)} SELECT asset, bar_idx, regime FROM r")(lambda s, d: sig.regimes(src.bars_from_events(s, d)).select(*ID, "regime"))
query("w23_panel_regimes", f"WITH {q.BARS}{regime_sql(0)} SELECT asset, bar_idx, regime FROM r")(lambda s, d: sig.regimes(src.bars_from_events(s, d), 0).select(*ID, "regime"))
query("a8_regime_shares", f"WITH {q.BARS}{regime_sql(1)} SELECT asset, regime, count(*)::BIGINT AS bars, round(count(*) / sum(count(*)) OVER (PARTITION BY asset), 6) AS share FROM r GROUP BY 1, 2")(
    lambda s, d: sig.regimes(src.bars_from_events(s, d)).groupBy("asset", "regime").agg(F.count("*").alias("bars")).withColumn("share", rounded(F.col("bars") / F.sum("bars").over(Window.partitionBy("asset")))))


@query("j14_market_regime", f"WITH {q.BARS}{regime_sql(0)} SELECT b.asset, b.bar_idx, m.regime AS market FROM bars b JOIN (SELECT time, regime FROM r WHERE asset = 'view') m ON b.time = m.time")
def market_regime(spark, sf_dir):
    bars = src.bars_from_events(spark, sf_dir)
    market = sig.regimes(bars.where("asset = 'view'"), 0).select("time", F.col("regime").alias("market"))
    return bars.join(market, "time").select(*ID, "market")


@query("w21_regime_rotated", f"WITH {q.BARS}{regime_sql(1)}, l AS (SELECT *, {q.ema('close', q.span(20))} AS f, {q.ema('close', q.span(30))} AS e30, {q.ema('close', q.span(60))} AS e60, {q.ema('close', q.span(90))} AS e90 FROM r) SELECT asset, bar_idx, CASE WHEN f > CASE regime WHEN 'Uptrend' THEN e30 WHEN 'Downtrend' THEN e60 ELSE e90 END THEN 1 ELSE -1 END AS raw FROM l")
def rotated(spark, sf_dir):
    """The slow mean is looked up by the regime: the map of look-backs is data, joined once."""
    bars = sig.regimes(ind.emas(src.bars_from_events(spark, sf_dir), [20, 30, 60, 90, 200]))
    lookbacks = spark.createDataFrame([("Uptrend", 30), ("Downtrend", 60), ("Ranging", 90)], "regime string, lb int")
    slow = F.create_map(*(x for n in (30, 60, 90) for x in (F.lit(n), F.col(f"ema_{n}"))))
    return bars.join(F.broadcast(lookbacks), "regime").select(*ID, F.when(F.coalesce(F.col("ema_20") > F.element_at(slow, F.col("lb")), F.lit(False)), 1).otherwise(-1).alias("raw"))


# --- entry rules ---------------------------------------------------------------------------------
N = 20
L = lambda x, k=1: f"lag({x}, {k}) OVER ({q.W})"
RULES = f""", d AS (SELECT *, coalesce(close - lag(close) OVER ({q.W}), 0) AS ch, {TR} AS tr FROM bars), g AS (SELECT *, {q.ewm('greatest(ch, 0)', 1 / 14, 14)} AS mg, {q.ewm('greatest(-ch, 0)', 1 / 14, 14)} AS ml, {q.ewm('tr', 1 / N, N)} AS atrn FROM d),
r1 AS (SELECT *, {RSI} AS rsi, close / {L('close')} - 1 AS ret, close - {L('close')} AS df, close - {L('close', 2)} AS df2, abs(close - open) AS body, high - low AS rg,
  {q.full('min', 'close', N)} AS lown, {q.full('max', 'close', N)} AS highn FROM g),
r2 AS (SELECT *, ret - {q.full('avg', 'ret', N)} AS dev, (ret - {q.full('avg', 'ret', N)}) / nullif({q.full('stddev_samp', 'ret', N)}, 0) AS z, CASE WHEN abs(df) > nullif({q.full('stddev_samp', 'df', N)}, 0) THEN 1.0 ELSE 0.0 END AS burst,
  {q.full('var_pop', 'df2', N)} / nullif({q.full('var_pop', 'df', N)} * 2, 0) AS vr, {q.full('min', 'atrn', N)} AS alow, {q.full('max', 'atrn', N)} AS ahigh, (close - {L('lown')}) / nullif({L('highn')} - {L('lown')}, 0) AS place FROM r1),
r3 AS (SELECT *, power(dev, 2) AS dev2, power(dev, 4) AS dev4, power(z, 3) AS z3 FROM r2),
r4 AS (SELECT *, {q.full('avg', 'dev2', N)} AS m2, {q.full('avg', 'z3', N)} AS skew, {q.full('avg', 'burst', N)} AS bf, body < rg * 0.1 AS tiny, coalesce(close > open AND low > {L('close', 5)}, false) AS green,
  coalesce(rg > 1.3 * {q.full('avg', 'rg', 20)}, false) AS spike, coalesce({q.full('max', 'close', 3)} = {L('close')}, false) AS peak, coalesce(abs(close / {L('close', 10)} - 1) < 0.005, false) AS flat,
  coalesce({L('high')} <= high AND {L('low')} >= low, false) AS inside, (close > open) = coalesce({L('close')} > {L('open')}, false) AS same, coalesce(close > 0.99 * {q.full('max', 'high', 50)}, false) AS top,
  coalesce({q.full('stddev_samp', 'rg', 10)} < {q.full('stddev_samp', 'rg', 100)}, false) AS contracted, coalesce(abs(close - {q.full('avg', 'close', 21)}) < 0.92 * rg, false) AS hug, {q.full('avg', 'dev4', N)} AS m4 FROM r3),
r5 AS (SELECT *, m4 / nullif(power(m2, 2), 0) AS kappa FROM r4)"""
ATRP = f"({L('atrn')} - {L('alow')}) / nullif({L('ahigh')} - {L('alow')}, 0)"
RULE_SQL = {
    "RSIge50": f"{L('rsi')} >= 50", "RSIge40": f"{L('rsi')} >= 40", "pi": f"{L('body')} / nullif({L('atrn')}, 0) BETWEEN pi() / 4 - 0.05 AND pi() / 4 + 0.05", "vr": f"{L('vr')} >= 1", "kurtosis": f"{L('kappa')} >= 5", "kurtosis10": f"{L('kappa')} >= 10",
    "skew": f"abs({L('skew')}) >= 0.5", "skew0.75": f"abs({L('skew')}) >= 0.75", "atr_pct": f"{ATRP} >= 0.7", "atr_pct0.8": f"{ATRP} >= 0.8", "burstfreq": f"{L('bf')} >= 0.2", "TinyBody": L("tiny"), "NoNewLowGreen": L("green"), "RangeSpike": L("spike"),
    "YesterdayPeak": L("peak"), "DeadFlat10": L("flat"), "InsideBar": L("inside"), "SameDirection": L("same"), "TopOfRange": L("top"), "VolContraction": L("contracted"), "EMAHug": L("hug"),
}
LONG_SHORT = {k: (v, v) for k, v in RULE_SQL.items()} | {"Pge0.8": (f"{L('place')} >= 0.8", f"{L('place')} <= 0.2"), "Pge0.7": (f"{L('place')} >= 0.7", f"{L('place')} <= 0.3"), "BW_filter": (f"NOT coalesce(coalesce({L('body')} / nullif({L('rg')}, 0), 0) <= 0.7, false)", "true")}


@query("p_confluence_rules", f"WITH {q.BARS}{RULES} SELECT asset, bar_idx, " + ", ".join(f"coalesce({a}, false) AS \"long_{k}\", coalesce({b}, false) AS \"short_{k}\"" for k, (a, b) in LONG_SHORT.items()) + " FROM r5")
def confluence_rules(spark, sf_dir):
    """All entry rules at once, for longs and shorts."""
    flags = sig.rule_flags(src.bars_from_events(spark, sf_dir), N)
    return flags.select(*ID, *(c.alias(f"{side}_{k}") for k, pair in sig.entry_rules(N).items() for side, c in zip(("long", "short"), pair, strict=True)))


# --- trades --------------------------------------------------------------------------------------
TRADE = "trade_group_id, leg_id, side, entry_idx, exit_idx, round(entry_price, 6) AS entry_price, round(exit_price, 6) AS exit_price, round(qty, 6) AS qty, round(pnl, 6) AS pnl, round(fee, 6) AS fee, round(slippage, 6) AS slippage, round(funding, 6) AS funding, round(pnl + fee + slippage + funding, 5) AS gross_pnl, exit_kind"


def shown(trades: DataFrame, *keys: str) -> DataFrame:
    return trades.select(*(keys or ("asset",)), "trade_group_id", "leg_id", "side", "entry_idx", "exit_idx", *(rounded(c).alias(c) for c in ("entry_price", "exit_price", "qty", "pnl", "fee", "slippage", "funding")), rounded("gross_pnl", 5).alias("gross_pnl"), "exit_kind")


def shown_metrics(m: DataFrame, *keys: str) -> DataFrame:
    digits = {"roi": 6, "pf": 4, "win_rate": 6, "exp": 8, "sharpe": 5, "max_drawdown": 6, "consistency": 6}
    return m.select(*(keys or ("asset",)), "trades", *(rounded(c, n).alias(c) for c, n in digits.items()))


query("k8_simulate", f"WITH {q.crossed()}, {q.trades()} SELECT asset, {TRADE} FROM trades")(lambda s, d: shown(sim.simulate(codes(s, d))))
query("k3_clamped", f"WITH {q.crossed()}, {q.trades(clamp=True)} SELECT asset, {TRADE} FROM trades")(lambda s, d: shown(sim.simulate(codes(s, d), Costs(clamp=True))))
query("k4_stop_only", f"WITH {q.crossed()}, {q.trades(use_target=False)} SELECT asset, {TRADE} FROM trades")(lambda s, d: shown(sim.simulate(codes(s, d), Costs(use_target=False))))
query("k4_target_only", f"WITH {q.crossed()}, {q.trades(use_stop=False)} SELECT asset, {TRADE} FROM trades")(lambda s, d: shown(sim.simulate(codes(s, d), Costs(use_stop=False))))
query("k5_flips_only", f"WITH {q.crossed()}, {q.trades(use_stop=False, use_target=False)} SELECT asset, {TRADE} FROM trades")(lambda s, d: shown(sim.simulate(codes(s, d), Costs(use_stop=False, use_target=False))))
query("a1_metrics", f"WITH {q.crossed()}, {q.trades()} {q.metrics()}")(lambda s, d: shown_metrics(sim.metrics(sim.simulate(codes(s, d)))))
query("p10_drifted_trades", f"WITH {q.crossed()}, dr AS (SELECT * REPLACE (CASE WHEN lag(code) OVER ({q.W}) IN (1, 3) THEN lag(code) OVER ({q.W}) ELSE 0 END AS code) FROM codes), {q.trades('dr')} {q.metrics()}")(lambda s, d: shown_metrics(sim.metrics(sim.simulate(sig.drifted(codes(s, d))))))
query("k2_cost_identity", f"WITH {q.crossed()}, {q.trades()} SELECT asset, count(*)::BIGINT AS trades, round(sum(pnl + fee + slippage + funding), 4) AS gross, round(sum(fee), 4) AS fee, round(sum(slippage), 4) AS slippage, round(sum(funding), 4) AS funding, round(sum(pnl), 4) AS net, 0::BIGINT AS broken FROM trades GROUP BY 1")(
    lambda s, d: sim.simulate(codes(s, d)).groupBy("asset").agg(F.count("*").alias("trades"), *(rounded(F.sum(c), 4).alias(n) for c, n in (("gross_pnl", "gross"), ("fee", "fee"), ("slippage", "slippage"), ("funding", "funding"), ("net_pnl", "net"))), F.sum((F.abs(F.col("gross_pnl") - F.col("fee") - F.col("slippage") - F.col("funding") - F.col("net_pnl")) > 1e-9).cast("long")).alias("broken")))
EQ = "SELECT *, pnl / 100000.0 AS ret, 1 + sum(pnl / 100000.0) OVER (PARTITION BY asset ORDER BY trade_group_id) AS eq FROM trades"
query("w27_equity_drawdown", f"WITH {q.crossed()}, {q.trades()}, e AS ({EQ}) SELECT asset, trade_group_id, round(eq, 8) AS equity, round((greatest(max(eq) OVER w, 1) - eq) / greatest(max(eq) OVER w, 1), 8) AS drawdown FROM e WINDOW w AS (PARTITION BY asset ORDER BY trade_group_id)")(
    lambda s, d: sim.equity(sim.simulate(codes(s, d))).select("asset", "trade_group_id", rounded("equity", 8).alias("equity"), rounded("drawdown", 8).alias("drawdown")))


@query("j10_trade_bars", f"WITH {q.crossed()}, {q.trades()} SELECT t.asset, trade_group_id, a.time AS entry_time, a.close AS close_entry, b.time AS exit_time, b.close AS close_exit, round(pnl, 6) AS pnl FROM trades t JOIN bars a ON a.asset = t.asset AND a.bar_idx = entry_idx JOIN bars b ON b.asset = t.asset AND b.bar_idx = exit_idx")
def trade_bars(spark, sf_dir):
    signals = codes(spark, sf_dir)
    at = lambda k: signals.select("asset", F.col("bar_idx").alias(f"{k}_idx"), F.col("time").alias(f"{k}_time"), F.col("close").alias(f"close_{k}"))
    return sim.simulate(signals).join(at("entry"), ["asset", "entry_idx"]).join(at("exit"), ["asset", "exit_idx"]).select("asset", "trade_group_id", "entry_time", "close_entry", "exit_time", "close_exit", rounded("pnl").alias("pnl"))


@query("l5_representative_trades", f"WITH {q.crossed()}, {q.trades()} SELECT asset, trade_group_id, side, round(pnl, 6) AS pnl FROM (SELECT *, count(*) OVER (PARTITION BY asset) AS n FROM trades) WHERE trade_group_id IN (0, n // 4, n // 2, 3 * n // 4, n - 1)")
def representative(spark, sf_dir):
    trades = sim.simulate(codes(spark, sf_dir))
    n = F.count("*").over(Window.partitionBy("asset"))
    picked = trades.withColumn("n", n).where(F.expr("trade_group_id in (0, n div 4, n div 2, 3 * n div 4, n - 1)"))
    return picked.select("asset", "trade_group_id", "side", rounded("pnl").alias("pnl"))


@query("a6_regime_filter", f"WITH {q.crossed()}, {q.trades()}{regime_sql(1).replace('SELECT *, ' + q.ema('close', q.span(200)), 'SELECT *, ' + q.ema('close', q.span(200)))}, j AS (SELECT t.*, r.regime FROM trades t JOIN r ON r.asset = t.asset AND r.bar_idx = t.entry_idx) SELECT asset, regime, side, count(*)::BIGINT AS trades, round(sum(pnl), 4) AS pnl, count(*) > 3 AND coalesce(sum(pnl) FILTER (pnl > 0), 0) < coalesce(-sum(pnl) FILTER (pnl <= 0), 0) AS blocked FROM j GROUP BY 1, 2, 3")
def regime_filter(spark, sf_dir):
    """Trades by the regime at entry and side; a bucket of more than a few trades that loses is blocked."""
    signals = codes(spark, sf_dir)
    regime = sig.regimes(signals).select("asset", F.col("bar_idx").alias("entry_idx"), "regime")
    won, lost = F.coalesce(F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("pnl") <= 0, -F.col("pnl"))), F.lit(0.0))
    return sim.simulate(signals).join(regime, ["asset", "entry_idx"]).groupBy("asset", "regime", "side").agg(F.count("*").alias("trades"), rounded(F.sum("pnl"), 4).alias("pnl"), ((F.count("*") > 3) & (won < lost)).alias("blocked"))


# --- bar by bar ----------------------------------------------------------------------------------
HELD = ["asset", "trade_group_id", "side", "entry_idx", "exit_idx", "exit_kind"]
HELD_SQL = "SELECT asset, trade_group_id, side, entry_idx, exit_idx, exit_kind, round(pnl, 6) AS pnl FROM st"
SESSIONS = f"sess AS (SELECT *, {MINUTES} BETWEEN 480 AND 1010 AS ins, ({MINUTES} BETWEEN 480 AND 1010) AND NOT coalesce(lead({MINUTES} BETWEEN 480 AND 1010) OVER ({q.W}), false) AS fin FROM codes)"
query("k6_hold_cap", f"WITH RECURSIVE {q.crossed()}, {q.stepped('codes', 10)} {HELD_SQL}")(lambda s, d: simulate_sequential(codes(s, d), Costs(max_hold=10)).select(*HELD, rounded("pnl").alias("pnl")))
query("k6_sessions", f"WITH RECURSIVE {q.crossed()}, {SESSIONS}, {q.stepped('sess', 0, 'ins', 'fin')} {HELD_SQL}")(lambda s, d: simulate_sequential(codes(s, d).withColumn("inside", minutes().between(480, 1010)).withColumn("ending", F.col("inside") & ~F.coalesce(F.lead("inside").over(w()), F.lit(False))), Costs(), session="inside", session_end="ending").select(*HELD, rounded("pnl").alias("pnl")))
query("k8_sequential", f"WITH {q.crossed()}, {q.trades()} SELECT asset, trade_group_id, side, entry_idx, exit_idx, exit_kind, round(pnl, 6) AS pnl FROM trades")(lambda s, d: simulate_sequential(codes(s, d)).select(*HELD, rounded("pnl").alias("pnl")))
RISKS = q.metrics("st").replace("pnl / 100000.0", "pnl").replace("1 + sum(", "sum(").replace(", 1.0) - eq) / greatest(max(eq) OVER (PARTITION BY asset ORDER BY trade_group_id ROWS UNBOUNDED PRECEDING), 1.0)", ", 0.0) - eq)")
query("k8_forex", f"WITH RECURSIVE {q.crossed()}, {q.stepped('codes', pip=0.01)} {RISKS}")(lambda s, d: shown_metrics(sim.metrics(simulate_sequential(codes(s, d), Costs.forex(pip=0.01, stop_pct=100.0, target_pct=300.0)), Costs.forex(pip=0.01))))
