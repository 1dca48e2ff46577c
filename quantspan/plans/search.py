"""Queries over sweeps, walk-forward runs, scenarios and statistics."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quantspan.config import Costs
from quantspan.functions.windows import w
from quantspan.operators import search as se
from quantspan.operators import simulate as sim
from quantspan.operators import stats, sweep
from quantspan.plans import sql as q
from quantspan.plans.bars import codes, regime_sql, rounded, shown_metrics
from quantspan.sources import bars as src

QUERIES: dict = {}
SQL: dict[str, str] = {}
LBS = list(se.LOOKBACKS)


def add(name: str, sql: str | None, f) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


def swept(source: str = "bars", keys: str = "asset", p: str = "") -> str:
    """Codes of the EMA cross of every look-back over ``source``: CTEs whose names start with ``p``, the last one ``sc``."""
    over = f"PARTITION BY {keys}, lb ORDER BY bar_idx"
    ema = lambda a: f"power(1 - {a}, bar_idx) * sum(CASE WHEN bar_idx = 0 THEN close ELSE {a} * close * power(1 - {a}, -bar_idx) END) OVER ({over})"
    return f"""{p}lbs AS (SELECT unnest({LBS}) AS lb), {p}se AS (SELECT s.*, lb, {ema('(2.0 / 21)')} AS ef, {ema('(2.0 / (lb + 1))')} AS es FROM {source} s, {p}lbs),
{p}sr AS (SELECT *, coalesce(sign(lag(ef) OVER ({over}) - lag(es) OVER ({over})), 0)::INT AS raw FROM {p}se),
{p}sh AS (SELECT *, coalesce(last_value(nullif(raw, 0) IGNORE NULLS) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM {p}sr),
{p}sc AS (SELECT *, CASE WHEN raw <> 0 AND raw <> held THEN CASE raw WHEN 1 THEN 1 ELSE 3 END ELSE 0 END AS code FROM {p}sh)"""


def on(keys: str, a: str, b: str) -> str:
    return " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))


def idle(results: str, runs: str, keys: str, name: str) -> str:
    """Zeros for the runs that made no trade."""
    zero = ", ".join(f"coalesce({m}, 0) AS {m}" for m in ("trades", "roi", "win_rate", "exp", "sharpe", "max_drawdown", "consistency"))
    return f"{name} AS (SELECT {keys}, {zero}, coalesce(pf, 'inf'::DOUBLE) AS pf FROM (SELECT DISTINCT {keys} FROM {runs}) LEFT JOIN ({results}) USING ({keys}))"


def rewards(keys: str, bars: str, source: str = "sc", most: int = 3, name: str = "rw") -> str:
    """The best target of each run, in stops, from a probe with one of five: ``rw`` (keys, rrr)."""
    own = ", ".join(f"t.{k.strip()}" for k in keys.split(","))
    shared = ", ".join(k for k in keys.split(", ") if k != "lb")
    return f"""{q.trades(source, keys, target="5.0", name=f"{name}p")},
{name}x AS (SELECT {own}, trade_group_id, side, max(high) AS h, min(low) AS l, max(close) FILTER (bar_idx = entry_idx) AS e, max(close) FILTER (bar_idx = exit_idx) AS x FROM {name}p t JOIN {bars} b ON {on(shared, "t", "b")} AND b.bar_idx BETWEEN entry_idx AND exit_idx GROUP BY ALL),
{name}r AS (SELECT *, least(CASE side WHEN 1 THEN h - e ELSE e - l END / (e / 100), {most}) AS peak_r, side * (x - e) / (e / 100) AS close_r FROM {name}x),
{name}s AS (SELECT {keys}, r, sum(CASE WHEN peak_r >= r THEN r ELSE close_r END) AS earned FROM {name}r, (SELECT unnest(range(1, {most + 1})) AS r) GROUP BY {keys}, r),
{name} AS (SELECT {keys}, r::INT AS rrr FROM {name}s QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY earned DESC, r) = 1)"""


def searched(keys: str, bars: str, source: str = "sc") -> str:
    """Metrics and reward of every candidate of ``source``: ``mt``."""
    return f"""{rewards(keys, bars, source)}, sx AS (SELECT s.*, coalesce(rrr, 1) AS rrr, coalesce(rrr, 1)::DOUBLE AS target_x FROM {source} s LEFT JOIN rw USING ({keys})),
{q.trades("sx", keys, target="target_x", name="ot")}, {idle(q.metrics("ot", keys, exact=True), source, keys, "mz")}, mt AS (SELECT mz.*, coalesce(rrr, 1) AS rrr FROM mz LEFT JOIN rw USING ({keys}))"""


def ranked(keys: str, least: int = 10) -> str:
    """Coarse and fine candidates of ``mt`` and what is chosen of them: ``rk`` and ``ch``."""
    by, order = f"PARTITION BY {keys}", f"PARTITION BY {keys} ORDER BY lb"
    ok = f"trades >= {least}"
    return f"""pl AS (SELECT *, row_number() OVER ({order}) - 1 AS place, CASE WHEN {ok} THEN round(sharpe, 9) END AS value, lag(CASE WHEN {ok} THEN pf END) OVER ({order}) AS pf_below, lead(CASE WHEN {ok} THEN pf END) OVER ({order}) AS pf_above FROM mt),
co AS (SELECT {keys}, arg_max(place, (value, -place)) AS coarse FROM pl WHERE place % 2 = 0 AND value IS NOT NULL GROUP BY {keys}),
rk AS (SELECT pl.*, row_number() OVER ({by} ORDER BY value DESC, abs(place - coarse), lb) AS rank FROM pl JOIN co USING ({keys}) WHERE value IS NOT NULL AND abs(place - coarse) <= 1),
pk AS (SELECT {keys}, lb, rrr FROM rk QUALIFY row_number() OVER ({by} ORDER BY (coalesce(pf > 1.1 * pf_below, false) OR coalesce(pf > 1.1 * pf_above, false))::INT, rank) = 1),
ch AS (SELECT {keys}, coalesce(lb, 50) AS lb, rrr, lb IS NULL AS fallback FROM (SELECT DISTINCT {keys} FROM mt) LEFT JOIN pk USING ({keys}))"""


SWEEP = f"WITH {q.BARS}, {swept()}, {q.trades('sc', 'asset, lb')}, {idle(q.metrics('trades', 'asset, lb'), 'sc', 'asset, lb', 'mt')}"
EXACT = f"WITH {q.BARS}, {swept()}, {q.trades('sc', 'asset, lb')}, {idle(q.metrics('trades', 'asset, lb', exact=True), 'sc', 'asset, lb', 'm0')}, mt AS (SELECT *, NULL::INT AS rrr FROM m0)"
SEARCH = f"WITH {q.BARS}, {swept()}, {searched('asset, lb', 'bars')}"
cross = lambda s, d: sweep.crosses(src.bars_from_events(s, d), LBS)
found = lambda s, d: se.searched(cross(s, d), src.bars_from_events(s, d))
plain = lambda s, d: se.searched(cross(s, d), src.bars_from_events(s, d), reward=False)
SHOWN = "trades, round(roi, 6) AS roi, round(pf, 4) AS pf, round(win_rate, 6) AS win_rate, round(exp, 8) AS exp, round(sharpe, 5) AS sharpe, round(max_drawdown, 6) AS max_drawdown, round(consistency, 6) AS consistency"
add("o1_sweep", f"{SWEEP} SELECT * FROM mt", lambda s, d: shown_metrics(sweep.sweep(cross(s, d)), "asset", "lb"))
add("o1_optimise", f"{EXACT}, {ranked('asset')} SELECT asset, lb, round(sharpe, 5) AS sharpe, trades FROM rk WHERE rank = 1", lambda s, d: se.ranked(plain(s, d)).where("rank = 1").select("asset", "lb", rounded("sharpe", 5).alias("sharpe"), "trades"))
add("o2_rewarded_sweep", f"{SEARCH} SELECT asset, lb, rrr, {SHOWN} FROM mt", lambda s, d: shown_metrics(found(s, d), "asset", "lb", "rrr"))
add("o3_smart_choice", f"{EXACT}, {ranked('asset')} SELECT asset, lb, fallback FROM ch", lambda s, d: se.chosen(plain(s, d)).select("asset", "lb", "fallback"))
add("o1_optimise_rewarded", f"{SEARCH}, {ranked('asset')} SELECT asset, lb, coalesce(rrr, 0)::INT AS rrr, fallback FROM ch", lambda s, d: se.chosen(found(s, d)).withColumn("rrr", F.coalesce("rrr", F.lit(0))))
add("o4_fallback", f"{EXACT}, {ranked('asset', 22)} SELECT asset, lb, fallback FROM ch", lambda s, d: se.chosen(plain(s, d), least_trades=22).select("asset", "lb", "fallback"))
EXC = "ex AS (SELECT t.asset, trade_group_id, side, max(high) AS h, min(low) AS l, max(close) FILTER (bar_idx = entry_idx) AS e, max(close) FILTER (bar_idx = exit_idx) AS x FROM trades t JOIN bars b ON b.asset = t.asset AND b.bar_idx BETWEEN entry_idx AND exit_idx GROUP BY 1, 2, 3), rr AS (SELECT asset, trade_group_id, least(CASE side WHEN 1 THEN h - e ELSE e - l END / (e / 100), 3) AS peak_r, side * (x - e) / (e / 100) AS close_r FROM ex)"
probe = lambda s, d: sim.simulate(codes(s, d), Costs(target_pct=5.0))
moves = lambda s, d: sweep.excursions(probe(s, d), src.bars_from_events(s, d), 1.0)
add("j11_excursions", f"WITH {q.crossed()}, {q.trades(target='5.0')}, {EXC} SELECT asset, trade_group_id, round(peak_r, 6) AS peak_r, round(close_r, 6) AS close_r FROM rr", lambda s, d: moves(s, d).select("asset", "trade_group_id", rounded("peak_r").alias("peak_r"), rounded("close_r").alias("close_r")))
add("o2_best_reward", f"WITH {q.crossed()}, {q.trades(target='5.0')}, {EXC}, su AS (SELECT asset, r, sum(CASE WHEN peak_r >= r THEN r ELSE close_r END) AS earned FROM rr, (SELECT unnest([1, 2, 3]) AS r) GROUP BY 1, 2) SELECT asset, r AS rrr, round(earned, 5) AS earned FROM su QUALIFY row_number() OVER (PARTITION BY asset ORDER BY earned DESC, r) = 1", lambda s, d: sweep.best_reward(moves(s, d)).select("asset", "rrr", rounded("earned", 5).alias("earned")))
add("o14_surface", f"WITH {q.BARS}, {swept()}, sf AS (SELECT sc.*, m AS sl_mult, m::DOUBLE AS stop_x FROM sc, (SELECT unnest([0.5, 1.0, 1.5]) AS m)), {q.trades('sf', 'asset, lb, sl_mult', stop='stop_x')} SELECT * REPLACE (sl_mult::DOUBLE AS sl_mult) FROM ({q.metrics('trades', 'asset, lb, sl_mult')})", lambda s, d: shown_metrics(sweep.surface(cross(s, d), [0.5, 1.0, 1.5]), "asset", "lb", "sl_mult"))
SPECS = {"fee_shock": ("fee_shock",), "slippage_shock": ("slip",), "entry_drift": ("drift",), "variance": ("indicator variance",), "both": ("fees", "entry drift"), "sixth": ("fee",)}
OFF = random.Random(42).choice([-1, 1])
SCN = f"""lt AS (SELECT *, false AS late FROM sc UNION ALL SELECT * REPLACE (CASE WHEN lag(code) OVER (PARTITION BY asset, lb ORDER BY bar_idx) IN (1, 3) THEN lag(code) OVER (PARTITION BY asset, lb ORDER BY bar_idx) ELSE 0 END AS code), true AS late FROM sc),
sn AS (SELECT lt.*, scenario, 0.0002::DOUBLE * f AS fee_x, 0.0003::DOUBLE * p AS slip_x FROM lt JOIN (VALUES ('base', 1.0::DOUBLE, 1.0::DOUBLE, false, 50), ('fee_shock', 2.0, 1.0, false, 50), ('slippage_shock', 1.0, 3.0, false, 50), ('entry_drift', 1.0, 1.0, true, 50), ('variance', 1.0, 1.0, false, {50 + OFF}), ('both', 2.0, 1.0, true, 50)) v(scenario, f, p, lt2, lb2) ON lt.late = lt2 AND lt.lb = lb2)"""
add("o12_scenarios", f"WITH {q.BARS}, {swept()}, {SCN}, {q.trades('sn', 'asset, scenario', fee='fee_x', slip='slip_x')} {q.metrics('trades', 'asset, scenario')}", lambda s, d: shown_metrics(se.scenarios(src.bars_from_events(s, d), SPECS), "asset", "scenario"))
add("o13_news", None, lambda s, d: shown_metrics(se.scenarios(src.bars_from_events(s, d), {"news": ("news",), "all": ("fee", "slip", "news", "drift", "variance")}), "asset", "scenario"))
add("w45_news_candles", None, lambda s, d: se.news_candles(src.bars_from_events(s, d), 7).select("asset", "bar_idx", "high", "low"))
FLAGS = [("fee_shock", "Entry Drift"), ("news",), (), ("slip", "lb_variance")]
add("p12_scenario_flags", "SELECT * FROM (VALUES (0, 'FEE+ENT', 2.0::DOUBLE, 1.0::DOUBLE, false, true, false), (1, 'NEW', 1.0, 1.0, true, false, false), (2, 'NONE', 1.0, 1.0, false, false, false), (3, 'SLI+LB_', 1.0, 3.0, false, false, true)) v(place, label, fee_mult, slip_mult, news, late, varied)",
    lambda s, d: s.createDataFrame([(k, se.scenario_label(x), *se.scenario(x).values()) for k, x in enumerate(FLAGS)], "place int, label string, fee_mult double, slip_mult double, news boolean, late boolean, varied boolean"))

IN, OUT = 250, 100
WIN = f"nn AS (SELECT *, count(*) OVER (PARTITION BY asset) AS n FROM bars), wn AS (SELECT asset, k AS window_no, 'IS' AS sample, bar_idx - k * {OUT} AS bar_idx, time, open, high, low, close FROM nn, (SELECT unnest(generate_series(0, 20)) AS k) WHERE bar_idx >= k * {OUT} AND bar_idx < k * {OUT} + {IN} AND k < ceil((n - {IN}) / {OUT}::DOUBLE) UNION ALL SELECT asset, (bar_idx - {IN}) // {OUT}, 'OOS', (bar_idx - {IN}) % {OUT}, time, open, high, low, close FROM nn WHERE bar_idx >= {IN})"
add("j18_windows", f"WITH {q.BARS}, {WIN} SELECT asset, window_no, sample, bar_idx, close FROM wn", lambda s, d: sweep.windows(src.bars_from_events(s, d), IN, OUT).select("asset", "window_no", "sample", "bar_idx", "close"))
KEYS = "asset, window_no"
WFO = f"""WITH {q.BARS}, {WIN}, ins AS (SELECT * EXCLUDE (sample) FROM wn WHERE sample = 'IS'), {swept('ins', KEYS)}, {searched(KEYS + ', lb', 'ins')}, {ranked(KEYS)},
oi AS (SELECT w.* EXCLUDE (sample), c.lb AS own FROM wn w JOIN ch c USING ({KEYS}) WHERE sample = 'OOS'), {swept('oi', KEYS, 'o')},
oc AS (SELECT * EXCLUDE (own) FROM osc WHERE lb = own), {q.trades('oc', KEYS + ', lb', name='oo')}"""
forward = lambda s, d: se.walk_forward(src.bars_from_events(s, d), IN, OUT)
add("o9_choices", f"{WFO} SELECT asset, window_no::BIGINT AS window_no, lb, fallback FROM ch", lambda s, d: (lambda p: se.chosen(se.searched(sweep.crosses(p, LBS, ("asset", "window_no")), p, Costs(), ("asset", "window_no", "lb")), keys=("asset", "window_no")).select("asset", "window_no", "lb", "fallback"))(sweep.windows(src.bars_from_events(s, d), IN, OUT).where("sample = 'IS'").drop("sample")))
add("o9_walk_forward", f"{WFO} SELECT asset, window_no::BIGINT AS window_no, lb, count(*)::BIGINT AS trades, round(sum(pnl), 5) AS pnl FROM oo GROUP BY 1, 2, 3", lambda s, d: forward(s, d).groupBy("asset", "window_no", "lb").agg(F.count("*").alias("trades"), rounded(F.sum("pnl"), 5).alias("pnl")))
add("o15_panel_walk_forward", f"{WFO} SELECT asset, count(DISTINCT window_no)::BIGINT AS windows, count(*)::BIGINT AS trades, round(sum(pnl), 5) AS pnl FROM oo GROUP BY 1", lambda s, d: forward(s, d).groupBy("asset").agg(F.count_distinct("window_no").alias("windows"), F.count("*").alias("trades"), rounded(F.sum("pnl"), 5).alias("pnl")))
add("o9_trade_trigger", None, lambda s, d: se.walk_forward_by_trades(src.bars_from_events(s, d), IN, 25, tuple(range(12, 40))).groupBy("asset", "window_no", "lb", "window_start", "window_stop").agg(F.count("*").alias("trades"), rounded(F.sum("pnl"), 5).alias("pnl")))
add("w28_stitched", f"{WFO} SELECT asset, window_no::BIGINT AS window_no, trade_group_id, round(1 + sum(pnl / 100000.0) OVER (PARTITION BY asset ORDER BY window_no, trade_group_id), 8) AS equity FROM oo", lambda s, d: sweep.stitched(forward(s, d)).select("asset", "window_no", "trade_group_id", rounded("equity", 8).alias("equity")))

# --- single runs and runs by regime --------------------------------------------------------------
PARTS = "pt AS (SELECT asset, CASE WHEN bar_idx >= n - 200 THEN 'OOS' ELSE 'IS' END AS sample, CASE WHEN bar_idx >= n - 200 THEN bar_idx - (n - 200) ELSE bar_idx - (n - 500) END AS bar_idx, time, open, high, low, close FROM (SELECT *, count(*) OVER (PARTITION BY asset) AS n FROM bars) WHERE bar_idx >= n - 500)"

SINGLE = f"""WITH {q.BARS}, {PARTS}, ins AS (SELECT * EXCLUDE (sample) FROM pt WHERE sample = 'IS'), {swept('ins')}, {searched('asset, lb', 'ins')}, {ranked('asset')},
{swept('pt', 'asset, sample', 'p')}, ra AS (SELECT * FROM psc WHERE lb = 50), {q.trades('ra', 'asset, sample, lb', name='rt')}, {idle(q.metrics('rt', 'asset, sample, lb', exact=True), 'ra', 'asset, sample, lb', 'rm')},
oa AS (SELECT a.*, c.rrr, coalesce(c.rrr, 3)::DOUBLE AS target_x FROM psc a JOIN ch c USING (asset, lb)), {q.trades('oa', 'asset, sample, lb', target='target_x', name='ob')}, {idle(q.metrics('ob', 'asset, sample, lb', exact=True), 'oa', 'asset, sample, lb', 'om')},
runs AS (SELECT *, 'raw' AS phase, NULL::INT AS rrr FROM rm UNION ALL BY NAME SELECT om.*, 'optimised' AS phase, ch.rrr FROM om JOIN ch USING (asset, lb))"""
single = lambda s, d: se.single_run(src.bars_from_events(s, d), 300, 200)
add("o8_single_run", f"{SINGLE} SELECT asset, phase, sample, lb, coalesce(rrr, 0)::INT AS rrr, {SHOWN} FROM runs", lambda s, d: shown_metrics(single(s, d).withColumn("rrr", F.coalesce("rrr", F.lit(0))), "asset", "phase", "sample", "lb", "rrr"))
RATIO = ", ".join(f"round(max({m}) FILTER (sample = 'OOS') / nullif(max({m}) FILTER (sample = 'IS'), 0), 5) AS {m}" for m in se.METRICS)
add("a7_replication_ratios", f"{SINGLE} SELECT asset, phase, {RATIO} FROM runs GROUP BY 1, 2", lambda s, d: se.replication(single(s, d)).select("asset", "phase", *(rounded(m, 5).alias(m) for m in se.METRICS)))
add("o5_regime_search", None, lambda s, d: se.regime_search(src.bars_from_events(s, d).where("bar_idx < 400")))
EMAS = ", ".join(f"{q.ema('close', q.span(n))} AS e{n}" for n in (20, 30, 60, 90))
TURN = f"""ea AS (SELECT *, {EMAS} FROM r), ra AS (SELECT *, CASE WHEN lag(e20) OVER ({q.W}) > CASE regime WHEN 'Uptrend' THEN lag(e30) OVER ({q.W}) WHEN 'Downtrend' THEN lag(e60) OVER ({q.W}) ELSE lag(e90) OVER ({q.W}) END THEN 1 ELSE -1 END AS raw FROM ea),
rh AS (SELECT *, coalesce(last_value(nullif(raw, 0) IGNORE NULLS) OVER ({q.W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM ra), rc AS (SELECT *, CASE WHEN raw <> 0 AND raw <> held THEN CASE raw WHEN 1 THEN 1 ELSE 3 END ELSE 0 END AS code FROM rh)"""
REGIME_RUN = f"WITH {q.BARS}{regime_sql(1)}, {TURN}, {rewards('asset', 'bars', 'rc', 5)}, rx AS (SELECT rc.*, rrr::DOUBLE AS target_x FROM rc JOIN rw USING (asset)), {q.trades('rx', 'asset', target='target_x', name='rz')}, rm AS ({q.metrics('rz', 'asset')}) SELECT rm.*, rrr FROM rm JOIN rw USING (asset)"
add("o6_regime_run", REGIME_RUN, lambda s, d: shown_metrics(se.regime_run(src.bars_from_events(s, d), {"Uptrend": 30, "Downtrend": 60, "Ranging": 90}), "asset", "rrr"))
add("p3_out_split", f"WITH {q.crossed()}, {q.trades()} SELECT asset, CASE WHEN exit_idx < 400 THEN 'OOS1' ELSE 'OOS2' END AS part, count(*)::BIGINT AS trades, round(sum(pnl), 5) AS pnl FROM trades GROUP BY 1, 2", lambda s, d: sim.simulate(codes(s, d)).groupBy("asset", F.when(F.col("exit_idx") < 400, "OOS1").otherwise("OOS2").alias("part")).agg(F.count("*").alias("trades"), rounded(F.sum("pnl"), 5).alias("pnl")))
BE = "me AS (SELECT asset, exit_idx AS bar_idx, sum(pnl) AS made FROM trades GROUP BY 1, 2), wo AS (SELECT t.asset, b.bar_idx, sum(side * qty * (b.close - entry_price)) AS op FROM trades t JOIN bars b ON b.asset = t.asset AND b.bar_idx >= entry_idx AND b.bar_idx < exit_idx GROUP BY 1, 2), bq AS (SELECT b.asset, b.bar_idx, time, 100000 + sum(coalesce(made, 0)) OVER (PARTITION BY b.asset ORDER BY b.bar_idx) + coalesce(op, 0) AS equity FROM bars b LEFT JOIN me USING (asset, bar_idx) LEFT JOIN wo USING (asset, bar_idx))"
marked = lambda s, d: sweep.bar_equity(sim.simulate(codes(s, d)), src.bars_from_events(s, d))
add("j12_bar_equity", f"WITH {q.crossed()}, {q.trades()}, {BE} SELECT asset, bar_idx, round(equity, 5) AS equity FROM bq", lambda s, d: marked(s, d).select("asset", "bar_idx", rounded("equity", 5).alias("equity")))
add("a5_bar_sharpe", f"WITH {q.crossed()}, {q.trades()}, {BE}, st AS (SELECT asset, equity / lag(equity) OVER ({q.W}) - 1 AS ret, epoch(time) - lag(epoch(time)) OVER ({q.W}) AS step FROM bq) SELECT asset, round(avg(ret) / stddev_pop(ret) * sqrt(31557600.0 / quantile_cont(step, 0.5)), 5) AS sharpe FROM st WHERE ret IS NOT NULL GROUP BY 1", lambda s, d: sweep.bar_sharpe(marked(s, d)).select("asset", rounded("sharpe", 5).alias("sharpe")))
add("a17_robustness", f"{SWEEP} SELECT asset, round(max(pf), 4) AS peak, round(avg((pf >= 0.9 * (SELECT max(pf) FROM mt m2 WHERE m2.asset = mt.asset))::INT::DOUBLE), 6) AS plateau, count(*)::BIGINT AS cells FROM mt GROUP BY 1",
    lambda s, d: (lambda r: r.join(r.groupBy("asset").agg(F.max("pf").alias("peak")), "asset").groupBy("asset").agg(F.max("peak").alias("peak"), rounded(F.avg((F.col("pf") >= F.col("peak") * 0.9).cast("double"))).alias("plateau"), F.count("*").alias("cells")))(shown_metrics(sweep.sweep(cross(s, d)), "asset", "lb")))
add("a7_replication", f"WITH {q.crossed()}, {q.trades()} SELECT asset, round(sum(pnl) FILTER (exit_idx >= 400) / nullif(sum(pnl) FILTER (exit_idx < 400), 0), 5) AS roi_ratio FROM trades GROUP BY 1", lambda s, d: sim.simulate(codes(s, d)).groupBy("asset").agg(rounded(sweep.shares(F.sum(F.when(F.col("exit_idx") < 400, F.col("pnl"))), F.sum(F.when(F.col("exit_idx") >= 400, F.col("pnl")))), 5).alias("roi_ratio")))

# --- statistics ----------------------------------------------------------------------------------
trade_returns = lambda s, d: sim.simulate(codes(s, d)).select("asset", F.col("trade_group_id").alias("t"), (F.col("pnl") / 100000.0).alias("ret"))
MOM = "tr AS (SELECT asset, trade_group_id AS t, pnl / 100000.0 AS ret FROM trades), b0 AS (SELECT asset, count(*) AS n, avg(ret) AS m, stddev_samp(ret) AS sd FROM tr GROUP BY 1), mo AS (SELECT tr.asset, any_value(n) AS n, any_value(m / sd * sqrt(n)) AS sharpe, avg(power((ret - m) / sd, 3)) AS skew, avg(power((ret - m) / sd, 4)) AS kurt FROM tr JOIN b0 ON tr.asset = b0.asset GROUP BY 1), dn AS (SELECT *, 1 - skew * sharpe + (kurt - 1) * sharpe * sharpe / 4 AS den FROM mo)"
MOMENTS = f"WITH {q.crossed()}, {q.trades()}, {MOM}"
moments = lambda s, d: stats.sharpe_moments(trade_returns(s, d))
add("t5_sharpe_moments", f"{MOMENTS} SELECT asset, n::BIGINT AS n, round(sharpe, 6) AS sharpe, round(skew, 6) AS skew, round(kurt, 6) AS kurt FROM mo", lambda s, d: moments(s, d).select("asset", "n", *(rounded(c).alias(c) for c in ("sharpe", "skew", "kurt"))))
add("t6_sharpe_z", f"{MOMENTS} SELECT asset, round(CASE WHEN den > 0 THEN sharpe * sqrt(n - 1) / sqrt(den) END, 6) AS z FROM dn", lambda s, d: moments(s, d).select("asset", rounded(stats.sharpe_z(F.lit(0.0))).alias("z")))

Z0 = "CASE WHEN n >= 3 AND den > 0 THEN sharpe * sqrt(n - 1) / sqrt(den) END"
# Phi(x) = 1/2 + density(x) * (x + x^3/3 + x^5/(3*5) + ...): the operator uses a rational form.
ODD = "od AS (SELECT k, sum(ln(2 * k + 1)) OVER (ORDER BY k) AS odd FROM (SELECT unnest(range(0, 200)) AS k))"


def phi(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 8 THEN 1.0 WHEN {x} < -8 THEN 0.0 ELSE 0.5 + sign({x}) * exp(-{x} * {x} / 2) / sqrt(2 * pi()) * (SELECT sum(CASE WHEN {x} = 0 THEN 0 ELSE exp((2 * k + 1) * ln(abs({x})) - odd) END) FROM od) END)"


add("t6_probabilistic_sharpe", f"{MOMENTS}, {ODD}, zz AS (SELECT asset, {Z0} AS z FROM dn) SELECT asset, round({phi('z')}, 8) AS psr FROM zz", lambda s, d: moments(s, d).select("asset", rounded(stats.normal_cdf(stats.sharpe_z(F.lit(0.0))), 8).alias("psr")))
add("t7_track_record", f"{MOMENTS} SELECT asset, CASE WHEN sharpe <= 1e-12 THEN 'inf'::DOUBLE ELSE round(1 + den * power(1.6448536269514715 / sharpe, 2), 5) END AS least FROM dn", lambda s, d: moments(s, d).select("asset", F.round(stats.least_track_record(), 5).alias("least")))
FACTOR = stats.expected_max_factor(len(LBS))
add("t8_backtest_length", f"{MOMENTS} SELECT asset, round(power({FACTOR!r} / abs(sharpe / sqrt(n)), 2), 4) AS least FROM mo", lambda s, d: moments(s, d).select("asset", rounded(stats.backtest_length(len(LBS), F.abs(F.col("sharpe") / F.sqrt("n"))), 4).alias("least")))
TRIALS = f"{swept()}, {q.trades('sc', 'asset, lb', name='art')}, {idle(q.metrics('art', 'asset, lb', exact=True), 'sc', 'asset, lb', 'am')}, tv AS (SELECT asset, sqrt(var_samp(sharpe)) AS spread FROM am GROUP BY 1)"
spread = lambda s, d: sweep.sweep(cross(s, d)).groupBy("asset").agg(F.sqrt(F.var_samp("sharpe")).alias("spread"))


def deflated(s, d):
    """Sharpe ratios of all look-backs are the trials that the default one's is deflated by."""
    return moments(s, d).join(spread(s, d), "asset").select("asset", rounded(stats.normal_cdf(stats.sharpe_z(F.col("spread") * FACTOR)), 8).alias("dsr"))


add("t5_deflated_sharpe", f"{MOMENTS.replace('WITH bars', 'WITH bars')}, {TRIALS}, {ODD}, zz AS (SELECT asset, CASE WHEN n >= 3 AND den > 0 THEN (sharpe - spread * {FACTOR!r}) * sqrt(n - 1) / sqrt(den) END AS z FROM dn JOIN tv USING (asset)) SELECT asset, round({phi('z')}, 8) AS dsr FROM zz", deflated)
add("t14_haircut", None, lambda s, d: moments(s, d).select("asset", stats.haircut(F.col("sharpe"), F.col("n"), 45).alias("h")).select("asset", "h.*"))
CN = sum(1 / i for i in range(1, 46))
add("t14_adjusted_p", f"{MOMENTS}, {ODD}, zz AS (SELECT asset, abs(sharpe / sqrt(252.0) * sqrt(n)) AS z FROM mo), pp AS (SELECT asset, z, least(greatest(2 * (1 - {phi('z')}), 0), 1) AS p FROM zz) SELECT asset, round(p, 8) AS p_obs, round(least(p * 45 * {CN!r}, 1), 7) AS p_adj FROM pp",
    lambda s, d: (lambda h: moments(s, d).select("asset", rounded(h["p_obs"], 8).alias("p_obs"), rounded(h["p_adj"], 7).alias("p_adj")))(stats.haircut(F.col("sharpe"), F.col("n"), 45)))
add("t11_sharpe_pvalues", f"{MOMENTS}, {ODD} SELECT asset, round(1 - {phi('sharpe')}, 8) AS p FROM mo", lambda s, d: moments(s, d).select("asset", rounded(stats.sharpe_pvalues(F.col("sharpe")), 8).alias("p")))
add("t15_overfit_report", None, lambda s, d: stats.overfit_report(moments(s, d), spread(s, d), len(LBS), stats.overfitting_probability(all_splits(s, d), ("asset",))))
add("t1_monte_carlo", None, lambda s, d: stats.monte_carlo(trade_returns(s, d)))
add("t1_equity_bands", None, lambda s, d: stats.equity_bands(trade_returns(s, d)))
add("t3_bootstrap", None, lambda s, d: stats.bootstrap_interval(trade_returns(s, d)))
strategies = lambda s, d: sim.simulate(cross(s, d), Costs(), ("asset", "lb")).select(F.col("asset").alias("family"), F.col("lb").cast("string").alias("strategy"), F.col("exit_idx").alias("t"), "pnl").groupBy("family", "strategy", "t").agg((F.sum("pnl") / 100000.0).alias("ret"))
add("t12_reality_check", None, lambda s, d: stats.reality_check(strategies(s, d)))
PV = f"{MOMENTS}, {TRIALS}, {ODD}, pv AS (SELECT asset, lb AS name, 1 - {phi('sharpe')} AS p FROM am), rk AS (SELECT *, count(*) OVER (PARTITION BY asset) AS n, row_number() OVER (PARTITION BY asset ORDER BY p, name) AS rank FROM pv)"
pvalues = lambda s, d: sweep.sweep(cross(s, d)).select("asset", F.col("lb").alias("name"), stats.sharpe_pvalues(F.col("sharpe")).alias("p"))
add("t10_rejections", f"{PV} SELECT asset, name, p <= 0.9 / n AS bonferroni, bool_and(p <= 0.9 / (n - rank + 1)) OVER (PARTITION BY asset ORDER BY p, name) AS holm, coalesce(rank <= max(rank) FILTER (p <= rank * 0.9 / n) OVER (PARTITION BY asset), false) AS bh FROM rk", lambda s, d: stats.rejections(pvalues(s, d), 0.9, ("asset",)).select("asset", "name", "bonferroni", "holm", "bh"))
# Splits are bit sets of folds with half of the bits set.
CS = f"""WITH {q.BARS}, {swept()}, cr AS (SELECT asset, lb, bar_idx AS t, coalesce(close / lag(close) OVER (PARTITION BY asset, lb ORDER BY bar_idx) - 1, 0) * raw AS ret FROM sc),
sz AS (SELECT asset, max(t) + 1 AS tt, count(DISTINCT lb) AS nn FROM cr GROUP BY 1),
fo AS (SELECT cr.asset, lb, list_position([t < floor(k * tt / 6.0) FOR k IN [1, 2, 3, 4, 5, 6]], true) - 1 AS fold, nn, ret FROM cr JOIN sz USING (asset)),
ps AS (SELECT asset, lb, fold, nn, count(*) AS n, sum(ret) AS s, sum(ret * ret) AS ss FROM fo GROUP BY ALL),
sp AS (SELECT m FROM (SELECT unnest(generate_series(0, 63)) AS m) WHERE bit_count(m::INT) = 3),
su AS (SELECT asset, m, lb, nn, (m >> fold::INT) & 1 AS inside, sum(n) AS n, sum(s) AS s, sum(ss) AS ss FROM ps, sp GROUP BY ALL),
sh2 AS (SELECT *, coalesce((s / n) / nullif(sqrt(greatest((ss - n * (s / n) * (s / n)) / (n - 1), 0)), 0), 0) AS sr FROM su),
bo AS (SELECT asset, m, lb, nn, max(sr) FILTER (inside = 1) AS i, max(sr) FILTER (inside = 0) AS o FROM sh2 GROUP BY ALL),
ra AS (SELECT *, row_number() OVER (PARTITION BY asset, m ORDER BY round(i, 12) DESC, lb) AS wi, row_number() OVER (PARTITION BY asset, m ORDER BY round(o, 12), lb) AS rank FROM bo),
la AS (SELECT asset, m, lb, rank, ln(rank / (nn + 1 - rank)::DOUBLE) AS lam FROM ra WHERE wi = 1)"""
#: The reference's number of folds: 12,870 splits.
FOLDS = 16


def all_splits(s, d, folds: int = FOLDS):
    """Splits of every asset over all look-backs."""
    ret = F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(w("asset", "lb"))) - 1, F.lit(0.0)) * F.col("raw")
    return stats.cscv(cross(s, d).select("asset", F.col("lb").alias("strategy"), F.col("bar_idx").alias("t"), ret.alias("ret")), folds, ("asset",))


add("t9_cscv", f"{CS} SELECT asset, lb AS strategy, rank::INT AS rank, count(*)::BIGINT AS splits, round(sum(lam), 6) AS total FROM la GROUP BY 1, 2, 3", lambda s, d: all_splits(s, d, 6).groupBy("asset", "strategy", "rank").agg(F.count("*").alias("splits"), rounded(F.sum("lambda")).alias("total")))
add("t9_pbo", f"{CS} SELECT asset, round(avg((lam <= 0)::INT::DOUBLE), 6) AS pbo, count(*)::BIGINT AS splits FROM la GROUP BY 1", lambda s, d: stats.overfitting_probability(all_splits(s, d, 6), ("asset",)).select("asset", rounded("pbo").alias("pbo"), "splits"))
add("t9_pbo_folds", None, lambda s, d: stats.overfitting_probability(all_splits(s, d), ("asset",)).select("asset", rounded("pbo").alias("pbo"), "splits"))
