"""Queries over loaders, whole runs, batches and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantspan import engine
from quantspan.operators import checks, regimes, simulate, strategies
from quantspan.plans import sql as q
from quantspan.plans.bars import codes, rounded, shown_metrics
from quantspan.plans.research import BASIS, FEEDS
from quantspan.plans.search import MOMENTS, SHOWN, idle  # noqa: F401
from quantspan.plans.strategies import STRATEGY_SQL
from quantspan.sources import bars as src
from quantspan.sources import feeds
from quantspan.sources.scratch import folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None, f) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


def saved(spark, df, ending: str = "parquet") -> str:
    """The rows as a file of their own, as a user has them."""
    path = f"{folder(spark)}.{ending}"
    if ending == "parquet":
        df.write.parquet(path)
    else:
        df.write.option("header", True).csv(path)
    return path


def seconds(bars):
    return bars.withColumn("time", F.unix_seconds(F.col("time").cast("timestamp")))


# --- loaders ---------------------------------------------------------------------------------------
def funding(s, d):
    """The feed of one asset with every row twice, the later one in the file with another rate."""
    feed = src.funding_feed(s, d).where("asset = 'view'").select("time", "rate")
    rows = feed.withColumn("rate", F.col("rate") + 1).withColumn("n", F.lit(0)).unionByName(feed.withColumn("n", F.lit(1)))
    return feeds.load_funding(s, saved(s, rows.repartition(1).sortWithinPartitions("time", "n").drop("n")))


def onchain(s, d):
    feed = src.open_interest_feed(s, d).where("asset = 'view'").select("time", F.col("open_interest").alias("nvt"), F.lit(1.0).alias("market_price"))
    return feeds.load_onchain(s, saved(s, feed, "csv"), "nvt")


def with_onchain(s, d):
    from quantspan.operators.asof import asof_backward

    bars = seconds(src.bars_from_events(s, d)).where("asset = 'view'").select("asset", "bar_idx", "time", "close")
    daily = onchain(s, d).where("time % 86400 = 0").select(F.lit("view").alias("asset"), "time", "value")
    return asof_backward(bars, daily, ["value"]).select("asset", "bar_idx", "value")


add("s6_load_funding", f"WITH {q.BARS}, {FEEDS} SELECT time, round(rate, 9) AS rate, 1::BIGINT AS dropped FROM fund WHERE asset = 'view'", lambda s, d: funding(s, d).select("time", rounded("rate", 9).alias("rate"), "dropped"))
add("s7_load_open_interest", f"WITH {q.BARS}, {FEEDS} SELECT time, open_interest FROM oi WHERE asset = 'view'", lambda s, d: feeds.load_open_interest(s, saved(s, src.open_interest_feed(s, d).where("asset = 'view'").select("time", "open_interest")), tolerance=1_000_000))
add("s8_load_basis", f"WITH {q.BARS}, {BASIS} SELECT epoch(time)::BIGINT AS time, round(basis_bp, 5) AS basis_bp FROM basis", lambda s, d: feeds.load_basis(s, saved(s, seconds(src.basis_feed(src.bars_from_events(s, d))), "csv")).select("time", rounded("basis_bp", 5).alias("basis_bp")))
add("s9_load_onchain", f"WITH {q.BARS}, {FEEDS} SELECT time, open_interest AS value, 'nvt' AS metric, 64::INT AS digest_length FROM oi WHERE asset = 'view'", lambda s, d: onchain(s, d).select("time", "value", "metric", F.length("snapshot_sha256").alias("digest_length")))
add("j5_asof_onchain", f"WITH {q.BARS}, {FEEDS}, dy AS (SELECT time, open_interest AS value FROM oi WHERE asset = 'view' AND time % 86400 = 0) SELECT b.asset, bar_idx, value FROM bt b ASOF LEFT JOIN dy ON b.time >= dy.time WHERE b.asset = 'view'", with_onchain)


def panel(s, d):
    """Two assets as files of daily bars on days that both have."""
    bars = seconds(src.bars_from_orders(s, d).where("asset in ('1-URGENT', '2-HIGH')"))
    first = bars.groupBy("time").agg(F.count("*").alias("n")).where("n = 2").agg(F.min("time").alias("first"))
    run = bars.join(F.broadcast(first), F.col("time").between(F.col("first"), F.col("first") + 0))
    day = run.select("asset", F.explode(F.sequence(F.col("time"), F.col("time") + 86400 * 9, F.lit(86400))).alias("time"), "open", "high", "low", "close", "volume")
    paths = {a: saved(s, day.where(F.col("asset") == a).drop("asset"), e) for a, e in (("1-URGENT", "csv"), ("2-HIGH", "parquet"))}
    return feeds.load_panel(s, paths)


DAYS = "SELECT o_orderpriority AS asset, date_trunc('day', o_orderdate)::TIMESTAMP AS time, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close, count(*)::DOUBLE AS volume FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2"
add("s2_load_panel", f"WITH dd AS ({DAYS}), f AS (SELECT min(time) AS t FROM (SELECT time FROM dd GROUP BY 1 HAVING count(*) = 2)) SELECT asset, time + INTERVAL 1 DAY * k AS time, open, high, low, close, volume, k::BIGINT AS bar_idx FROM dd JOIN f ON time = t, (SELECT unnest(range(0, 10)) AS k)", panel)


def faults(s, d):
    """Bars of which every fifth stands twice and every seventh has no close."""
    bars = src.bars_from_events(s, d)
    spoilt = bars.withColumn("close", F.when(F.col("bar_idx") % 7 != 0, F.col("close")))
    return src.panel_faults(spoilt.unionByName(spoilt.where("bar_idx % 5 = 0")))


add("s3_panel_faults", f"WITH {q.BARS}, x AS (SELECT asset, time, CASE WHEN bar_idx % 7 <> 0 THEN close END AS close FROM bars UNION ALL SELECT asset, time, CASE WHEN bar_idx % 7 <> 0 THEN close END FROM bars WHERE bar_idx % 5 = 0), k AS (SELECT asset, time, count(*) AS n, count(*) FILTER (close IS NULL) > 0 AS gone FROM x GROUP BY 1, 2) SELECT asset, count(*)::BIGINT AS bars, count(*) FILTER (n > 1)::BIGINT AS duplicates, count(*) FILTER (gone)::BIGINT AS missing FROM k GROUP BY 1", faults)


def csv_bars(s, d):
    one = seconds(src.bars_from_events(s, d)).where("asset = 'click'").select("time", "open", "high", "low", "close", "volume")
    return src.load_ohlc(s, saved(s, one, "csv"), "click").select("asset", "time", "bar_idx", "open", "close", "volume")


def converted(s, d):
    one = seconds(src.bars_from_events(s, d)).where("asset = 'click'").select("time", "open", "close")
    target = f"{folder(s)}.parquet"
    feeds.csv_to_parquet(s, saved(s, one, "csv"), target)
    return s.read.parquet(target)


def appended(s, d):
    trades = simulate.simulate(codes(s, d)).withColumn("sample", F.when(F.col("exit_idx") < 400, "IS").otherwise("OOS1"))
    path = folder(s)
    for sample in ("IS", "OOS1"):
        src.append_table(trades.where(F.col("sample") == sample), path, "sample")
    return feeds.out_of_sample_pick(s.read.parquet(path), ("asset",))


add("s1_load_ohlc", f"WITH {q.BARS} SELECT asset, time, bar_idx, open, close, volume FROM bars WHERE asset = 'click'", csv_bars)
add("s15_csv_to_parquet", f"WITH {q.BARS} SELECT epoch(time)::BIGINT AS time, open, close FROM bars WHERE asset = 'click'", converted)
add("a18_out_of_sample_pick", f"WITH {q.crossed()}, {q.trades()} SELECT asset, count(*)::BIGINT AS oos_trades, round(sum(pnl), 5) AS oos_total_pnl, round(sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl < 0), 6) AS oos_pf, round(avg((pnl > 0)::INT::DOUBLE), 6) AS oos_win_rate FROM trades WHERE exit_idx >= 400 GROUP BY 1",
    lambda s, d: appended(s, d).select("asset", "oos_trades", rounded("oos_total_pnl", 5).alias("oos_total_pnl"), rounded("oos_pf").alias("oos_pf"), rounded("oos_win_rate").alias("oos_win_rate")))
add("s10_generated", None, lambda s, d: feeds.generated(s, 2000, 3600, 1_600_000_000, 7))


def surface(s, d):
    """A surface whose text of numbers is partly none, written as CSV."""
    rows = s.createDataFrame([("1", None, 12, "1.5", "0.9"), ("1", "Up", 13, "inf", "nan"), ("2", "", 12, "bad", "2")], "window_idx string, regime string, lb int, pf string, roi string")
    return feeds.load_surface(s, saved(s, rows, "csv")).select("window_idx", "regime", F.col("lb").cast("int").alias("lb"), F.when(F.col("pf") < float("inf"), F.col("pf")).alias("pf"))


add("s17_load_surface", "SELECT * FROM (VALUES ('1', '', 12, 1.5::DOUBLE), ('1', 'Up', 13, NULL), ('2', '', 12, NULL)) v(window_idx, regime, lb, pf)", surface)
add("j17_merged", f"WITH {q.BARS} SELECT a.time, a.close AS close_spot, b.close AS close_perp, a.volume FROM bars a JOIN bars b ON a.time = b.time WHERE a.asset = 'view' AND b.asset = 'click'",
    lambda s, d: (lambda bars: feeds.merged({"spot": bars.where("asset = 'view'").select("time", "close", "volume"), "perp": bars.where("asset = 'click'").select("time", "close")}))(src.bars_from_events(s, d)))
add("s16_printed", f"WITH {q.crossed()}, {q.trades()}, m AS ({q.metrics(exact=True)}) SELECT asset, printf('%8s %s| Trades:%4d  ROI:$%s  PF:%6.2f  Shp:%6.2f  Win:%6.2f%%  Exp:$%s  MaxDD:$%s', 'RAW', '(LB 50) ', trades, format('{{:,.2f}}', roi * 100000), pf, sharpe, win_rate * 100, format('{{:,.2f}}', exp * 100000), format('{{:,.2f}}', max_drawdown * 100000)) AS line FROM m",
    lambda s, d: feeds.printed(simulate.metrics(simulate.simulate(codes(s, d))).withColumn("lb", F.lit(50)).withColumn("rrr", F.lit(None).cast("int")), F.lit("RAW")).select("asset", "line"))
add("p9_finite", f"WITH {q.BARS}, x AS (SELECT asset, bar_idx, ln(CASE WHEN bar_idx % 3 = 0 THEN NULL ELSE close END) AS v FROM bars) SELECT asset, bar_idx, round(v, 8) AS v FROM x WHERE v IS NOT NULL",
    lambda s, d: src.finite(src.bars_from_events(s, d).select("asset", "bar_idx", F.when(F.col("bar_idx") % 3 == 0, float("nan")).when(F.col("bar_idx") % 3 == 3, float("inf")).otherwise(F.ln("close")).alias("v")), "v").select("asset", "bar_idx", rounded("v", 8).alias("v")))
add("p8_complete_times", f"WITH {q.BARS}, t AS (SELECT time FROM bars GROUP BY 1 HAVING count(*) FILTER (volume < 2) = 0) SELECT asset, time, close FROM bars WHERE time IN (SELECT time FROM t)",
    lambda s, d: src.complete_times(src.bars_from_events(s, d).withColumn("close", F.when(F.col("volume") >= 2, F.col("close"))), "close").select("asset", "time", "close"))

# --- whole runs ------------------------------------------------------------------------------------
SPECS = {"ema": ("batch_ema_cross", 15), "atr": ("batch_atr_cross", 15), "macd": ("batch_macd", 15), "rsi": ("batch_rsi", 15), "stoch": ("batch_stochastic", 15), "volume": ("volume_confirmed_cross", 15), "flow": ("obv_divergence", 15), "breakout": ("volume_breakout", 15)}
EACH = " UNION ALL ".join(f"SELECT '{k}' AS strategy, * FROM ({STRATEGY_SQL[v[0]]})" for k, v in SPECS.items())
ON = "PARTITION BY strategy, asset ORDER BY bar_idx"
BATCH = f"""WITH {q.BARS}, ev AS ({EACH}), sr AS (SELECT e.*, time, open, high, low, close FROM ev e JOIN bars b ON e.asset = b.asset AND e.bar_idx = b.bar_idx),
sh AS (SELECT *, coalesce(last_value(nullif(raw, 0) IGNORE NULLS) OVER ({ON} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM sr),
sc AS (SELECT *, CASE WHEN raw <> 0 AND raw <> held THEN CASE raw WHEN 1 THEN 1 ELSE 3 END ELSE 0 END AS code FROM sh), {q.trades('sc', 'strategy, asset')}, {idle(q.metrics('trades', 'strategy, asset'), 'sc', 'strategy, asset', 'mt')} SELECT * FROM mt"""
add("o18_batch", BATCH, lambda s, d: shown_metrics(engine.batch(src.bars_from_events(s, d), SPECS), "strategy", "asset"))
SMALL = {"inside": 300, "outside": 200, "lookbacks": tuple(range(12, 40)), "walk_step": 100, "least_trades": 5}
add("o17_main", None, lambda s, d: engine.main(src.bars_from_events(s, d), engine.Settings.of(SMALL | {"walk": False}))["runs"])
add("o6_regime_segments", None, lambda s, d: engine.dispatch(src.bars_from_events(s, d), engine.Settings.of(SMALL | {"regimes": True, "walk": False})))
add("o10_regime_walk", None, lambda s, d: engine.dispatch(src.bars_from_events(s, d), engine.Settings.of(SMALL | {"regimes": True})))

# --- checks ----------------------------------------------------------------------------------------
CHECKED = {"ema_cross": lambda b: strategies.signals(b, "ema_cross", 50), "trend": lambda b: regimes.DETECTORS["trend"](b), "quantiles": lambda b: regimes.quantiles(b)}


def leaked(s, d):
    """Of each operator, whether a row before bar 300 changes with the bars from there on: only the last one looks ahead."""
    out = None
    for name, f in CHECKED.items():
        own = lambda b, f=f, c=("regime" if name != "ema_cross" else "raw"): f(b).select("asset", "bar_idx", c)
        one = checks.leaks(own, src.bars_from_events(s, d), 300).agg((F.count("*") > 0).alias("leaks")).select(F.lit(name).alias("operator"), "leaks")
        out = one if out is None else out.unionByName(one)
    return out


add("v1_lookahead", "SELECT * FROM (VALUES ('ema_cross', false), ('trend', false), ('quantiles', true)) v(operator, leaks)", leaked)
add("a9_leg_groups", f"WITH {q.crossed()}, {q.trades()}, l AS (SELECT *, trade_group_id // 2 AS g, (1 - trade_group_id % 2)::INT AS leg FROM trades) SELECT asset, g AS trade_group_id, count(*)::BIGINT AS n_legs, arg_min(entry_idx, leg) AS first_entry, round(sum(pnl), 6) AS net_pnl FROM l GROUP BY 1, 2",
    lambda s, d: checks.leg_groups(simulate.simulate(codes(s, d)).withColumn("leg_id", (1 - F.col("trade_group_id") % 2).cast("int")).withColumn("trade_group_id", F.expr("trade_group_id div 2"))).select("asset", "trade_group_id", "n_legs", F.col("legs")[0]["entry_idx"].alias("first_entry"), rounded("net_pnl").alias("net_pnl")))
add("v2_trade_audit", f"WITH {q.crossed()}, {q.trades()} SELECT t.asset, trade_group_id, entry_idx, round(ef, 6) AS fast FROM (SELECT *, count(*) OVER (PARTITION BY asset) AS n FROM trades) t JOIN emas e ON e.asset = t.asset AND e.bar_idx = t.entry_idx WHERE n <= 5 OR trade_group_id IN (0, n // 4, n // 2, 3 * n // 4, n - 1)",
    lambda s, d: checks.trade_audit(simulate.simulate(codes(s, d)), codes(s, d), ("ema_20",)).select("asset", "trade_group_id", "entry_idx", rounded("ema_20_at_entry").alias("fast")))
