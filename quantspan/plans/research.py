"""Queries over feeds, pairs and cross-sections."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantspan.functions.windows import lag
from quantspan.operators import asof, carry, pairs, portfolio
from quantspan.plans import sql as q
from quantspan.plans.bars import rounded
from quantspan.sources import bars as src

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None, f) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


FEEDS = """fund AS (SELECT asset, time, (m - o) / 10000 AS rate FROM (SELECT event_type AS asset, (floor(epoch(ts))::BIGINT // 28800) * 28800 AS time, avg(value) AS m FROM events GROUP BY 1, 2) JOIN (SELECT event_type AS asset, avg(value) AS o FROM events GROUP BY 1) USING (asset)),
oi AS (SELECT asset, time, sum(n) OVER (PARTITION BY asset ORDER BY time)::DOUBLE AS open_interest FROM (SELECT event_type AS asset, (floor(epoch(ts))::BIGINT // 3600) * 3600 AS time, count(*) AS n FROM events GROUP BY 1, 2)),
bt AS (SELECT asset, bar_idx, epoch(time)::BIGINT AS time, close FROM bars)"""
BASIS = "basis AS (SELECT time, close_spot, close_perp, (close_perp - close_spot) * 1e4 / close_spot AS basis_bp FROM (SELECT time, max(close) FILTER (asset = 'view') AS close_spot, max(close) FILTER (asset = 'click') AS close_perp FROM bars GROUP BY 1) WHERE close_spot IS NOT NULL AND close_perp IS NOT NULL)"
T = "PARTITION BY asset ORDER BY time"


def bar_seconds(spark, sf_dir):
    return src.bars_from_events(spark, sf_dir).select("asset", "bar_idx", F.unix_seconds(F.col("time").cast("timestamp")).alias("time"), "close")


add("s6_funding_feed", f"WITH {q.BARS}, {FEEDS} SELECT asset, time, round(rate, 9) AS rate FROM fund", lambda s, d: src.funding_feed(s, d).select("asset", "time", rounded("rate", 9).alias("rate")))
add("s7_open_interest_feed", f"WITH {q.BARS}, {FEEDS} SELECT asset, time, open_interest FROM oi", lambda s, d: src.open_interest_feed(s, d))
add("s8_basis_feed", f"WITH {q.BARS}, {BASIS} SELECT time, close_spot, close_perp, round(basis_bp, 5) AS basis_bp FROM basis", lambda s, d: src.basis_feed(src.bars_from_events(s, d)).select("time", "close_spot", "close_perp", rounded("basis_bp", 5).alias("basis_bp")))
add("u3_keep_last", "SELECT asset, max(value) AS last_value, count(*)::BIGINT AS n FROM (SELECT event_type AS asset, date_trunc('day', ts) AS day, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2) GROUP BY 1",
    lambda s, d: src.keep_last(s.read.parquet(f"{d}/events.parquet").select(F.concat_ws("|", "event_type", F.date_trunc("day", "ts").cast("string")).alias("key"), F.struct("ts", "event_id").alias("at"), "event_type", "value"), "key", "at").groupBy(F.col("event_type").alias("asset")).agg(F.max("value").alias("last_value"), F.count("*").alias("n")))
add("j2_asof_funding", f"WITH {q.BARS}, {FEEDS} SELECT b.asset, bar_idx, round(rate, 9) AS rate FROM bt b ASOF LEFT JOIN fund f ON b.asset = f.asset AND b.time >= f.time",
    lambda s, d: asof.asof_backward(bar_seconds(s, d), src.funding_feed(s, d), ["rate"]).select("asset", "bar_idx", rounded("rate", 9).alias("rate")))
add("j3_asof_open_interest", f"WITH {q.BARS}, {FEEDS} SELECT b.asset, bar_idx, open_interest FROM bt b ASOF LEFT JOIN oi f ON b.asset = f.asset AND b.time >= f.time",
    lambda s, d: asof.asof_backward(bar_seconds(s, d), src.open_interest_feed(s, d), ["open_interest"]).select("asset", "bar_idx", "open_interest"))
add("j4_asof_basis", f"WITH {q.BARS}, {BASIS} SELECT b.asset, bar_idx, round(basis_bp, 5) AS basis_bp FROM bars b ASOF LEFT JOIN basis f ON b.time >= f.time",
    lambda s, d: (lambda bars: asof.asof_backward(bars.select("asset", "bar_idx", "time"), bars.select("asset").distinct().crossJoin(src.basis_feed(bars)), ["basis_bp"]).select("asset", "bar_idx", rounded("basis_bp", 5).alias("basis_bp")))(src.bars_from_events(s, d)))
add("f9_next_funding_time", f"WITH {q.BARS}, {FEEDS} SELECT asset, bar_idx, (ceil(time / 28800.0) * 28800)::BIGINT AS next_time FROM bt", lambda s, d: bar_seconds(s, d).select("asset", "bar_idx", carry.next_funding_time(F.col("time")).alias("next_time")))

FLIPS = f"fl AS (SELECT asset, time, sign(rate)::INT AS direction, prev, rate AS curr FROM (SELECT *, lag(rate) OVER ({T}) AS prev, coalesce(last_value(nullif(sign(rate), 0) IGNORE NULLS) OVER ({T} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sb FROM fund) WHERE prev IS NOT NULL AND sign(rate) <> 0 AND sign(rate) <> sb AND abs(rate) >= 0.0001)"
add("w29_funding_flips", f"WITH {q.BARS}, {FEEDS}, {FLIPS} SELECT asset, time, direction, round(prev, 9) AS prev, round(curr, 9) AS curr FROM fl",
    lambda s, d: carry.funding_flips(src.funding_feed(s, d), 0.0001).select("asset", "time", "direction", rounded("prev", 9).alias("prev"), rounded("curr", 9).alias("curr")))


def zb(x: str, n: int, part: str = T) -> str:
    r = f"({part} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"(CASE WHEN count({x}) OVER {r} = {n} THEN ({x} - avg({x}) OVER {r}) / nullif(stddev_pop({x}) OVER {r}, 0) END)"


add("w30_basis_blowouts", f"WITH {q.BARS}, {BASIS}, z AS (SELECT *, {zb('basis_bp', 60, 'ORDER BY time')} AS z FROM basis) SELECT time, round(basis_bp, 5) AS basis_bp, round(z, 6) AS z FROM z WHERE abs(z) >= 2",
    lambda s, d: carry.blowouts(src.basis_feed(src.bars_from_events(s, d)).withColumn("asset", F.lit("view/click")), "basis_bp", 60, 2.0).select("time", rounded("basis_bp", 5).alias("basis_bp"), rounded("z").alias("z")))
add("w31_persistent_sign", f"WITH {q.BARS}, {FEEDS}, i AS (SELECT *, sum(CASE WHEN sg = lg THEN 0 ELSE 1 END) OVER ({T}) AS isl FROM (SELECT *, sign(rate)::INT AS sg, lag(sign(rate)::INT) OVER ({T}) AS lg FROM fund)), k AS (SELECT *, row_number() OVER (PARTITION BY asset, isl ORDER BY time) AS streak FROM i) SELECT asset, time, CASE WHEN sg <> 0 AND streak >= 3 THEN -sg ELSE 0 END AS direction, round(CASE WHEN sg = 0 THEN 0 WHEN streak >= 3 THEN streak ELSE streak / 3.0 END, 6) AS strength FROM k",
    lambda s, d: carry.persistent_sign(src.funding_feed(s, d)).select("asset", "time", "direction", rounded("strength").alias("strength")))
add("w32_funding_momentum", f"WITH {q.BARS}, {FEEDS}, z AS (SELECT *, {zb('rate', 20)} AS z FROM fund) SELECT asset, time, CASE WHEN coalesce(abs(z) >= 1.5, false) THEN -sign(z) ELSE 0 END::INT AS direction, round(coalesce(abs(z), 0), 6) AS strength FROM z",
    lambda s, d: carry.momentum(src.funding_feed(s, d)).select("asset", "time", "direction", rounded("strength").alias("strength")))
add("w33_funding_with_interest", f"WITH {q.BARS}, {FEEDS}, j AS (SELECT f.*, open_interest FROM fund f ASOF LEFT JOIN oi o ON f.asset = o.asset AND f.time >= o.time), z AS (SELECT *, {zb('rate', 20)} AS zf, {zb('open_interest', 20)} AS zo FROM j), k AS (SELECT *, sign(zf) * sign(zo) * CASE WHEN zf IS NULL OR zo IS NULL THEN NULL ELSE least(abs(zf), abs(zo)) END AS joint FROM z) SELECT asset, time, CASE WHEN joint > 0 THEN -sign(zf) ELSE 0 END::INT AS direction, round(coalesce(abs(joint), 0), 6) AS strength FROM k",
    lambda s, d: carry.funding_with_interest(src.funding_feed(s, d), src.open_interest_feed(s, d)).select("asset", "time", "direction", rounded("strength").alias("strength")))
SCHED = "en AS (SELECT asset, min(time) AS a, max(time) AS z FROM bt GROUP BY 1), sc AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY time, rank) AS place FROM (SELECT asset, unnest(generate_series(a, z, 21600)) AS time, 'bar' AS kind, 0 AS rank FROM en UNION ALL SELECT asset, time, 'funding', 1 FROM fund JOIN en USING (asset) WHERE time BETWEEN a AND z UNION ALL SELECT asset, time, 'trigger', 2 FROM fl JOIN en USING (asset) WHERE time BETWEEN a AND z))"


def ends(spark, sf_dir):
    """From the first to the last bar of each asset."""
    return bar_seconds(spark, sf_dir).groupBy("asset").agg(F.min("time").alias("start"), F.max("time").alias("stop"))


def scheduled(s, d):
    feed = src.funding_feed(s, d)
    return carry.schedule(ends(s, d), 21600, feed, carry.funding_flips(feed, 0.0001))


add("l1_schedule", f"WITH {q.BARS}, {FEEDS}, {FLIPS}, {SCHED} SELECT asset, time, kind, place FROM sc", lambda s, d: scheduled(s, d).select("asset", "time", "kind", "place"))
add("l2_next_rebalance", f"WITH {q.BARS}, {FEEDS}, {FLIPS}, {SCHED} SELECT asset, min(time) AS time, arg_min(kind, (time, rank)) AS kind FROM sc WHERE time > 1704900000 GROUP BY 1",
    lambda s, d: carry.next_rebalance(scheduled(s, d), 1704900000))

# --- pairs ---------------------------------------------------------------------------------------
LEGS = f"{q.BARS}, legs AS (SELECT *, ln(ca) AS la, ln(cb) AS lb, ln(ca) - ln(cb) AS sp, row_number() OVER (PARTITION BY a, b ORDER BY time) - 1 AS i FROM (SELECT x.time, x.asset AS a, y.asset AS b, x.close AS ca, y.close AS cb FROM bars x JOIN bars y ON x.time = y.time AND x.asset < y.asset))"
P = "PARTITION BY a, b ORDER BY i"
legs = lambda s, d: pairs.pair_legs(src.bars_from_events(s, d))
pr = lambda n, out=False: f"({P} ROWS BETWEEN {n if out else n - 1} PRECEDING AND {'1 PRECEDING' if out else 'CURRENT ROW'})"
add("j7_pairs", f"WITH {LEGS} SELECT a, b, count(*)::BIGINT AS n FROM legs GROUP BY 1, 2", lambda s, d: legs(s, d).groupBy("a", "b").agg(F.count("*").alias("n")))
add("w34_log_ratio", f"WITH {LEGS} SELECT a, b, i AS bar_idx, round(sp, 8) AS spread FROM legs", lambda s, d: legs(s, d).select("a", "b", F.col("bar_idx").cast("long").alias("bar_idx"), rounded("spread", 8).alias("spread")))


def ols(name: str, out: bool) -> None:
    r = pr(60, out)
    slope, level = (f"CASE WHEN count(la) OVER {r} = 60 THEN {f}(la, lb) OVER {r} END" for f in ("regr_slope", "regr_intercept"))

    def run(s, d):
        slope, residual = pairs.ols_residual(60, out)
        return legs(s, d).select("a", "b", F.col("bar_idx").cast("long").alias("bar_idx"), rounded(slope, 5).alias("beta"), rounded(residual, 5).alias("residual"))

    add(name, f"WITH {LEGS}, f AS (SELECT *, {slope} AS s, {level} AS l FROM legs) SELECT a, b, i AS bar_idx, round(s, 5) AS beta, round(la - l - s * lb, 5) AS residual FROM f", run)


ols("w35_ols_residual", False)
ols("w38_regression_forecast", True)
STEP = f"st AS (SELECT *, sp - lag(sp) OVER ({P}) AS ds, lag(sp) OVER ({P}) AS sl FROM legs), hl AS (SELECT a, b, count(*) + 1 AS n, CASE WHEN count(*) + 1 < 3 OR regr_slope(ds, sl) >= 0 THEN 'inf'::DOUBLE ELSE {-math.log(2)!r} / regr_slope(ds, sl) END AS half_life FROM st WHERE sl IS NOT NULL GROUP BY 1, 2)"
add("w39_half_life", f"WITH {LEGS}, {STEP} SELECT a, b, n::BIGINT AS n, round(half_life, 6) AS half_life FROM hl", lambda s, d: pairs.half_lives(legs(s, d)).select("a", "b", "n", rounded("half_life").alias("half_life")))
add("w40_eligibility", f"WITH {LEGS}, {STEP} SELECT a, b, n >= 100 AND half_life BETWEEN 0.1 AND 100 AS ok, CASE WHEN n < 100 THEN 'insufficient data' WHEN half_life NOT BETWEEN 0.1 AND 100 THEN 'half_life outside' ELSE 'ok' END AS reason FROM hl", lambda s, d: pairs.eligibility(pairs.half_lives(legs(s, d))))
add("a14_distance", f"WITH {LEGS}, m AS (SELECT a, b, avg(la) AS ma, avg(lb) AS mb, stddev_pop(la) AS da, stddev_pop(lb) AS db FROM legs GROUP BY 1, 2) SELECT l.a, l.b, round(sum(power((la - ma) / da - (lb - mb) / db, 2)), 5) AS ssd FROM legs l JOIN m ON l.a = m.a AND l.b = m.b GROUP BY 1, 2", lambda s, d: pairs.distances(legs(s, d)).select("a", "b", rounded("ssd", 5).alias("ssd")))
add("t17_screen_pairs", f"WITH {LEGS}, m AS (SELECT a, b, 2 * count(*) * (1 - corr(la, lb)) AS ssd FROM legs GROUP BY 1, 2) SELECT a, b, round(ssd, 5) AS ssd FROM m ORDER BY ssd, a, b LIMIT 3", lambda s, d: pairs.distances(legs(s, d)).orderBy("ssd", "a", "b").limit(3).select("a", "b", rounded("ssd", 5).alias("ssd")))
add("w42_z_stop", f"WITH {LEGS} SELECT a, b, i AS bar_idx, coalesce(count(sp) OVER {pr(60, True)} = 60 AND abs((sp - avg(sp) OVER {pr(60, True)}) / (stddev_samp(sp) OVER {pr(60, True)} + 1e-12)) > 3, false) AS fired FROM legs", lambda s, d: legs(s, d).select("a", "b", F.col("bar_idx").cast("long").alias("bar_idx"), pairs.z_stop("spread").alias("fired")))
CAD = f"f AS (SELECT *, CASE WHEN count(la) OVER {pr(60)} = 60 THEN regr_slope(la, lb) OVER {pr(60)} END AS s FROM legs), c AS (SELECT *, lag(s) OVER ({P}) AS before FROM f WHERE i >= 59 AND (i - 59) % 50 = 0)"


def cadence(s, d):
    """Refits every 50 bars; a refit whose slope jumped by more than half is a breakdown."""
    from quantspan.functions.windows import w

    slope, _ = pairs.ols_residual(60)
    refits = legs(s, d).withColumn("beta", slope).where("bar_idx >= 59 and (bar_idx - 59) % 50 = 0")
    before = F.lag("beta").over(w("a", "b"))
    return refits.select("a", "b", F.col("bar_idx").cast("long").alias("bar_idx"), rounded("beta", 5).alias("beta"), pairs.breakdown(F.col("beta"), before).alias("broken"))


add("w41_refit_cadence", f"WITH {LEGS}, {CAD} SELECT a, b, i AS bar_idx, round(s, 5) AS beta, coalesce(abs(s - before) / nullif(abs(before), 0) > 0.5, false) AS broken FROM c", cadence)
# The filter as a recursion over rows: the state is two numbers and a symmetric 2 x 2 matrix.
KALMAN = f"""WITH RECURSIVE {LEGS}, k AS (
  SELECT a, b, i, la, lb, 0.0::DOUBLE AS s0, 0.0::DOUBLE AS s1, 1.0::DOUBLE AS p00, 0.0::DOUBLE AS p01, 1.0::DOUBLE AS p11, false AS seen FROM legs WHERE i = 0
  UNION ALL
  SELECT n.a, n.b, n.i, n.la, n.lb, s0 + g0 * v, s1 + g1 * v, q0 - g0 * h0, p01 - g0 * h1, q1 - g1 * h1, true
  FROM (SELECT *, h0 / d AS g0, h1 / d AS g1 FROM (SELECT *, q0 + lb * p01 AS h0, p01 + lb * q1 AS h1, (q0 + lb * p01) + lb * (p01 + lb * q1) + 1e-3 AS d, la - s0 - lb * s1 AS v FROM (SELECT *, p00 + 1e-4 AS q0, p11 + 1e-4 AS q1 FROM k))) u
  JOIN (SELECT a AS a2, b AS b2, i - 1 AS j, a, b, i, la, lb FROM legs) n ON n.a2 = u.a AND n.b2 = u.b AND n.j = u.i)"""
KALMAN += ", f AS (SELECT a, b, i - 1 AS i, s0, s1 FROM k WHERE i > 0) SELECT f.a, f.b, f.i AS bar_idx, round(s1, 6) AS beta, round(la - s0 - lb * s1, 6) AS residual FROM f JOIN legs l ON l.a = f.a AND l.b = f.b AND l.i = f.i"
# A row's state is known one row on, so the last row of a pair is left out.
add("w36_kalman", KALMAN, lambda s, d: (lambda k: k.withColumn("last", F.max("bar_idx").over(Window.partitionBy("a", "b"))).where("bar_idx < last").select("a", "b", F.col("bar_idx").cast("long").alias("bar_idx"), rounded("beta").alias("beta"), rounded("residual").alias("residual")))(pairs.kalman(legs(s, d))))
common = lambda s, d: src.common_times(src.bars_from_events(s, d))
add("w37_principal_residuals", None, lambda s, d: pairs.principal_residuals(common(s, d)))
# Of two assets the first component is an angle.
TWO = f"{q.BARS}, com AS (SELECT time FROM bars WHERE asset IN ('click', 'view') GROUP BY 1 HAVING count(*) = 2), pn AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY time) - 1 AS i FROM bars WHERE asset IN ('click', 'view') AND time IN (SELECT time FROM com)), rt AS (SELECT *, ln(close) - lag(ln(close)) OVER (PARTITION BY asset ORDER BY i) AS r FROM pn), tw AS (SELECT i, max(r) FILTER (asset = 'click') AS x, max(r) FILTER (asset = 'view') AS y FROM rt WHERE i > 0 GROUP BY 1), cv AS (SELECT *, count(*) OVER m AS c, atan2(2 * covar_samp(x, y) OVER m, var_samp(x) OVER m - var_samp(y) OVER m) / 2 AS t FROM tw WINDOW m AS (ORDER BY i ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"
add("w37_two_assets", f"WITH {TWO} SELECT i AS bar_idx, 'click' AS asset, round(x - cos(t) * (cos(t) * x + sin(t) * y), 7) AS residual FROM cv WHERE c = 60 UNION ALL SELECT i, 'view', round(y - sin(t) * (cos(t) * x + sin(t) * y), 7) FROM cv WHERE c = 60",
    lambda s, d: pairs.principal_residuals(src.common_times(src.bars_from_events(s, d).where("asset in ('click', 'view')"))).select("bar_idx", "asset", rounded("residual", 7).alias("residual")))
add("t16_engle_granger", None, lambda s, d: pairs.engle_granger(legs(s, d)))
add("t16_beta", f"WITH {LEGS} SELECT a, b, round(regr_slope(la, lb), 8) AS beta FROM legs GROUP BY 1, 2", lambda s, d: pairs.engle_granger(legs(s, d)).select("a", "b", rounded("beta", 8).alias("beta")))
add("t17_screen_cointegrated", None, lambda s, d: pairs.screened(legs(s, d), "engle_granger", 500, 5))
add("t17_screen_distance", f"WITH {LEGS}, la AS (SELECT *, max(i) OVER (PARTITION BY a, b) AS m FROM legs), m AS (SELECT a, b, 2 * count(*) * (1 - corr(la, lb)) AS ssd FROM la WHERE i > m - 500 AND m >= 499 GROUP BY 1, 2) SELECT a, b, round(ssd, 5) AS statistic FROM m ORDER BY ssd, a, b LIMIT 3", lambda s, d: pairs.screened(legs(s, d), "distance", 500, 3).select("a", "b", rounded("statistic", 5).alias("statistic")))
add("w40_eligibility_p", None, lambda s, d: pairs.eligibility(pairs.half_lives(legs(s, d)).join(pairs.engle_granger(legs(s, d)).select("a", "b", "p"), ["a", "b"]), most_p=0.05))
add("w41_breakdown_cadence", None, lambda s, d: pairs.refits(legs(s, d), 100))
add("w41_trigger_cadence", None, lambda s, d: pairs.refits(legs(s, d), 100, trigger=lambda values, since: since >= 120))
add("w41_bars_cadence", f"WITH {LEGS} SELECT a, b, i AS bar_idx, round(s, 5) AS beta FROM (SELECT *, regr_slope(la, lb) OVER {pr(60)} AS s FROM legs) WHERE i >= 100 AND (i - 100) % 90 = 0", lambda s, d: pairs.refits(legs(s, d), 100, every=90).select("a", "b", "bar_idx", rounded("beta", 5).alias("beta")))
HELD = f"WITH {LEGS}, {STEP}"
add("w43_half_life_stop", f"{HELD} SELECT l.a, l.b, i AS bar_idx, coalesce(half_life > 0 AND half_life < 'inf'::DOUBLE AND i - 100 >= 5 * half_life, false) AS fired FROM legs l JOIN hl ON l.a = hl.a AND l.b = hl.b WHERE i >= 100",
    lambda s, d: legs(s, d).where("bar_idx >= 100").join(pairs.half_lives(legs(s, d)).select("a", "b", "half_life"), ["a", "b"]).select("a", "b", F.col("bar_idx").cast("long").alias("bar_idx"), pairs.half_life_stop(F.col("bar_idx") - 100, F.col("half_life")).alias("fired")))


class LineThroughOrigin:
    """A predictor for the regression hook."""

    def fit(self, x, y):
        self.slope = float((x[:, 0] * y).sum() / (x[:, 0] ** 2).sum())

    def predict(self, x):
        return x[:, 0] * self.slope


add("w38_predictor", f"WITH {LEGS}, f AS (SELECT *, count(*) OVER {pr(60, True)} AS n, sum(la * lb) OVER {pr(60, True)} / sum(lb * lb) OVER {pr(60, True)} AS s FROM legs) SELECT a, b, i AS bar_idx, round(la - s * lb, 6) AS residual FROM f WHERE n = 60",
    lambda s, d: pairs.forecast_residual(legs(s, d), LineThroughOrigin).where("bar_idx >= 60").select("a", "b", F.col("bar_idx").cast("long").alias("bar_idx"), rounded("residual").alias("residual")))

# --- cross-sections ------------------------------------------------------------------------------
RET = f"{q.BARS}, com AS (SELECT time FROM bars GROUP BY 1 HAVING count(*) = 5), pan AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY time) - 1 AS k FROM bars WHERE time IN (SELECT time FROM com)), rets AS (SELECT *, close / lag(close) OVER (PARTITION BY asset ORDER BY k) - 1 AS ret, close / lag(close, 20) OVER (PARTITION BY asset ORDER BY k) - 1 AS alpha FROM pan)"
panel = lambda s, d: portfolio.returns(src.common_times(src.bars_from_events(s, d))).withColumn("alpha", F.try_divide(F.col("close"), lag("close", 20)) - 1)
STATS = "be AS (SELECT r.asset, covar_samp(r.ret, m.ret) / nullif(var_samp(m.ret), 0) AS beta, stddev_samp(r.ret) AS vol FROM rets r JOIN (SELECT time, ret FROM rets WHERE asset = 'view') m ON r.time = m.time WHERE r.ret IS NOT NULL AND m.ret IS NOT NULL GROUP BY 1)"
RAW = "bk AS (SELECT time, k, asset, alpha, CASE WHEN alpha IS NULL THEN 0 WHEN row_number() OVER (PARTITION BY time ORDER BY alpha DESC NULLS LAST, asset DESC) <= 2 THEN 1 WHEN row_number() OVER (PARTITION BY time ORDER BY alpha ASC NULLS LAST, asset) <= 2 THEN -1 ELSE 0 END AS raw FROM rets)"
baskets = lambda s, d: portfolio.basket(panel(s, d), 2, 2)
add("w44_momentum_alpha", f"WITH {RET} SELECT asset, k AS bar_idx, round(alpha, 8) AS alpha FROM rets", lambda s, d: panel(s, d).select("asset", "bar_idx", rounded("alpha", 8).alias("alpha")))
add("a13_beta_vol", f"WITH {RET}, {STATS} SELECT asset, round(beta, 6) AS beta, round(vol, 6) AS vol FROM be", lambda s, d: portfolio.betas(panel(s, d), "view").select("asset", rounded("beta").alias("beta"), rounded("vol").alias("vol")))
add("a13_covariance", f"WITH {RET} SELECT x.asset AS a, y.asset AS b, round(covar_samp(x.ret, y.ret), 7) AS cov FROM rets x JOIN rets y ON x.time = y.time WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2", lambda s, d: portfolio.covariances(panel(s, d)).select("a", "b", rounded("cov", 7).alias("cov")))
add("f1_equal_weights", f"WITH {RET} SELECT time, asset, round(1.0 / count(*) OVER (PARTITION BY time), 6) AS weight FROM rets", lambda s, d: panel(s, d).select("time", "asset", rounded(F.lit(1.0) / F.count("*").over(portfolio.at())).alias("weight")))
add("f3_risk_contributions", f"WITH {RET}, c AS (SELECT x.asset AS a, y.asset AS b, covar_samp(x.ret, y.ret) AS cov FROM rets x JOIN rets y ON x.time = y.time WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2) SELECT a AS asset, round(sum(0.04 * cov), 8) AS contribution FROM c GROUP BY 1",
    lambda s, d: (lambda p: portfolio.risk_contributions(p.select("asset", F.lit(0.2).alias("weight")).distinct(), portfolio.covariances(p)).select("asset", rounded("contribution", 8).alias("contribution")))(panel(s, d)))
add("f2_equal_risk", None, lambda s, d: portfolio.equal_risk(portfolio.covariances(panel(s, d)).withColumn("rebalance", F.lit(0))))
add("f8_basket", f"WITH {RET}, {RAW} SELECT time, asset, round(CASE WHEN raw > 0 THEN 0.5 / sum(greatest(raw, 0)) OVER (PARTITION BY time) WHEN raw < 0 THEN -0.5 / sum(greatest(-raw, 0)) OVER (PARTITION BY time) ELSE 0 END, 6) AS weight FROM bk", lambda s, d: baskets(s, d).select("time", "asset", rounded("weight").alias("weight")))
NET = "n AS (SELECT b.*, beta, vol, row_number() OVER (PARTITION BY time ORDER BY abs(beta) DESC, b.asset) AS p FROM bk b JOIN be ON b.asset = be.asset)"
add("f5_beta_neutral", f"WITH {RET}, {STATS}, {RAW}, {NET} SELECT time, asset, round(CASE WHEN p = 1 THEN -sum(CASE WHEN p = 1 THEN 0 ELSE raw * beta END) OVER (PARTITION BY time) / beta ELSE raw END, 6) AS neutral FROM n",
    lambda s, d: (lambda p: portfolio.beta_neutral(portfolio.basket(p, 2, 2).select("time", "asset", F.col("raw").alias("weight")).join(portfolio.betas(p, "view"), "asset")).select("time", "asset", rounded("neutral").alias("neutral")))(panel(s, d)))
add("f6_sigma_neutral", f"WITH {RET}, {STATS}, {RAW}, {NET} SELECT time, asset, round(sign(raw) / vol * sum(abs(raw)) OVER (PARTITION BY time) / sum(1 / vol) OVER (PARTITION BY time), 6) AS neutral FROM n WHERE raw <> 0",
    lambda s, d: (lambda p: portfolio.basket(p, 2, 2).where("raw <> 0").join(portfolio.betas(p, "view"), "asset").select("time", "asset", rounded(portfolio.sigma_neutral(F.col("raw"), F.col("vol"))).alias("neutral")))(panel(s, d)))
CAPS = f"""WITH {RET}, wt AS (SELECT time, asset, alpha / sum(abs(alpha)) OVER (PARTITION BY time) AS weight FROM rets WHERE alpha IS NOT NULL), r0 AS (SELECT *, abs(weight) AS z, 0.0 AS frozen FROM wt)"""
# The rounds themselves, one after another: five assets need five at most.
for _k in range(5):
    CAPS += f""", r{_k + 1} AS (SELECT time, asset, weight, CASE WHEN z > 0.3 + 1e-12 THEN 0.3 WHEN z < 0.3 - 1e-12 THEN z + coalesce(ex * z / nullif(room, 0), 0) ELSE z END AS z
  FROM (SELECT *, sum(greatest(z - 0.3, 0)) OVER (PARTITION BY time) AS ex, sum(CASE WHEN z < 0.3 - 1e-12 THEN z END) OVER (PARTITION BY time) AS room FROM r{_k}))"""
CAPS += ", cp AS (SELECT time, asset, sign(weight) * least(z, 0.3) AS capped FROM r5) SELECT time, asset, round(capped, 7) AS capped, round(CASE WHEN sum(abs(capped)) OVER (PARTITION BY time) > 0.9 THEN capped * 0.9 / sum(abs(capped)) OVER (PARTITION BY time) ELSE capped END, 7) AS weight FROM cp"
add("f7_constraints", CAPS, lambda s, d: portfolio.capped(panel(s, d).select("time", "asset", "alpha").where("alpha is not null").withColumn("weight", F.col("alpha") / F.sum(F.abs("alpha")).over(portfolio.at())), 0.3).select("time", "asset", rounded("capped", 7).alias("capped"), rounded(portfolio.gross_capped(F.col("capped"), 0.9), 7).alias("weight")))
SQL["f7_gross_cap"] = f"WITH {RET} SELECT time, asset, round(CASE WHEN sum(abs(alpha)) OVER (PARTITION BY time) > 0.5 THEN alpha * 0.5 / sum(abs(alpha)) OVER (PARTITION BY time) ELSE alpha END, 6) AS weight FROM rets WHERE alpha IS NOT NULL"
QUERIES["f7_gross_cap"] = lambda s, d: panel(s, d).where("alpha is not null").select("time", "asset", rounded(portfolio.gross_capped(F.col("alpha"), 0.5)).alias("weight"))
add("a11_turnover", f"WITH {RET}, {RAW} SELECT asset, round(sum(abs(raw - pr))::DOUBLE, 6) AS turnover FROM (SELECT *, lag(raw) OVER (PARTITION BY asset ORDER BY k) AS pr FROM bk) WHERE pr IS NOT NULL GROUP BY 1", lambda s, d: baskets(s, d).withColumn("step", F.abs(F.col("raw") - lag("raw"))).where("step is not null").groupBy("asset").agg(rounded(F.sum("step")).alias("turnover")))
add("a10_sortino", f"WITH {RET} SELECT asset, round(CASE WHEN count(ret) >= 2 AND count(*) FILTER (ret < 0) >= 2 THEN avg(ret) / nullif(sqrt(avg(power(least(ret, 0), 2))), 0) END, 6) AS sortino FROM rets WHERE ret IS NOT NULL GROUP BY 1",
    lambda s, d: panel(s, d).where("ret is not null").groupBy("asset").agg(rounded(F.when((F.count("ret") >= 2) & (F.count_if(F.col("ret") < 0) >= 2), F.try_divide(F.avg("ret"), F.nullif(F.sqrt(F.avg(F.pow(F.least("ret", F.lit(0.0)), F.lit(2.0)))), F.lit(0.0))))).alias("sortino")))
add("a12_objective", f"WITH {RET} SELECT r.asset, round(avg(r.ret) / nullif(sqrt(avg(power(least(r.ret, 0), 2))), 0) - 0.5 * abs(coalesce(corr(r.ret, m.ret), 0)), 6) AS objective FROM rets r JOIN (SELECT time, ret FROM rets WHERE asset = 'view') m ON r.time = m.time WHERE r.ret IS NOT NULL AND m.ret IS NOT NULL GROUP BY 1",
    lambda s, d: (lambda p: p.join(p.where("asset = 'view'").select("time", F.col("ret").alias("m")), "time").where("ret is not null and m is not null").groupBy("asset").agg(rounded(F.try_divide(F.avg("ret"), F.sqrt(F.avg(F.pow(F.least("ret", F.lit(0.0)), F.lit(2.0))))) - 0.5 * F.abs(F.coalesce(F.corr("ret", "m"), F.lit(0.0)))).alias("objective")))(panel(s, d)))
PAIRED = f"WITH {RET}, j AS (SELECT r.asset, r.ret, m.ret AS m FROM rets r JOIN (SELECT time, ret FROM rets WHERE asset = 'view') m ON r.time = m.time WHERE r.ret IS NOT NULL AND m.ret IS NOT NULL)"
add("a12_objective_terms", f"{PAIRED} SELECT asset, round(2 * sqrt(8760) * coalesce(CASE WHEN count(*) FILTER (ret < 0) >= 2 THEN avg(ret) / sqrt(avg(power(least(ret, 0), 2))) END, 0) - abs(coalesce(corr(ret, m), 0)) - 0.1 * avg(abs(ret)) + 3 * max(ret), 5) AS objective FROM j GROUP BY 1",
    lambda s, d: (lambda p: p.join(p.where("asset = 'view'").select("time", F.col("ret").alias("m")), "time").where("ret is not null and m is not null").groupBy("asset").agg(rounded(portfolio.objective("ret", "m", F.avg(F.abs("ret")), (2.0, 1.0, 0.1), 8760.0, {"best": (3.0, F.max("ret"))}), 5).alias("objective")))(panel(s, d)))
add("x1_json_values", "SELECT event_type AS asset, count(*)::BIGINT AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1",
    lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("asset")).agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total")))
DATES = "coalesce(try_strptime(x, '%Y-%m-%d %H:%M:%S'), try_strptime(x, '%d/%m/%Y %H:%M'), try_strptime(x, '%Y%m%d'))"
add("x2_dates", f"WITH t AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d 00:00:00') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y 00:00') ELSE strftime(o_orderdate, '%Y%m%d') END AS x FROM orders) SELECT year({DATES})::INT AS y, count(*)::BIGINT AS n, count(*) FILTER ({DATES} IS NULL)::BIGINT AS bad FROM t GROUP BY 1",
    lambda s, d: s.read.parquet(f"{d}/orders.parquet").select(F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd 00:00:00")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd/MM/yyyy 00:00")).otherwise(F.date_format("o_orderdate", "yyyyMMdd")).alias("x")).select(src.parsed_time("x").alias("t")).groupBy(F.year("t").alias("y")).agg(F.count("*").alias("n"), F.count_if(F.col("t").isNull()).alias("bad")))
