"""Operators against plain loops and identities, and the no-look-ahead contract."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantspan.config import SEGMENT_WEIGHTS, Costs
from quantspan.functions.ewm import Ewm, with_ewm
from quantspan.operators import asof, carry, indicators, pairs, portfolio, search, signals, simulate, stats, sweep


def series(n: int = 400, seed: int = 3, assets: tuple[str, ...] = ("x", "y")) -> pd.DataFrame:
    rows = []
    for k, asset in enumerate(assets):
        rng = np.random.default_rng(seed + k)
        close = 100 * np.exp(np.cumsum(rng.normal(5e-5, 0.01, n)))
        rows.append(pd.DataFrame({"asset": asset, "time": pd.date_range("2024-01-01", periods=n, freq="h"), "bar_idx": np.arange(n), "open": np.concatenate([[100.0], close[:-1]]), "high": close * 1.004, "low": close * 0.996, "close": close, "volume": rng.integers(1, 9, n).astype(float)}))
    return pd.concat(rows, ignore_index=True)


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(series()).withColumn("time", F.col("time").cast("timestamp_ntz")).cache()


def loop(rows: pd.DataFrame, c: Costs) -> list[tuple]:
    """Trades bar by bar."""
    out, side, acc = [], 0, 0.0
    o, h, low, code, t = (rows[k].to_numpy() for k in ("open", "high", "low", "code", "time"))

    def close(i, raw):
        price = raw * (1 - side * c.slip)
        out.append((side, entered, i, round(qty * side * (price - entry) - (c.position + qty * price) * c.fee - acc, 9)))

    for i in range(len(rows)):
        if side and pd.Timestamp(t[i]).hour in (0, 8, 16):
            acc += qty * o[i] * c.funding
        if side and code[i] == 0:
            stop, target = entry * (1 - side * c.stop_pct / 100), entry * (1 + side * c.target_pct / 100)
            on_stop = low[i] <= stop if side == 1 else h[i] >= stop
            on_target = (h[i] >= target if side == 1 else low[i] <= target) and not on_stop
            if on_stop or on_target:
                close(i, stop if on_stop else target)
                side, acc = 0, 0.0
                continue
        if code[i]:
            if side:
                close(i, o[i])
            side, acc, entered = (1 if code[i] == 1 else -1), 0.0, i
            entry = o[i] * (1 + side * c.slip)
            qty = c.position / entry
    if side:
        close(len(rows) - 1, o[-1])
    return out


def test_simulation_equals_a_loop(bars):
    coded = signals.flips(signals.ema_cross(bars, 50))
    got = simulate.simulate(coded).orderBy("asset", "trade_group_id").toPandas()
    rows = coded.orderBy("asset", "bar_idx").toPandas()
    for asset, part in rows.groupby("asset"):
        mine = [(r.side, r.entry_idx, r.exit_idx, round(r.pnl, 9)) for r in got[got.asset == asset].itertuples()]
        want = loop(part.reset_index(drop=True), Costs())
        assert [m[:3] for m in mine] == [x[:3] for x in want]
        assert np.allclose([m[3] for m in mine], [x[3] for x in want], atol=1e-8)


def test_costs_add_up(bars):
    t = simulate.simulate(signals.flips(signals.ema_cross(bars, 30))).toPandas()
    assert np.allclose(t.gross_pnl - t.fee - t.slippage - t.funding, t.net_pnl, atol=1e-9)
    assert (t.exit_idx >= t.entry_idx).all()


def test_metrics_of_a_known_run(spark):
    t = spark.createDataFrame([("x", k, p) for k, p in enumerate([1000.0, -500.0, 2000.0, -1000.0, 500.0])], "asset string, trade_group_id long, pnl double")
    m = simulate.metrics(t).first()
    assert m["trades"] == 5 and m["roi"] == pytest.approx(0.02) and m["pf"] == pytest.approx(3500 / 1500) and m["win_rate"] == pytest.approx(0.6)
    r = np.array([0.01, -0.005, 0.02, -0.01, 0.005])
    assert m["sharpe"] == pytest.approx(r.mean() / r.std() * math.sqrt(5))
    assert m["consistency"] == pytest.approx(0.6 * r @ np.array(SEGMENT_WEIGHTS) + 0.4 * 0.02)


def test_ewm_and_rsi_equal_pandas(bars):
    got = indicators.rsi(with_ewm(bars, [Ewm("e", "close", 0.1), Ewm("a", "close", 0.1, True, 5)])).orderBy("asset", "bar_idx").toPandas()
    for _, part in got.groupby("asset"):
        assert np.allclose(part.e, part.close.ewm(alpha=0.1, adjust=False).mean())
        assert np.allclose(part.a.dropna(), part.close.ewm(alpha=0.1, min_periods=5).mean().dropna())
        assert part.rsi.dropna().between(0, 100).all() and part.rsi.iloc[:13].isna().all()


@pytest.mark.parametrize("make", [lambda b: signals.flips(signals.ema_cross(b, 30)), lambda b: signals.regimes(b, n=50), lambda b: indicators.mfi(b), lambda b: signals.rule_flags(b, 20)], ids=["flips", "regimes", "mfi", "rules"])
def test_nothing_looks_ahead(bars, make):
    """What follows bar 300 is spoilt; what comes up to it must not change."""
    spoilt = bars
    for c in ("open", "high", "low", "close"):
        spoilt = spoilt.withColumn(c, F.when(F.col("bar_idx") > 300, F.col(c) * 7 + 3).otherwise(F.col(c)))
    a, b = (make(x).where("bar_idx <= 300").orderBy("asset", "bar_idx").toPandas() for x in (bars, spoilt))
    pd.testing.assert_frame_equal(a, b)


def test_asof_takes_the_latest_at_or_before(spark):
    left = spark.createDataFrame([("x", t) for t in (5, 10, 15, 20)], "asset string, time long")
    right = spark.createDataFrame([("x", 10, 1.0), ("x", 16, 2.0), ("y", 1, 9.0)], "asset string, time long, v double")
    assert [r["v"] for r in asof.asof_backward(left, right, ["v"]).orderBy("time").collect()] == [None, 1.0, 1.0, 2.0]


def test_funding_flips_and_streaks(spark):
    feed = spark.createDataFrame([("x", k, r) for k, r in enumerate([0.0, 0.1, -0.2, -0.3, -0.4, 0.0, -0.1])], "asset string, time long, rate double")
    assert [(r["time"], r["direction"]) for r in carry.funding_flips(feed).orderBy("time").collect()] == [(1, 1), (2, -1)]
    assert [r["direction"] for r in carry.persistent_sign(feed).orderBy("time").collect()] == [0, 0, 0, 0, 1, 0, 0]


def test_pairs(bars):
    legs = pairs.pair_legs(bars)
    slope, residual = pairs.ols_residual(60)
    got = legs.select("bar_idx", "log_a", "log_b", slope.alias("s"), residual.alias("r")).orderBy("bar_idx").toPandas()
    assert got.s.iloc[:59].isna().all()
    part = got.iloc[100 - 59 : 101]
    s, level = np.polyfit(part.log_b, part.log_a, 1)
    assert got.s[100] == pytest.approx(s) and got.r[100] == pytest.approx(part.log_a.iloc[-1] - level - s * part.log_b.iloc[-1])
    assert math.isfinite(pairs.engle_granger(legs).first()["p"])


def test_equal_risk_contributions(spark, bars):
    cov = portfolio.covariances(portfolio.returns(spark.createDataFrame(series(assets=("a", "b", "c"))).withColumn("time", F.col("time").cast("timestamp_ntz"))))
    weights = portfolio.equal_risk(cov.withColumn("rebalance", F.lit(1)))
    shares = [r["contribution"] for r in portfolio.risk_contributions(weights, cov).collect()]
    assert max(shares) == pytest.approx(min(shares), rel=1e-6)
    assert weights.agg(F.sum("weight")).first()[0] == pytest.approx(1)


def test_caps_and_neutrality(spark):
    w = spark.createDataFrame([(1, a, x) for a, x in zip("abcd", (0.6, 0.2, -0.1, -0.1), strict=True)], "time int, asset string, weight double")
    got = {r["asset"]: r["capped"] for r in portfolio.capped(w, 0.4).collect()}
    assert got["a"] == pytest.approx(0.4) and got["b"] == pytest.approx(0.3) and got["c"] == pytest.approx(-0.15)
    side = [r[0] for r in w.select(portfolio.dollar_neutral(F.col("weight"))).collect()]
    assert sum(x for x in side if x > 0) == pytest.approx(0.5) and sum(side) == pytest.approx(0)


def test_walk_forward_windows(bars):
    got = sweep.windows(bars, 150, 100).groupBy("asset", "window_no", "sample").agg(F.count("*").alias("n"), F.min("bar_idx").alias("low")).toPandas()
    assert set(got[got["sample"] == "OOS"].n) == {100, 50} and set(got[got["sample"] == "IS"].n) == {150} and (got.low == 0).all()
    made = search.walk_forward(bars, 150, 100, (15, 30, 50), least_trades=2)
    assert {r["window_no"] for r in made.select("window_no").distinct().collect()} <= {0, 1, 2} and made.where("exit_idx >= 100").count() == 0


def test_cscv_equals_rescans(spark):
    rng, folds = np.random.default_rng(1), 4
    r = rng.normal(size=(80, 3))
    rows = [(str(s), t, float(r[t, s])) for s in range(3) for t in range(80)]
    got = stats.cscv(spark.createDataFrame(rows, "strategy string, t long, ret double"), folds).orderBy("split").toPandas()
    from itertools import combinations

    sr = lambda x: x.mean(0) / x.std(0, ddof=1)
    for k, c in enumerate(combinations(range(folds), 2)):
        inside = np.isin(np.arange(80) // 20, c)
        best = int(sr(r[inside]).argmax())
        rank = int((sr(r[~inside]) <= sr(r[~inside])[best]).sum())
        assert (got["strategy"][k], got["rank"][k]) == (str(best), rank)


def test_cscv_of_families(spark):
    """Each family has the splits it has alone, also when lengths differ."""
    rng, rows = np.random.default_rng(4), []
    for name, length in (("a", 80), ("b", 57)):
        rows += [(name, str(k), t, float(v)) for k in range(3) for t, v in enumerate(rng.normal(size=length))]
    returns = spark.createDataFrame(rows, "asset string, strategy string, t long, ret double")
    got = stats.cscv(returns, 4, ("asset",))
    for name in ("a", "b"):
        alone = stats.cscv(returns.where(f"asset = '{name}'"), 4).select("split", "strategy", "rank").collect()
        assert sorted(got.where(f"asset = '{name}'").select("split", "strategy", "rank").collect()) == sorted(alone) and len(alone) == 6
    assert sorted((r["asset"], r["splits"]) for r in stats.overfitting_probability(got, ("asset",)).collect()) == [("a", 6), ("b", 6)]


def test_bootstrap_places_and_monte_carlo(spark):
    at = stats.block_indices(50, 30, 10.0, 1)
    assert at.shape == (30, 50) and ((at >= 0) & (at < 50)).all()
    assert ((np.diff(at, axis=1) % 50) == 1).mean() > 0.8
    rows = spark.createDataFrame([("x", t, float(v)) for t, v in enumerate(np.random.default_rng(2).normal(0.01, 0.1, 60))], "asset string, t long, ret double")
    assert stats.monte_carlo(rows, 50).where("percentile between 0 and 100").count() == 7
    b = stats.bootstrap_interval(rows, replicas=50).first()
    assert b["low"] <= b["mean"] <= b["high"]


def test_rejections(spark):
    p = spark.createDataFrame([("a", 0.001), ("b", 0.02), ("c", 0.03), ("d", 0.5)], "name string, p double")
    got = {r["name"]: (r["bonferroni"], r["holm"], r["bh"]) for r in stats.rejections(p).collect()}
    assert got == {"a": (True, True, True), "b": (False, False, True), "c": (False, False, True), "d": (False, False, False)}


def test_catalog_is_complete():
    from quantspan import catalog

    assert len(catalog.queries()) >= 100 and set(catalog.oracle_sql()) <= set(catalog.queries())



def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
