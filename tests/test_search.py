"""Search, scenarios, regime runs, pairs, statistics, loaders and checks against plain loops and known values."""

from __future__ import annotations

import math
import random
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantspan import engine
from quantspan.config import Costs
from quantspan.functions.normal import normal_cdf, normal_quantile
from quantspan.operators import checks, pairs, portfolio, regimes, search, signals, stats, strategies, sweep
from quantspan.sources import feeds
from tests.test_engine import loop, series


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(series()).withColumn("time", F.col("time").cast("timestamp_ntz")).cache()


def test_normal_functions(spark):
    rng = np.random.default_rng(1)
    x = [*rng.normal(0, 3, 200).tolist(), 0.0, -40.0, 40.0]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", normal_cdf(F.col("x")).alias("p")).collect()
    assert max(abs(r["p"] - NormalDist().cdf(r["x"])) for r in got) < 1e-14
    p = [*rng.uniform(0, 1, 200).tolist(), 1e-12, 1 - 1e-9, 0.5]
    got = spark.createDataFrame([(v,) for v in p], "p double").select("p", normal_quantile(F.col("p")).alias("x")).collect()
    assert max(abs(r["x"] - NormalDist().inv_cdf(r["p"])) for r in got) < 1e-8
    odd = spark.createDataFrame([(None,), (0.0,), (1.0,)], "p double").select(normal_quantile(F.col("p")).alias("x")).collect()
    assert [r["x"] for r in odd] == [None, None, None]


def sharpe(trades: list[tuple], account: float = 100_000.0) -> float:
    r = np.array([t[3] for t in trades]) / account
    return r.mean() / r.std() * math.sqrt(len(r)) if len(r) > 1 and r.std() else 0.0


def test_search_equals_a_loop(bars):
    """Probe, best target, run with it, coarse and fine, by plain loops."""
    lbs = tuple(range(12, 18))
    results = search.searched(sweep.crosses(bars, list(lbs)), bars, Costs())
    best = {r["asset"]: (r["lb"], r["rrr"], r["fallback"]) for r in search.chosen(results, least_trades=5, guard=False).collect()}
    for asset, rows in series().groupby("asset"):
        found = {}
        for lb in lbs:
            part = rows.reset_index(drop=True).copy()
            gap = (part.close.ewm(span=20, adjust=False).mean() - part.close.ewm(span=lb, adjust=False).mean()).shift(1)
            raw, held, code = np.sign(gap.fillna(0)), 0, []
            for v in raw:
                code.append({1: 1, -1: 3}[int(v)] if v and v != held else 0)
                held = v or held
            part["code"] = code
            moves = []
            for side, e, x, _ in loop(part, Costs(target_pct=5.0)):
                price = part.close[e]
                reach = (part.high[e : x + 1].max() - price) if side == 1 else (price - part.low[e : x + 1].min())
                moves.append((min(reach / (price / 100), 3.0), side * (part.close[x] - price) / (price / 100)))
            rrr = max((1, 2, 3), key=lambda r: (round(sum(r if p >= r else c for p, c in moves), 9), -r))
            trades = loop(part, Costs(target_pct=float(rrr)))
            found[lb] = (sharpe(trades), len(trades), rrr)
        usable = {lb: v for lb, v in found.items() if v[1] >= 5}
        coarse = max((lb for lb in lbs[::2] if lb in usable), key=lambda lb: (round(usable[lb][0], 9), -lb))
        fine = max((lb for lb in (coarse, coarse - 1, coarse + 1) if lb in usable), key=lambda lb: (round(usable[lb][0], 9), lb == coarse, -lb))
        assert best[asset] == (fine, found[fine][2], False)


def test_fallback_and_runs_without_trades(bars):
    results = search.searched(sweep.crosses(bars, [15, 20, 50]), bars, reward=False)
    assert {(r["lb"], r["fallback"]) for r in search.chosen(results, least_trades=10_000).collect()} == {(50, True)}
    idle = {r["lb"]: r for r in results.where("asset = 'x'").collect()}
    assert idle[20]["trades"] == 0 and idle[20]["pf"] == math.inf and idle[20]["roi"] == 0 and idle[15]["trades"] > 0


def test_windows_by_trades_follow_one_another(bars):
    made = search.walk_forward_by_trades(bars, 150, 4, (15, 30, 50), least_trades=2).select("asset", "window_no", "window_start", "window_stop").distinct().toPandas()
    for _, part in made.groupby("asset"):
        part = part.sort_values("window_no")
        assert part.window_start.iloc[0] == 150 and part.window_stop.iloc[-1] == 400 and (part.window_start.iloc[1:].to_numpy() == part.window_stop.iloc[:-1].to_numpy()).all()


def test_news_candles_equal_a_loop(spark):
    rows = series(1800, assets=("x",))
    got = search.news_candles(spark.createDataFrame(rows), 5).orderBy("bar_idx").toPandas()
    rng, i, high, low = random.Random(5), 0, rows.high.to_list(), rows.low.to_list()
    changed = set()
    while True:
        i += rng.randint(500, 1000)
        if i >= len(rows):
            break
        burst = rng.randint(1, 2)
        for k in range(i, i + burst):
            mean = sum(high[j] - low[j] for j in range(k - 100, k)) / 100
            extent, way = mean * rng.uniform(2, 5), rng.choice(["up", "down", "both"])
            ends = rows.open[k], rows.close[k]
            high[k] = max(high[k], *ends) + (extent if way != "down" else 0)
            low[k] = min(low[k], *ends) - (extent if way != "up" else 0)
            changed.add(k)
        i += burst
    assert changed and np.allclose(got.high, high) and np.allclose(got.low, low)


def test_scenarios(bars):
    specs = {"fees": ("fee",), "late": ("Entry Drift",), "all": ("fee_shock", "slip", "news", "drift", "variance")}
    got = {(r["asset"], r["scenario"]): r for r in search.scenarios(bars, specs).collect()}
    assert len(got) == 8 and got["x", "fees"]["roi"] < got["x", "base"]["roi"]
    assert search.scenario_label(("fee_shock", "entry_drift")) == "FEE+ENT" and search.scenario_label(()) == "NONE"
    assert len({s for _, s in ((r["asset"], r["scenario"]) for r in search.scenarios(bars, {str(k): ("fee",) for k in range(8)}).collect())}) == 6


def test_regime_runs(bars):
    small = engine.Settings.of({"inside": 200, "outside": 100, "lookbacks": (15, 35), "least_trades": 2, "regimes": True, "walk_step": 100})
    found = engine.dispatch(bars, small).collect()
    assert {(r["asset"], r["window_no"], r["sample"]) for r in found} == {(a, k, s) for a in "xy" for k in (0, 1) for s in ("IS", "OOS")}
    assert {r["lb_Uptrend"] for r in found} | {r["lb_Ranging"] for r in found} <= {15, 35, None}
    blocked = bars.sparkSession.createDataFrame([("Ranging", None)], "regime string, side string")
    kept = regimes.filtered(signals.regimes(signals.ema_cross(bars, 50)), blocked).toPandas()
    assert (kept[kept.regime == "Ranging"].kept == 0).all() and (kept[kept.regime != "Ranging"].kept == kept[kept.regime != "Ranging"].raw).all()


def test_settings():
    s = engine.Settings.of({"inside": 5, "fee_pct": 0.5})
    assert s.inside == 5 and s.costs.fee_pct == 0.5 and s.with_(stop_pct=2.0, guard=False).costs.stop_pct == 2.0
    with pytest.raises(ValueError):
        engine.Settings.of({"no_such": 1})


@pytest.mark.parametrize("name", sorted(set(strategies.STRATEGIES) - {"ml_logistic", "ml_forest"}))
def test_strategies_do_not_look_ahead(bars, name):
    checks.assert_no_lookahead(lambda b: strategies.signals(b, name, 15).select("asset", "bar_idx", "raw"), bars, 300)


def test_look_ahead_is_found(bars):
    with pytest.raises(AssertionError, match="later bars"):
        checks.assert_no_lookahead(lambda b: regimes.quantiles(b).select("asset", "bar_idx", "regime"), bars, 300)
    assert checks.leaks(lambda b: signals.regimes(b, n=50).select("asset", "bar_idx", "regime"), bars, 300, checks.missing_after).count() == 0


def test_own_strategy_and_predictor(bars):
    @strategies.strategy("own")
    def own(rows, lb):
        return rows.withColumn("raw", F.when(F.col("bar_idx") % lb == 0, 1).otherwise(-1))

    got = engine.batch(bars, {"mine": ("own", 40), "cross": ("ema_cross", 30)}).collect()
    assert {r["strategy"] for r in got} == {"mine", "cross"} and len(got) == 4
    flat = strategies.called(bars, 15, lambda x: np.full(len(x), 0.9)).where("bar_idx > 15").select("raw").distinct().collect()
    assert [r["raw"] for r in flat] == [1]


def test_models_learn(spark):
    rows = series(500, assets=("x",))
    rows["close"] = 100 + 10 * np.sin(np.arange(500) / 8)
    rows["high"], rows["low"] = rows.close + 0.5, rows.close - 0.5
    got = strategies.signals(spark.createDataFrame(rows).withColumn("time", F.col("time").cast("timestamp_ntz")), "ml_logistic", 1).orderBy("bar_idx").toPandas()
    ahead = np.sign(rows.close.shift(-5) - rows.close)
    late = got.bar_idx.between(320, 480) & (got.raw != 0)
    assert (got.raw[late].to_numpy() == ahead[late.to_numpy()].to_numpy()).mean() > 0.75


def test_kalman_and_principal_residuals_equal_loops(spark, bars):
    three = spark.createDataFrame(series(700, assets=("a", "b", "c"))).withColumn("time", F.col("time").cast("timestamp_ntz"))
    got = pairs.principal_residuals(three, 60).toPandas().pivot(index="bar_idx", columns="asset", values="residual")
    close = series(700, assets=("a", "b", "c")).pivot(index="bar_idx", columns="asset", values="close").to_numpy()
    r = np.diff(np.log(close), axis=0)
    for i in (60, 300, 511, 512, 530, 699):
        part = r[i - 60 : i] - r[i - 60 : i].mean(0)
        first = np.linalg.svd(part)[2][0]
        assert np.allclose(got.loc[i].to_numpy(), r[i - 1] - (r[i - 1] @ first) * first)
    assert got.index.min() == 60 and len(got) == 640
    legs = pairs.pair_legs(bars)
    rows = legs.orderBy("bar_idx").toPandas()
    state, cover = np.zeros(2), np.eye(2)
    for x, y in zip(rows.log_b, rows.log_a, strict=True):
        h = np.array([1.0, x])
        cover = cover + 1e-4 * np.eye(2)
        k = cover @ h / (h @ cover @ h + 1e-3)
        state, cover = state + k * (y - h @ state), (np.eye(2) - np.outer(k, h)) @ cover
    last = pairs.kalman(legs).orderBy(F.desc("bar_idx")).first()
    assert last["beta"] == pytest.approx(state[1])


def test_cointegration(spark):
    assert pairs.dickey_fuller_p(-1.94) == pytest.approx(0.05, abs=1e-3) and pairs.dickey_fuller_p(-2.57) == pytest.approx(0.01, abs=1e-3)
    rng = np.random.default_rng(5)
    walk, noise = np.cumsum(rng.normal(size=600)), rng.normal(size=600)
    assert pairs.dickey_fuller_p(pairs.dickey_fuller(noise)) < 1e-4 < 0.1 < pairs.dickey_fuller_p(pairs.dickey_fuller(walk))
    times = pd.date_range("2024-01-01", periods=600, freq="h").to_pydatetime()
    trend = np.cumsum(rng.normal(0, 0.02, 600))
    prices = {"a": trend + 4, "b": 0.8 * trend + rng.normal(0, 0.01, 600) + 3, "c": np.cumsum(rng.normal(0, 0.02, 600)) + 4}
    rows = [(k, t, i, float(np.exp(v[i]))) for k, v in prices.items() for i, t in enumerate(times)]
    legs = pairs.pair_legs(spark.createDataFrame(rows, "asset string, time timestamp, bar_idx int, close double"))
    found = pairs.screened(legs, "engle_granger", 500).collect()
    assert (found[0]["a"], found[0]["b"]) == ("a", "b") and found[0]["statistic"] < 0.001 and len(found) == 3
    assert pairs.screened(legs, "distance", 5000).count() == 0
    with pytest.raises(ValueError):
        pairs.screened(legs, "no such")


def test_refits(bars):
    legs = pairs.pair_legs(bars)
    every = [r["bar_idx"] for r in pairs.refits(legs, 100, every=90).orderBy("bar_idx").collect()]
    assert every == [100, 190, 280, 370]
    fired = pairs.refits(legs, 100, trigger=lambda values, since: since >= 70).orderBy("bar_idx").collect()
    assert [r["bar_idx"] for r in fired] == [100, 170, 240, 310, 380]
    gaps = np.diff([r["bar_idx"] for r in pairs.refits(legs, 100).orderBy("bar_idx").collect()])
    assert (gaps >= 50).all()


def test_caps_of_many_assets(spark):
    rng = np.random.default_rng(6)
    rows = [(t, f"a{k:02d}", float(w)) for t in range(5) for k, w in enumerate(rng.normal(size=30) ** 3)]
    got = portfolio.capped(spark.createDataFrame(rows, "time int, asset string, weight double"), 2.0).toPandas()
    for t, part in got.groupby("time"):
        size = np.abs(np.array([w for u, _, w in rows if u == t]))
        for _ in range(len(size)):
            over, under = size > 2 + 1e-12, size < 2 - 1e-12
            excess, room = (size[over] - 2).sum(), size[under].sum()
            size = np.where(over, 2.0, np.where(under, size + (excess * size / room if room else 0), size))
        assert np.allclose(np.abs(part.sort_values("asset").capped), np.minimum(size, 2.0))


def test_monte_carlo_and_reality_check(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([("x", t, float(v)) for t, v in enumerate(rng.normal(0.01, 0.1, 60))], "asset string, t long, ret double")
    runs = stats.monte_carlo_runs(rows, 120).toPandas()
    assert runs[runs.replica >= 0].replica.nunique() == 240 and (runs[runs.replica == -1].metric.value_counts() == 1).all()
    odd = runs[(runs.replica >= 0) & (runs.replica % 2 == 1) & (runs.metric == "roi")]
    assert np.allclose(odd.value, runs[(runs.replica == -1) & (runs.metric == "roi")].value.iloc[0])
    bands = stats.equity_bands(rows, 120).first()
    assert bands["p5"] <= bands["p25"] <= bands["p50"] <= bands["p75"] <= bands["p95"]
    strong = [("f", s, t, float(v) + (0.3 if s == "good" else 0)) for s in ("good", "b", "c") for t, v in enumerate(rng.normal(0, 1, 200))]
    got = {r["strategy"]: r for r in stats.reality_check(spark.createDataFrame(strong, "family string, strategy string, t long, ret double"), 200).collect()}
    assert got["good"]["rejected"] and got["good"]["white_p"] < 0.05 and not got["b"]["rejected"]
    report = {r["stat"] for r in stats.overfit_report(stats.sharpe_moments(rows), spark.createDataFrame([("x", 0.5)], "asset string, spread double"), 20).collect()}
    assert report == {"SR", "DSR", "PSR", "MTRL", "MBTL", "PBO", "HCUT"}


def test_haircut(spark):
    cut = spark.range(1).select(stats.haircut(F.lit(1.5), F.lit(756), 10, "bonferroni").alias("h")).select("h.*").first()
    t = 1.5 / math.sqrt(252) * math.sqrt(756)
    p = 2 * (1 - NormalDist().cdf(t))
    assert cut["p_obs"] == pytest.approx(p) and cut["p_adj"] == pytest.approx(10 * p)
    assert cut["haircut_sr"] == pytest.approx(1.5 * NormalDist().inv_cdf(1 - 5 * p) / t, rel=1e-6)


def test_loaders_reject(spark, tmp_path):
    def file(rows, schema, name):
        path = f"{tmp_path}/{name}.parquet"
        spark.createDataFrame(rows, schema).write.parquet(path)
        return path

    good = file([(0, 0.1), (28800, 0.2)], "time long, rate double", "good")
    assert feeds.load_funding(spark, good).count() == 2
    with pytest.raises(feeds.FeedError, match="off the"):
        feeds.load_funding(spark, file([(5, 0.1)], "time long, rate double", "off"))
    with pytest.raises(feeds.FeedError, match="no rate"):
        feeds.load_funding(spark, file([(0, float("nan"))], "time long, rate double", "nan"))
    with pytest.raises(feeds.FeedError, match="lacks"):
        feeds.load_funding(spark, file([(0, 1.0)], "time long, other double", "other"))
    with pytest.raises(feeds.FeedError, match="ending"):
        feeds.load_funding(spark, "x.json")
    with pytest.raises(feeds.FeedError, match="step"):
        feeds.load_open_interest(spark, file([(0, 1.0), (3600, 1.0), (9000, 1.0)], "time long, open_interest double", "oi"))
    with pytest.raises(feeds.FeedError, match="basis"):
        feeds.load_basis(spark, file([(0, 100.0, 101.0, 5.0)], "time long, close_spot double, close_perp double, basis_bp double", "basis"))
    bar = "time double, open double, high double, low double, close double"
    rows = [(float(3600 * k), 1.0, 2.0, 0.5, 1.5) for k in range(5)]
    a = file(rows, bar, "a")
    panel = feeds.load_panel(spark, {"a": a, "b": file(rows[1:], bar, "b")})
    assert panel.count() == 8 and "volume" not in panel.columns
    with pytest.raises(feeds.FeedError, match="repeated"):
        feeds.load_panel(spark, {"a": file([*rows, rows[0]], bar, "twice")})
    with pytest.raises(feeds.FeedError, match="whole seconds"):
        feeds.load_panel(spark, {"a": file([(0.5, 1.0, 2.0, 0.5, 1.5)], bar, "half")})
    with pytest.raises(feeds.FeedError, match="step") as gap:
        feeds.load_panel(spark, {"a": a, "b": file(rows[:2] + rows[3:], bar, "gap")})
    assert gap.value.time == 3 * 3600
    with pytest.raises(feeds.FeedError, match="fewer than two"):
        feeds.load_panel(spark, {"a": a, "b": file([(1.0, 1.0, 2.0, 0.5, 1.5)], bar, "apart")})
