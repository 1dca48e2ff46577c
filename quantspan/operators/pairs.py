"""Pairs: spreads, screening, eligibility and stops."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspan.functions.windows import w

PAIR = ("a", "b")


def pair_legs(bars: DataFrame) -> DataFrame:
    """Every pair of assets at their common times: one equi-join on time with the order as a residual."""
    x, y = (bars.select("time", F.col("asset").alias(k), F.col("close").alias(f"close_{k}")) for k in PAIR)
    legs = x.join(y, "time").where("a < b")
    legs = legs.withColumn("bar_idx", F.row_number().over(w(*PAIR, order="time")) - 1)
    return legs.withColumn("log_a", F.ln("close_a")).withColumn("log_b", F.ln("close_b")).withColumn("spread", F.col("log_a") - F.col("log_b"))


def _rows(n: int, excluding_current: bool = False) -> Window:
    return w(*PAIR).rowsBetween(-n, -1) if excluding_current else w(*PAIR).rowsBetween(1 - n, 0)


def ols_residual(n: int = 60, excluding_current: bool = False) -> tuple[Column, Column]:
    """Slope and residual of log a on log b over the last ``n`` rows; null until there are so many."""
    rows = _rows(n, excluding_current)
    full = F.count("log_a").over(rows) == n
    slope, level = (F.when(full, f("log_a", "log_b").over(rows)) for f in (F.regr_slope, F.regr_intercept))
    return slope, F.col("log_a") - level - slope * F.col("log_b")


def half_lives(legs: DataFrame, spread: str = "spread") -> DataFrame:
    steps = legs.select(*PAIR, F.lag(spread).over(w(*PAIR)).alias("before"), spread).where(F.col("before").isNotNull())
    fit = steps.groupBy(*PAIR).agg(F.regr_slope(F.col(spread) - F.col("before"), F.col("before")).alias("slope"), (F.count("*") + 1).alias("n"))
    return fit.select(*PAIR, "n", F.when((F.col("n") < 3) | (F.col("slope") >= 0), F.lit(math.inf)).otherwise(-math.log(2) / F.col("slope")).alias("half_life"))


def eligibility(lives: DataFrame, least: int = 100, low: float = 0.1, high: float = 100.0, most_p: float | None = None) -> DataFrame:
    """Whether a pair may be traded, and why not. With ``most_p``, the column ``p`` of ``lives`` must not exceed it."""
    few, outside = F.col("n") < least, ~F.col("half_life").between(low, high)
    unlikely = F.coalesce(F.col("p") > most_p, F.lit(False)) if most_p is not None else F.lit(False)
    reason = F.when(few, "insufficient data").when(unlikely, "p_value above p_max").when(outside, "half_life outside").otherwise("ok")
    return lives.select(*PAIR, (~few & ~unlikely & ~outside).alias("ok"), reason.alias("reason"))


def distances(legs: DataFrame) -> DataFrame:
    """Sum of squared differences of z-scored log prices, from sums alone: 2n(1 - correlation)."""
    return legs.groupBy(*PAIR).agg((2 * F.count("*") * (1 - F.corr("log_a", "log_b"))).alias("ssd"))


def z_stop(spread: str, n: int = 60, z: float = 3.0) -> Column:
    rows = _rows(n, True)
    score = (F.col(spread) - F.avg(spread).over(rows)) / (F.stddev_samp(spread).over(rows) + 1e-12)
    return F.coalesce((F.count(spread).over(rows) == n) & (F.abs(score) > z), F.lit(False))


def breakdown(slope: Column, before: Column, jump: float = 0.5) -> Column:
    return F.coalesce(F.try_divide(F.abs(slope - before), F.abs(before)) > jump, F.lit(False))


def half_life_stop(held: Column, half_life: Column, times: float = 5.0) -> Column:
    """A position held for ``times`` half-lives; never where there is no finite half-life."""
    known = half_life.isNotNull() & (half_life > 0) & (half_life < float("inf"))
    return F.coalesce(known & (held >= times * half_life), F.lit(False))


def kalman_states(log_a: np.ndarray, log_b: np.ndarray, delta: float = 1e-4, noise: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Slope and what is left after each update of a random-walk level and slope."""
    state, cover = np.zeros(2), np.eye(2)
    beta, residual = np.empty(len(log_a)), np.empty(len(log_a))
    for k, (x, y) in enumerate(zip(log_b, log_a, strict=True)):
        seen = np.array([1.0, x])
        cover = cover + delta * np.eye(2)
        gain = cover @ seen / (seen @ cover @ seen + noise)
        state = state + gain * (y - seen @ state)
        cover = cover - np.outer(gain, seen) @ cover
        beta[k], residual[k] = state[1], y - seen @ state
    return beta, residual


def kalman(legs: DataFrame, delta: float = 1e-4, noise: float = 1e-3) -> DataFrame:
    """A random-walk level and slope, filtered row by row: ``beta, residual`` after each update."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bar_idx")
        beta, residual = kalman_states(rows["log_a"].to_numpy(), rows["log_b"].to_numpy(), delta, noise)
        return rows[["a", "b", "bar_idx"]].assign(beta=beta, residual=residual)

    return legs.select(*PAIR, "bar_idx", "log_a", "log_b").groupBy(*PAIR).applyInPandas(run, "a string, b string, bar_idx int, beta double, residual double")


#: Bars of a block in which windows over the panel's one grid are computed.
SPAN = 512


def principal_residuals(panel: DataFrame, n: int = 60) -> DataFrame:
    """``panel``: asset, bar_idx, close at common times -> of each asset, what is left of its log return after the first
    component of the last ``n`` returns of all assets; the component is that of returns less their means, the
    return it is taken from is as it is.

    Blocks of bars are independent: each has the ``n`` bars before it too. A block's eigen-solutions are made at once.
    """
    steps = panel.select("asset", "bar_idx", (F.ln("close") - F.lag(F.ln("close")).over(w())).alias("ret")).where("ret is not null")
    vectors = steps.groupBy("bar_idx").agg(F.sort_array(F.collect_list(F.struct("asset", "ret"))).alias("rets"))  # one value an asset
    own = F.floor(F.col("bar_idx") / SPAN)
    blocks = F.sequence(own, F.floor((F.col("bar_idx") + n - 1) / SPAN))
    dealt = vectors.select("bar_idx", F.col("rets.asset").alias("assets"), F.col("rets.ret").alias("values"), F.explode(blocks).alias("block"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bar_idx")
        values, at = np.stack(rows["values"].to_list()), rows["bar_idx"].to_numpy()
        out = {"bar_idx": [], "asset": [], "residual": []}
        if len(values) >= n:
            frames = np.lib.stride_tricks.sliding_window_view(values, n, axis=0)  # [bars, assets, n]
            centred = frames - frames.mean(2, keepdims=True)
            first = np.linalg.eigh(centred @ centred.transpose(0, 2, 1) / (n - 1))[1][:, :, -1]
            today, bars = values[n - 1 :], at[n - 1 :]
            left = today - (today * first).sum(1, keepdims=True) * first
            here = (bars // SPAN == rows["block"].iat[0]) & (bars - at[: len(bars)] == n - 1)
            names = list(rows["assets"].iat[0])
            out = {"bar_idx": np.repeat(bars[here], len(names)), "asset": names * int(here.sum()), "residual": left[here].ravel()}
        return pd.DataFrame(out).astype({"bar_idx": "int64", "residual": "float64"})

    return dealt.groupBy("block").applyInPandas(run, "bar_idx long, asset string, residual double")


#: MacKinnon's response surface of the Dickey-Fuller distribution without a constant, one series. Above
#: the first bound p is 1; below the second the quadratic holds, else the cubic, in powers of the statistic.
NO_CONSTANT_LEAST, NO_CONSTANT_TURN = -19.04, -1.04
NO_CONSTANT_SMALL = (0.6344, 1.2378, 0.032496)
NO_CONSTANT_LARGE = (0.4797, 0.93557, -0.06999, 0.033066)


def dickey_fuller_p(statistic: float) -> float:
    """Probability of a statistic as low, if there is a unit root."""
    if statistic < NO_CONSTANT_LEAST:
        return 0.0
    powers = NO_CONSTANT_SMALL if statistic <= NO_CONSTANT_TURN else NO_CONSTANT_LARGE
    return NormalDist().cdf(sum(c * statistic**k for k, c in enumerate(powers)))


def _lagged(resid: np.ndarray, step: np.ndarray, lags: int, skipped: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps from ``skipped`` on, and beside each the level before it and the ``lags`` steps before it."""
    return step[skipped:], np.column_stack([resid[skipped:-1], *(step[skipped - k : -k] for k in range(1, lags + 1))])


def dickey_fuller(resid: np.ndarray) -> float:
    """t statistic of the level in the regression without a constant. Lags by the AIC on the rows that all of them
    have; the chosen one is fitted again on all of its own."""
    n, step = len(resid), np.diff(resid)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 1)
    best, lags = np.inf, 0
    for k in range(most + 1):
        y, x = _lagged(resid, step, k, most)
        left = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        aic = len(y) * np.log(left @ left / len(y)) + 2 * x.shape[1]
        if aic < best:
            best, lags = aic, k
    y, x = _lagged(resid, step, lags, lags)
    coef = np.linalg.lstsq(x, y, rcond=None)[0]
    left = y - x @ coef
    return float(coef[0] / np.sqrt(left @ left / (len(y) - x.shape[1]) * np.linalg.inv(x.T @ x)[0, 0]))


def engle_granger(legs: DataFrame) -> DataFrame:
    """``beta`` of log a on log b, the ``adf`` statistic of what is left, and its ``p``; of a pair that cannot be tested p is infinite."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bar_idx")
        beta = adf = p = float("nan")
        try:
            beta, level = np.polyfit(rows["log_b"], rows["log_a"], 1)
            adf = dickey_fuller((rows["log_a"] - level - beta * rows["log_b"]).to_numpy())
            p = dickey_fuller_p(adf)
        except (np.linalg.LinAlgError, ValueError, ZeroDivisionError):
            pass
        return pd.DataFrame({"a": [rows["a"].iloc[0]], "b": [rows["b"].iloc[0]], "beta": [float(beta)], "adf": [adf], "p": [p if p == p else float("inf")]})

    return legs.select(*PAIR, "bar_idx", "log_a", "log_b").groupBy(*PAIR).applyInPandas(run, "a string, b string, beta double, adf double, p double")


def screened(legs: DataFrame, method: str = "engle_granger", lookback: int = 500, top: int | None = None) -> DataFrame:
    """``a, b, statistic, beta`` of each pair over its last ``lookback`` rows, the lowest statistic first; pairs with fewer rows are left out."""
    if method not in ("engle_granger", "distance"):
        raise ValueError(f"unknown method {method!r}")
    last = F.max("bar_idx").over(Window.partitionBy(*PAIR))
    recent = legs.withColumn("last", last).where(F.col("last") >= lookback - 1).where(F.col("bar_idx") > F.col("last") - lookback).drop("last")
    scored = engle_granger(recent).select(*PAIR, F.col("p").alias("statistic"), "beta") if method == "engle_granger" else distances(recent).select(*PAIR, F.col("ssd").alias("statistic"), F.lit(None).cast("double").alias("beta"))
    ordered = scored.orderBy("statistic", *PAIR)
    return ordered.limit(top) if top else ordered


def ols_spread(log_a: np.ndarray, log_b: np.ndarray, n: int = 60) -> tuple[np.ndarray, float]:
    """What is left of the regression over the last ``n`` rows up to each, and the last slope."""
    out, beta = np.full(len(log_a), np.nan), float("nan")
    for i in range(n - 1, len(log_a)):
        beta, level = np.polyfit(log_b[i - n + 1 : i + 1], log_a[i - n + 1 : i + 1], 1)
        out[i] = log_a[i] - level - beta * log_b[i]
    return out, float(beta)


def broke_down(spread: np.ndarray, since: int) -> bool:
    """From 50 bars after a refit on: the last value is over three deviations off the 10 or more before it."""
    seen = spread[~np.isnan(spread)]
    return since >= 50 and len(seen) >= 10 and abs(seen[-1] - seen[:-1].mean()) / (seen[:-1].std() + 1e-12) > 3.0


def refits(legs: DataFrame, start: int, every: int | None = None, trigger: Callable[[np.ndarray, int], bool] | None = None, spread: Callable = ols_spread, window: int | None = None) -> DataFrame:
    """``a, b, bar_idx, beta`` of every refit, the first at ``start``.

    Refits come ``every`` so many bars, or where ``trigger(values, bars since the last refit)`` says so: it sees the
    spread of the latest fit, which ends at that fit's bar, and of it, with a ``window``, what lies within so many
    bars before the current one. Without either, a breakdown triggers. ``spread(log_a, log_b)`` gives a spread and a
    slope. When a pair is fitted next depends on its last fit, so a pair is one group.
    """
    if every is None and trigger is None:
        trigger, window = broke_down, 60

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bar_idx")
        x, y = rows["log_a"].to_numpy(), rows["log_b"].to_numpy()
        found: list[tuple] = []

        def fit(t: int) -> np.ndarray:
            values, beta = spread(x[: t + 1], y[: t + 1])
            found.append((t, beta))
            return values

        if len(x) > start:
            values = fit(start)
            for t in range(start + 1, len(x)):
                since = t - found[-1][0]
                if since % every == 0 if every else trigger(values[max(0, t - window) if window else 0 : t + 1], since):
                    values = fit(t)
        return pd.DataFrame({"a": rows["a"].iat[0], "b": rows["b"].iat[0], "bar_idx": [t for t, _ in found], "beta": [b for _, b in found]}).astype({"a": str, "b": str, "bar_idx": "int64", "beta": "float64"})

    return legs.select(*PAIR, "bar_idx", "log_a", "log_b").groupBy(*PAIR).applyInPandas(run, "a string, b string, bar_idx long, beta double")


def forecast_residual(legs: DataFrame, predictor: Callable[[], object], n: int = 60) -> DataFrame:
    """``residual`` of log a against a model of it on log b, fitted anew on the ``n`` rows before each.

    ``predictor()`` makes an object with ``fit(x, y)`` and ``predict(x)``. The linear model is :func:`ols_residual`, in SQL.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bar_idx")
        y, x, out = rows["log_a"].to_numpy(), rows[["log_b"]].to_numpy(), np.full(len(rows), np.nan)
        for i in range(n, len(rows)):
            model = predictor()
            model.fit(x[i - n : i], y[i - n : i])
            out[i] = y[i] - float(np.asarray(model.predict(x[i : i + 1])).ravel()[0])
        return rows[["a", "b", "bar_idx"]].assign(residual=out)

    return legs.select(*PAIR, "bar_idx", "log_a", "log_b").groupBy(*PAIR).applyInPandas(run, "a string, b string, bar_idx int, residual double")
