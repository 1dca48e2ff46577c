"""Resampling, overfitting and multiple-testing statistics."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspan.config import SEGMENT_WEIGHTS
from quantspan.functions.normal import normal_cdf, normal_quantile

GAMMA = 0.5772156649015329
#: Replicas of a task, values drawn at a time, and the percentiles reported.
REPLICAS, CELLS, BANDS = 50, 1 << 22, (5, 25, 50, 75, 95)


def sharpe_moments(returns: DataFrame, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """``n, sharpe`` (scaled by the root of n), ``skew, kurt`` of returns standardised by the sample deviation."""
    base = returns.groupBy(*keys).agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"))
    rows = returns.join(base, list(keys)).withColumn("z", F.try_divide(F.col("ret") - F.col("mean"), F.nullif(F.col("sd"), F.lit(0.0))))
    return rows.groupBy(*keys).agg(F.first("n").alias("n"), (F.first("mean") / F.nullif(F.first("sd"), F.lit(0.0)) * F.sqrt(F.first("n"))).alias("sharpe"), F.avg(F.pow("z", F.lit(3.0))).alias("skew"), F.avg(F.pow("z", F.lit(4.0))).alias("kurt"))


def correction() -> Column:
    """Variance of a Sharpe ratio of returns that are not normal."""
    return 1 - F.col("skew") * F.col("sharpe") + (F.col("kurt") - 1) * F.col("sharpe") * F.col("sharpe") / 4


def sharpe_z(benchmark: Column) -> Column:
    return F.when((F.col("n") >= 3) & (correction() > 0), (F.col("sharpe") - benchmark) * F.sqrt(F.col("n") - 1) / F.sqrt(correction()))


def expected_max_factor(trials: int) -> float:
    """Expected largest of ``trials`` standard normals."""
    inverse = NormalDist().inv_cdf
    return (1 - GAMMA) * inverse(1 - 1 / trials) + GAMMA * inverse(1 - 1 / (trials * math.e))


def least_backtest_length(trials: int, target: float) -> float:
    return math.inf if target <= 0 else (expected_max_factor(trials) / target) ** 2


def least_track_record(benchmark: float = 0.0, prob: float = 0.95) -> Column:
    excess = F.col("sharpe") - benchmark
    return F.when(excess <= 1e-12, F.lit(math.inf)).otherwise(1 + correction() * F.pow(F.lit(NormalDist().inv_cdf(prob)) / excess, F.lit(2.0)))


def sharpe_pvalues(sharpe: Column) -> Column:
    """One-sided p-value of a Sharpe ratio that is scaled by the root of its sample."""
    return 1 - normal_cdf(sharpe)


def rejections(pvalues: DataFrame, alpha: float = 0.05, keys: tuple[str, ...] = ()) -> DataFrame:
    """``pvalues``: keys of a family, name, p -> whether each test of it is rejected by three procedures."""
    family = Window.partitionBy(*(keys or (F.lit(1),)))
    order = family.orderBy("p", "name")
    ranked = pvalues.withColumn("n", F.count("*").over(family)).withColumn("rank", F.row_number().over(order))
    passed = F.col("p") <= F.lit(alpha) / (F.col("n") - F.col("rank") + 1)
    below = F.max(F.when(F.col("p") <= F.col("rank") * F.lit(alpha) / F.col("n"), F.col("rank"))).over(family)
    holm = F.min(passed.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1
    return ranked.withColumn("bonferroni", F.col("p") <= F.lit(alpha) / F.col("n")).withColumn("holm", holm).withColumn("bh", F.coalesce(F.col("rank") <= below, F.lit(False)))


def equity_returns(equity: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``equity``: keys, strategy, t, equity -> its first differences, 0 in the first row, for :func:`cscv`."""
    step = F.col("equity") - F.lag("equity").over(Window.partitionBy(*keys, "strategy").orderBy("t"))
    return equity.select(*keys, "strategy", "t", F.coalesce(step, F.lit(0.0)).alias("ret"))


def cscv(returns: DataFrame, folds: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """``returns``: keys, strategy, t, ret with t from 0 -> a row for each split of each family: the winner's rank out of sample, as a logit.

    Each split needs only counts, sums and sums of squares of its folds; the series is read once.
    """
    spark, by = returns.sparkSession, list(keys)
    size = returns.groupBy(*by).agg((F.max("t") + 1).alias("length"), F.count_distinct("strategy").alias("tried"))
    sized = returns.join(F.broadcast(size), by) if by else returns.crossJoin(F.broadcast(size))
    fold = F.array_position(F.transform(F.sequence(F.lit(1), F.lit(folds)), lambda k: F.col("t") < F.floor(k * F.col("length") / folds)), F.lit(True)) - 1
    parts = sized.withColumn("fold", fold.cast("int")).groupBy(*by, "strategy", "fold", "tried").agg(F.count("*").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("ss"))
    splits = spark.createDataFrame([(i, k, k in c) for i, c in enumerate(combinations(range(folds), folds // 2)) for k in range(folds)], "split int, fold int, inside boolean")
    sums = parts.join(F.broadcast(splits), "fold").groupBy(*by, "split", "strategy", "inside", "tried").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    mean = F.col("s") / F.col("n")
    variance = F.greatest((F.col("ss") - F.col("n") * mean * mean) / (F.col("n") - 1), F.lit(0.0))
    sums = sums.withColumn("sharpe", F.coalesce(F.try_divide(mean, F.nullif(F.sqrt(variance), F.lit(0.0))), F.lit(0.0)))
    both = sums.groupBy(*by, "split", "strategy", "tried").agg(F.max(F.when(F.col("inside"), F.col("sharpe"))).alias("sr_in"), F.max(F.when(~F.col("inside"), F.col("sharpe"))).alias("sr_out"))
    split = Window.partitionBy(*by, "split")
    ranked = both.withColumn("winner", F.row_number().over(split.orderBy(F.round("sr_in", 12).desc(), "strategy"))).withColumn("rank", F.row_number().over(split.orderBy(F.round("sr_out", 12), "strategy")))
    return ranked.where("winner = 1").select(*by, "split", "strategy", "rank", F.ln(F.col("rank") / (F.col("tried") + 1 - F.col("rank"))).alias("lambda"))


def overfitting_probability(splits: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return splits.groupBy(*keys).agg(F.avg((F.col("lambda") <= 0).cast("double")).alias("pbo"), F.count("*").alias("splits"))


def block_indices(n: int, replicas: int, mean_block: float, seed: int) -> np.ndarray:
    """Stationary-bootstrap places: at each step the next one, or with probability 1 / mean_block any."""
    rng = np.random.default_rng(seed)
    jump = rng.random((replicas, n)) < 1 / mean_block
    jump[:, 0] = True
    begin = np.maximum.accumulate(np.where(jump, np.arange(n), 0), axis=1)
    start = np.take_along_axis(rng.integers(0, n, (replicas, n)), begin, 1)
    return (start + np.arange(n) - begin) % n


def per_trade_sharpe(r: np.ndarray) -> np.ndarray:
    """Mean over sample deviation of each row."""
    sd = r.std(1, ddof=1)
    return np.where(sd > 0, r.mean(1) / np.where(sd > 0, sd, 1), 0.0)


def bootstrap_interval(returns: DataFrame, statistic: Callable[[np.ndarray], np.ndarray] = per_trade_sharpe, replicas: int = 1000, mean_block: float = 10.0, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Interval of a statistic of each asset over resampled series. ``statistic`` takes a matrix, a row a series."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        r, value = rows.sort_values("t")["ret"].to_numpy(), np.empty(replicas)
        each = max(1, CELLS // max(1, len(r)))
        for k in range(0, replicas, each):
            n = min(each, replicas - k)
            value[k : k + n] = statistic(r[block_indices(len(r), n, mean_block, seed + k)])
        low, high = np.percentile(value, [50 * (1 - level), 50 * (1 + level)])
        return pd.DataFrame({"asset": [rows["asset"].iloc[0]], "low": [low], "mean": [value.mean()], "high": [high]})

    return returns.groupBy("asset").applyInPandas(run, "asset string, low double, mean double, high double")


def replica_metrics(r: np.ndarray) -> dict[str, np.ndarray]:
    """Measures of each row of returns."""
    win, n = r > 0, r.shape[1]
    won, lost, rate = np.where(win, r, 0).sum(1), -np.where(win, 0, r).sum(1), win.mean(1)
    curve = 1 + r.cumsum(1)
    high, sd = np.maximum.accumulate(curve, 1), r.std(1)
    mean_won, mean_lost = won / np.maximum(win.sum(1), 1), lost / np.maximum((r < 0).sum(1), 1)
    weights = np.array(SEGMENT_WEIGHTS)
    parts = np.stack([x.sum(1) for x in np.array_split(r, 5, axis=1)], 1)
    return {"roi": r.sum(1), "pf": np.where(lost > 0, won / np.where(lost > 0, lost, 1), 1e9), "win_rate": rate, "exp": mean_won * rate - mean_lost * (1 - rate), "sharpe": np.where(sd > 0, r.mean(1) / np.where(sd > 0, sd, 1) * math.sqrt(n), 0), "max_drawdown": ((high - curve) / high).max(1), "consistency": 0.6 * parts @ weights + 0.4 * r.sum(1)}


def monte_carlo_runs(returns: DataFrame, runs: int = 1000, seed: int = 7) -> DataFrame:
    """``asset, replica, metric, value, final``: measures of resampled (even replicas) and shuffled (odd) series, and of the
    actual one as replica -1. Replicas are dealt into tasks, which hold a bounded number of values at a time."""
    series = returns.groupBy("asset").agg(F.sort_array(F.collect_list(F.struct("t", "ret"))).alias("rows"))
    series = series.select("asset", F.col("rows.ret").alias("r"), F.explode(F.sequence(F.lit(-1), F.lit(runs - 1), F.lit(REPLICAS))).alias("first"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for asset, r, first in zip(batch["asset"], batch["r"], batch["first"], strict=True):
                r = np.asarray(r, np.float64)
                made: dict[str, list] = {c: [] for c in ("replica", "metric", "value", "final")}
                for k in range(first, min(first + REPLICAS, runs)):
                    rng = np.random.default_rng([seed, k + 1])
                    drawn = r[None, :] if k < 0 else np.stack([r[rng.integers(0, len(r), len(r))], rng.permutation(r)])
                    for name, values in replica_metrics(drawn).items():
                        made["replica"] += [2 * k + j if k >= 0 else -1 for j in range(len(drawn))]
                        made["metric"] += [name] * len(drawn)
                        made["value"] += values.tolist()
                        made["final"] += (1 + drawn.sum(1)).tolist()
                yield pd.DataFrame({"asset": asset, **made})

    return series.repartition("asset", "first").mapInPandas(run, "asset string, replica int, metric string, value double, final double")


def monte_carlo(returns: DataFrame, runs: int = 1000, seed: int = 7) -> DataFrame:
    """Of each measure the actual value, its percentile rank among the replicas and their percentiles; with each
    asset's share of replicas that lose and of those that fall by more than four fifths."""
    rows = monte_carlo_runs(returns, runs, seed)
    actual = rows.where("replica = -1").select("asset", "metric", F.col("value").alias("actual"))
    at = F.percentile("value", F.array(*(F.lit(p / 100) for p in BANDS)))
    ranks = rows.where("replica >= 0").join(actual, ["asset", "metric"]).groupBy("asset", "metric").agg(F.first("actual").alias("actual"), (F.avg((F.col("value") <= F.col("actual") + 1e-12).cast("double")) * 100).alias("percentile"), at.alias("bands"), F.avg((F.col("value") < 0).cast("double")).alias("below"), F.avg((F.col("value") > 0.8).cast("double")).alias("deep"))
    odds = ranks.groupBy("asset").agg(F.max(F.when(F.col("metric") == "roi", F.col("below") * 100)).alias("lost_pct"), F.max(F.when(F.col("metric") == "max_drawdown", F.col("deep") * 100)).alias("deep_pct"))
    return ranks.join(odds, "asset").select("asset", "metric", "actual", "percentile", *(F.col("bands")[k].alias(f"p{p}") for k, p in enumerate(BANDS)), "lost_pct", "deep_pct")


def equity_bands(returns: DataFrame, runs: int = 1000, seed: int = 7) -> DataFrame:
    """Percentiles of where the replicas' accounts end."""
    rows = monte_carlo_runs(returns, runs, seed).where("replica >= 0 and metric = 'roi'")
    bands = rows.groupBy("asset").agg(F.percentile("final", F.array(*(F.lit(p / 100) for p in BANDS))).alias("bands"))
    return bands.select("asset", *(F.col("bands")[k].alias(f"p{p}") for k, p in enumerate(BANDS)))


def reality_check(returns: DataFrame, replicas: int = 1000, mean_block: float = 10.0, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """``returns``: family, strategy, t, ret. White's p-value of the best strategy and, of each, whether its
    statistic exceeds the resampled maximum at ``alpha`` (Romano and Wolf, single step)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        table = rows.pivot(index="t", columns="strategy", values="ret").sort_index().fillna(0.0)
        r = table.to_numpy()
        n = len(r)

        def stat(x: np.ndarray) -> np.ndarray:
            sd = x.std(-2, ddof=1)
            return np.where(sd > 0, math.sqrt(n) * x.mean(-2) / np.where(sd > 0, sd, 1), 0)

        seen, centred = stat(r), r - r.mean(0)
        most = np.array([stat(centred[i]).max() for i in block_indices(n, replicas, mean_block, seed)])
        limit = np.percentile(most, 100 * (1 - alpha))
        return pd.DataFrame({"family": rows["family"].iloc[0], "strategy": table.columns, "t_stat": seen, "rejected": seen > limit, "white_p": float((most >= seen.max()).mean())})

    return returns.groupBy("family").applyInPandas(run, "family string, strategy string, t_stat double, rejected boolean, white_p double")


def haircut(sharpe: Column, n: Column, tests: int, method: str = "bhy", periods: float = 252.0) -> Column:
    """Sharpe ratio after adjusting its p-value for the number of strategies tried: a struct of ``t_obs, p_obs,
    p_adj, haircut_sr, haircut_pct``."""
    factor = tests * (1 if method == "bonferroni" else sum(1 / i for i in range(1, tests + 1)))
    once = lambda x, f: F.transform(F.array(x), f)[0]

    def cut(sr: Column, t: Column, p: Column) -> Column:
        adjusted = F.least(p * factor, F.lit(1.0))
        ratio = F.coalesce(F.try_divide(F.greatest(F.coalesce(normal_quantile(1 - adjusted / 2), F.lit(0.0)), F.lit(0.0)), F.abs(t)), F.lit(1.0))
        return once(ratio, lambda r: F.struct(t.alias("t_obs"), p.alias("p_obs"), adjusted.alias("p_adj"), (sr * r).alias("haircut_sr"), (1 - r).alias("haircut_pct")))

    tail = lambda t: F.least(F.greatest(2 * (1 - normal_cdf(F.abs(t))), F.lit(0.0)), F.lit(1.0))
    return once(F.struct(sharpe.alias("sr"), (sharpe / math.sqrt(periods) * F.sqrt(n)).alias("t")), lambda x: once(tail(x["t"]), lambda p: cut(x["sr"], x["t"], p)))


def backtest_length(trials: int, sharpe: Column) -> Column:
    """Least number of observations for the best of ``trials`` to be told from luck at a Sharpe ratio a period."""
    return F.when(sharpe <= 0, F.lit(math.inf)).otherwise(F.pow(F.lit(expected_max_factor(trials)) / sharpe, F.lit(2.0)))


def overfit_report(moments: DataFrame, trials: DataFrame, number: int, pbo: DataFrame | None = None, benchmark: float = 0.0, prob: float = 0.95, periods: float = 252.0) -> DataFrame:
    """``asset, stat, value``: every overfitting measure of the returns that ``moments`` describes.

    ``trials``: asset, spread (of the Sharpe ratios of the ``number`` strategies tried); ``pbo``: asset, pbo. A
    measure that cannot be computed is null.
    """
    one = F.col("sharpe") / F.sqrt("n")
    cut = haircut(one * math.sqrt(periods), F.col("n"), number, periods=periods)
    rows = moments.join(trials, "asset", "left")
    rows = rows.join(pbo.select("asset", "pbo"), "asset", "left") if pbo is not None else rows.withColumn("pbo", F.lit(None).cast("double"))
    stats = {
        "SR": F.col("sharpe"), "DSR": normal_cdf(sharpe_z(F.col("spread") * expected_max_factor(number))), "PSR": normal_cdf(sharpe_z(F.lit(benchmark))),
        "MTRL": least_track_record(benchmark, prob), "MBTL": backtest_length(number, F.abs(one)), "PBO": F.col("pbo"), "HCUT": cut["haircut_sr"],
    }
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("stat"), v.cast("double").alias("value")) for k, v in stats.items())))
    return rows.select("asset", each.alias("s")).select("asset", "s.stat", "s.value")
