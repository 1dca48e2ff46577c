"""Strategies: functions from bars and a look-back to bars with ``raw`` (1, 0 or -1), where each bar may act
only on the bars before it. Users add their own with :func:`strategy`; all are run alike by the sweeps."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspan.functions.ewm import Ewm, span, with_ewm
from quantspan.functions.windows import lag, rolling, true
from quantspan.operators import indicators as ind
from quantspan.operators.signals import ema_cross

STRATEGIES: dict[str, Callable[[DataFrame, int], DataFrame]] = {}
#: Scores of a model from which a long, and down to which a short, is wanted.
LONG, SHORT = 0.55, 0.45


def strategy(name: str) -> Callable:
    """Register a strategy under ``name``."""

    def add(f: Callable[[DataFrame, int], DataFrame]) -> Callable:
        STRATEGIES[name] = f
        return f

    return add


def signals(bars: DataFrame, name: str, lb: int) -> DataFrame:
    """The bars with the raw signal of a registered strategy."""
    return STRATEGIES[name](bars, lb)


def sided(long: Column, short: Column) -> Column:
    return F.when(true(long), 1).when(true(short), -1).otherwise(0)


def _before(side: Column) -> Column:
    """The signal of the bar before; the first bar keeps its own."""
    return F.coalesce(F.lag(side).over(Window.partitionBy("asset").orderBy("bar_idx")), side)


strategy("ema_cross")(ema_cross)


@strategy("atr_cross_rsi")
def atr_cross_rsi(bars: DataFrame, lb: int, slow: int = 50, least: float = 50.0) -> DataFrame:
    """The short mean of the range crosses the long one, long and short, while momentum is up."""
    rows = with_ewm(ind.rsi(ind.atr(bars, lb), 14), [span("atr_slow", "atr", slow)])
    rows = rows.withColumn("gap", rolling(F.avg, "atr", 3) - F.col("atr_slow"))
    up, down = (lag("gap") > 0) & (lag("gap", 2) <= 0), (lag("gap") < 0) & (lag("gap", 2) >= 0)
    return rows.withColumn("raw", sided(up & (lag("rsi") >= least), down & (lag("rsi") >= least)))


@strategy("sma_cross_rsi")
def sma_cross_rsi(bars: DataFrame, lb: int) -> DataFrame:
    """Two plain means, the slow one three times as long, with a floor on momentum; momentum by seeded means."""
    step = F.col("close") - lag("close")
    rows = bars.withColumn("gain", F.greatest(step, F.lit(0.0))).withColumn("loss", F.greatest(-step, F.lit(0.0)))
    rows = rows.withColumn("gain", F.when(step.isNotNull(), F.col("gain"))).withColumn("loss", F.when(step.isNotNull(), F.col("loss")))
    rows = with_ewm(rows, [Ewm("gain_mean", "gain", 1 / 14), Ewm("loss_mean", "loss", 1 / 14)])
    rows = rows.withColumn("strength", 100 - 100 / (1 + F.try_divide(F.col("gain_mean"), F.nullif("loss_mean", F.lit(0.0)))))
    rows = rows.withColumn("fast", rolling(F.avg, "close", lb)).withColumn("slow", rolling(F.avg, "close", 3 * lb))
    up, down = lag("fast") > lag("slow"), lag("fast") < lag("slow")
    return rows.withColumn("raw", sided(up & (lag("strength") >= 50), down & (lag("strength") < 50)))


@strategy("batch_ema_cross")
def batch_ema_cross(bars: DataFrame, lb: int) -> DataFrame:
    rows = with_ewm(bars, [span("fast", "close", lb), span("slow", "close", 4 * lb)])
    return rows.withColumn("raw", _before(sided(F.col("fast") > F.col("slow"), F.col("fast") < F.col("slow"))))


@strategy("batch_atr_cross")
def batch_atr_cross(bars: DataFrame, lb: int) -> DataFrame:
    """Plain means further apart than the mean range, on the side that momentum is on."""
    rows = ind.rsi(ind.atr(bars, lb), lb).withColumn("fast", rolling(F.avg, "close", lb)).withColumn("slow", rolling(F.avg, "close", 4 * lb))
    long = (F.col("fast") > F.col("slow") + F.col("atr")) & (F.col("rsi") >= 50)
    short = (F.col("fast") < F.col("slow") - F.col("atr")) & (F.col("rsi") <= 50)
    return rows.withColumn("raw", _before(sided(long, short)))


def macd_lengths(lb: int) -> tuple[int, int, int]:
    """Fast, slow and signal length that a look-back stands for."""
    fast = max(2, lb)
    return fast, max(fast + 1, round(lb * 2.16)), max(2, min(9, round(lb * 0.75)))


@strategy("batch_macd")
def batch_macd(bars: DataFrame, lb: int) -> DataFrame:
    fast, slow, signal = macd_lengths(lb)
    rows = with_ewm(bars, [span("fast", "close", fast), span("slow", "close", slow)]).withColumn("line", F.col("fast") - F.col("slow"))
    rows = with_ewm(rows, [span("line_mean", "line", signal)])
    return rows.withColumn("raw", _before(sided(F.col("line") > F.col("line_mean"), F.col("line") < F.col("line_mean"))))


@strategy("batch_rsi")
def batch_rsi(bars: DataFrame, lb: int) -> DataFrame:
    return ind.rsi(bars, lb).withColumn("raw", _before(sided(F.col("rsi") < 35, F.col("rsi") > 65)))


@strategy("batch_stochastic")
def batch_stochastic(bars: DataFrame, lb: int) -> DataFrame:
    rows = bars.withColumn("k", ind.stochastic(lb))
    return rows.withColumn("raw", _before(sided(F.col("k") < 20, F.col("k") > 80)))


@strategy("volume_confirmed_cross")
def volume_confirmed_cross(bars: DataFrame, lb: int, times: float = 1.5) -> DataFrame:
    """A cross of the means of 12 and 26 bars on a bar of more than ``times`` its mean volume."""
    rows = with_ewm(bars, [span("fast", "close", 12), span("slow", "close", 26)]).withColumn("gap", F.col("fast") - F.col("slow"))
    rows = rows.withColumn("loud", F.col("volume") > times * rolling(F.avg, "volume", 20))
    up, down = (lag("gap") > 0) & (lag("gap", 2) <= 0), (lag("gap") < 0) & (lag("gap", 2) >= 0)
    return rows.withColumn("raw", sided(lag("loud") & up, lag("loud") & down))


@strategy("vwap_reversion")
def vwap_reversion(bars: DataFrame, lb: int, band: float = 0.01) -> DataFrame:
    """Against a close that is ``band`` away from the session's volume-weighted price."""
    rows = ind.vwap_session(bars)
    rows = rows.withColumn("away", F.try_divide(F.col("close") - F.col("vwap"), F.col("vwap")))
    return rows.withColumn("raw", sided(lag("away") <= -band, lag("away") >= band))


@strategy("obv_divergence")
def obv_divergence(bars: DataFrame, lb: int, back: int = 14) -> DataFrame:
    """Price and on-balance volume moved apart over ``back`` bars: with the volume."""
    rows = bars.withColumn("previous_close", lag("close")).withColumn("flow", ind.obv())
    rows = rows.withColumn("move", F.col("close") - lag("close", back)).withColumn("drift", F.col("flow") - lag("flow", back))
    return rows.withColumn("raw", sided((lag("move") < 0) & (lag("drift") > 0), (lag("move") > 0) & (lag("drift") < 0)))


@strategy("volume_breakout")
def volume_breakout(bars: DataFrame, lb: int, times: float = 2.0, channel: int = 20) -> DataFrame:
    """A close outside the channel of the bars before it on ``times`` the mean volume."""
    rows = bars.withColumn("loud", ind.relative_volume(20) >= times)
    rows = rows.withColumn("above", F.col("close") > rolling(F.max, "high", channel, excluding_current=True))
    rows = rows.withColumn("below", F.col("close") < rolling(F.min, "low", channel, excluding_current=True))
    late = F.col("bar_idx") >= channel + 2
    return rows.withColumn("raw", sided(late & lag("loud") & lag("above"), late & lag("loud") & lag("below")))


def scored(rows: DataFrame, score: str = "pred") -> DataFrame:
    """Signals from a column of scores, by the bar before: any model whose scores are in the table plugs in here."""
    return rows.withColumn("raw", sided(lag(score) >= LONG, lag(score) <= SHORT))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


@strategy("ml_precomputed")
def ml_precomputed(bars: DataFrame, lb: int) -> DataFrame:
    """Scores from a column ``pred``; where there is none, from 50 bars' mean change over its deviation."""
    if "pred" in bars.columns:
        return scored(bars)
    rows = bars.withColumn("ret", F.try_divide(F.col("close"), lag("close")) - 1)
    rows = rows.withColumn("z", F.try_divide(rolling(F.avg, "ret", 50), F.nullif(rolling(F.stddev_samp, "ret", 50), F.lit(0.0))))
    return scored(rows.withColumn("pred", logistic(2 * F.coalesce(lag("z"), F.lit(0.0)))))


def momentum_score(features: np.ndarray) -> np.ndarray:
    """The predictor used where none is given: a logistic of weighted changes. One row of ``features`` a bar."""
    return 1 / (1 + np.exp(-(features @ np.array([0.6, 0.3, 0.1]))))


def called(bars: DataFrame, lb: int, predict: Callable[[np.ndarray], np.ndarray] = momentum_score) -> DataFrame:
    """A user's predictor on the last three log changes, each over the deviation of the ``lb`` closes before the bar.

    The features are columns; the predictor sees Arrow batches of them as matrices.
    """
    rows = bars.withColumn("step", F.ln("close") - F.ln(lag("close"))).withColumn("sd", rolling(F.stddev_pop, "step", lb - 1))
    usable = (F.col("bar_idx") > lb) & (lag("sd") > 0)
    rows = rows.withColumn("features", F.when(usable, F.array(*(lag("step", k) / lag("sd") for k in (3, 2, 1)))))

    @F.pandas_udf("double")
    def score(features: pd.Series) -> pd.Series:
        has = features.notna()
        out = pd.Series(np.nan, index=features.index, dtype="float64")
        if has.any():
            out[has] = predict(np.stack(features[has].to_list()))
        return out.astype(object).where(has, None).astype("Float64").astype(object)

    rows = rows.withColumn("pred", score("features"))
    return rows.withColumn("raw", sided(F.col("pred") >= LONG, F.col("pred") <= SHORT))


strategy("ml_callback")(called)

FEATURES = ("ret_1", "ret_5", "ret_20", "vol_20", "rsi_14", "atr_14", "hl_range")


def model_features(bars: DataFrame, horizon: int = 5) -> DataFrame:
    """Features of the bar before, and ``label``: whether the close ``horizon`` bars on is higher."""
    rows = ind.rsi(ind.atr(bars, 14), 14).withColumn("ret", F.try_divide(F.col("close"), lag("close")) - 1)
    own = {"ret_1": F.col("ret"), "ret_5": rolling(F.sum, "ret", 5), "ret_20": rolling(F.sum, "ret", 20), "vol_20": rolling(F.stddev_samp, "ret", 20),
           "rsi_14": F.col("rsi"), "atr_14": F.col("atr"), "hl_range": F.try_divide(F.col("high") - F.col("low"), F.col("close"))}
    rows = rows.select("*", *(v.alias(f"now_{k}") for k, v in own.items()))
    label = true(F.lead("close", horizon).over(Window.partitionBy("asset").orderBy("bar_idx")) > F.col("close")).cast("double")
    return rows.select("*", *(lag(f"now_{k}").alias(k) for k in own), label.alias("label")).drop(*(f"now_{k}" for k in own))


def in_sample(rows: DataFrame, inside: int, outside: int) -> DataFrame:
    """The bars that models are fitted on: ``inside`` of them before the last ``outside`` of each asset."""
    n = F.max("bar_idx").over(Window.partitionBy("asset")) + 1
    first = F.greatest(n - outside - inside, F.lit(0))
    return rows.withColumn("fitted", F.col("bar_idx").between(first, n - outside - 1))


def modelled(rows: DataFrame, estimator, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """Scores of a classifier of ``pyspark.ml`` fitted on the rows in ``fitted`` of all assets together."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    known = rows.where("fitted").dropna(subset=[*columns, "label"])
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="assembled"), StandardScaler(inputCol="assembled", outputCol="features", withMean=True), estimator])
    model = pipe.fit(known)
    full = model.transform(rows.fillna(0.0, subset=list(columns)))
    return full.withColumn("pred", vector_to_array("probability")[1]).drop("assembled", "features", "rawPrediction", "probability", "prediction")


@strategy("ml_logistic")
def ml_logistic(bars: DataFrame, lb: int, inside: int = 300, outside: int = 200) -> DataFrame:
    from pyspark.ml.classification import LogisticRegression

    rows = in_sample(model_features(bars), inside, outside)
    return scored(modelled(rows, LogisticRegression(maxIter=200, regParam=1e-3)))


@strategy("ml_forest")
def ml_forest(bars: DataFrame, lb: int, inside: int = 300, outside: int = 200) -> DataFrame:
    from pyspark.ml.classification import RandomForestClassifier

    rows = in_sample(model_features(bars), inside, outside)
    return scored(modelled(rows, RandomForestClassifier(numTrees=50, maxDepth=5, seed=42)))
