"""Price and volume indicators over bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspan.functions.ewm import Ewm, span, with_ewm
from quantspan.functions.windows import lag, last_rows, rolling, so_far, w


def sma(n: int, x: str = "close") -> Column:
    return rolling(F.avg, x, n)


def emas(bars: DataFrame, spans: list[int]) -> DataFrame:
    return with_ewm(bars, [span(f"ema_{n}", "close", n) for n in spans])


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    both = with_ewm(bars, [span("fast", "close", fast), span("slow", "close", slow)]).withColumn("macd", F.col("fast") - F.col("slow"))
    return with_ewm(both, [span("macd_signal", "macd", signal)]).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """``rsi``: gains and losses smoothed with weights normalised over what there is."""
    change = F.col("close") - lag("close")
    moves = bars.withColumn("gain", F.coalesce(F.greatest(change, F.lit(0.0)), F.lit(0.0))).withColumn("loss", F.coalesce(F.greatest(-change, F.lit(0.0)), F.lit(0.0)))
    means = with_ewm(moves, [Ewm("mean_gain", "gain", 1 / n, True, n), Ewm("mean_loss", "loss", 1 / n, True, n)])
    none = (F.col("mean_loss") == 0) & (F.col("mean_gain") == 0)
    value = F.when(none, None).when(F.col("mean_loss") == 0, 100.0).otherwise(100 - F.try_divide(F.lit(100.0), 1 + F.try_divide("mean_gain", "mean_loss")))
    return means.withColumn("rsi", value).drop("gain", "loss", "mean_gain", "mean_loss")


def true_range() -> Column:
    previous = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - previous), F.abs(F.col("low") - previous))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    return with_ewm(bars.withColumn("true_range", true_range()), [Ewm("atr", "true_range", 1 / n, True, n)]).drop("true_range")


def stochastic(n: int = 14) -> Column:
    low, high = rolling(F.min, "low", n), rolling(F.max, "high", n)
    return F.try_divide((F.col("close") - low) * 100, high - low)


def typical_price() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def relative_volume(n: int) -> Column:
    return F.try_divide(F.col("volume"), rolling(F.avg, "volume", n))


def volume_zscore(n: int) -> Column:
    variance = rolling(F.var_pop, "volume", n)
    return F.when(variance > 1e-300, (F.col("volume") - rolling(F.avg, "volume", n)) / F.sqrt(variance))


def obv() -> Column:
    step = F.coalesce(F.signum(F.col("close") - F.col("previous_close")), F.lit(0.0)) * F.col("volume")
    return F.sum(step).over(so_far())


def money_flow_multiplier() -> Column:
    spread = F.col("high") - F.col("low")
    return F.when(spread == 0, 0.0).otherwise(F.try_divide((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), spread))


def ad_line() -> Column:
    return F.sum(money_flow_multiplier() * F.col("volume")).over(so_far())


def mfi(bars: DataFrame, n: int = 14) -> DataFrame:
    flows = bars.withColumn("tp", typical_price()).withColumn("flow", F.col("tp") * F.col("volume")).withColumn("change", F.col("tp") - lag("tp"))
    rows = last_rows(n)
    up, down = (F.sum(F.when(c, F.col("flow")).otherwise(0.0)).over(rows) for c in (F.col("change") > 0, F.col("change") < 0))
    value = F.when((F.col("bar_idx") < n) | ((up == 0) & (down == 0)), None).when(down == 0, 100.0).otherwise(100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(up, down)))
    return flows.withColumn("mfi", value).drop("tp", "flow", "change")


def vwap_rolling(n: int) -> Column:
    rows = last_rows(n)
    return F.when(F.count("close").over(rows) == n, F.try_divide(F.sum(typical_price() * F.col("volume")).over(rows), F.sum("volume").over(rows)))


def session_resets(anchor_hour: int | None = None) -> Column:
    """True at the first bar, at a change of date in New York, or where its hour passes the anchor."""
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("time"))
    day, hour = F.to_date(local), F.hour(local)
    first = F.lag(F.lit(1)).over(w()).isNull()
    if anchor_hour is None:
        return first | (day != F.lag(day).over(w()))
    shifted = F.to_date(local - F.expr(f"INTERVAL {anchor_hour} HOURS"))
    return first | (shifted != F.lag(shifted).over(w()))


def vwap_session(bars: DataFrame, anchor_hour: int | None = None) -> DataFrame:
    numbered = bars.withColumn("reset", session_resets(anchor_hour)).withColumn("session", F.sum(F.col("reset").cast("int")).over(so_far()))
    rows = so_far("asset", "session")
    return numbered.withColumn("vwap", F.try_divide(F.sum(typical_price() * F.col("volume")).over(rows), F.sum("volume").over(rows))).drop("reset")
