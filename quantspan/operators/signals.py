"""Entry rules, flips and regimes: what a bar may act on comes from the bars before it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspan.functions.windows import lag, rolling, so_far, true, w
from quantspan.operators.indicators import atr, emas, rsi


def ema_cross(bars: DataFrame, slow: int, fast: int = 20) -> DataFrame:
    """``raw``: 1, 0 or -1, by the means of the bar before."""
    means = emas(bars, sorted({fast, slow}))
    sign = F.signum(lag(f"ema_{fast}") - lag(f"ema_{slow}"))
    return means.withColumn("raw", F.coalesce(sign, F.lit(0.0)).cast("int"))


def flips(signals: DataFrame, *keys: str) -> DataFrame:
    """``code``: 1 or 3 where a nonzero raw signal differs from the last nonzero one, else 0."""
    before = w(*keys).rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.last(F.when(F.col("raw") != 0, F.col("raw")), ignorenulls=True).over(before), F.lit(0))
    turned = (F.col("raw") != 0) & (F.col("raw") != held)
    return signals.withColumn("code", F.when(turned & (F.col("raw") == 1), 1).when(turned & (F.col("raw") == -1), 3).otherwise(0))


def drifted(codes: DataFrame, *keys: str) -> DataFrame:
    """Entries a bar later; closes stay and win over an entry that lands on them."""
    before = F.lag("code").over(w(*keys))
    return codes.withColumn("code", F.when(F.col("code").isin(2, 4), F.col("code")).when(before.isin(1, 3), before).otherwise(0))


def trend_regime(bars: DataFrame, column: str, shift: int, run: int = 8) -> Column:
    """Up or down if the close was on one side of the mean for ``run`` bars; shifted, or not, by a bar."""
    close, mean = (lag(c, shift) if shift else F.col(c) for c in ("close", column))
    return F.when(close > mean, 1).when(close < mean, -1).otherwise(0)


def regimes(bars: DataFrame, shift: int = 1, n: int = 200, run: int = 8) -> DataFrame:
    means = emas(bars, [n]) if f"ema_{n}" not in bars.columns else bars
    sided = means.withColumn("side_of_mean", trend_regime(means, f"ema_{n}", shift, run))
    rows = w().rowsBetween(1 - run, 0)
    up, down = (F.sum((F.col("side_of_mean") == s).cast("int")).over(rows) == run for s in (1, -1))
    return sided.withColumn("regime", F.when(up, "Uptrend").when(down, "Downtrend").otherwise("Ranging")).drop("side_of_mean")


def rule_columns(bars: DataFrame, n: int) -> DataFrame:
    """What the entry rules need beyond the bars: changes, deviations and smoothed ranges."""
    out = rsi(atr(bars, n).withColumnRenamed("atr", "atr_n"), 14)
    out = out.withColumn("ret", F.try_divide(F.col("close"), lag("close")) - 1).withColumn("diff", F.col("close") - lag("close")).withColumn("diff2", F.col("close") - lag("close", 2))
    out = out.withColumn("dev", F.col("ret") - rolling(F.avg, "ret", n)).withColumn("z", F.try_divide(F.col("dev"), F.nullif(rolling(F.stddev_samp, "ret", n), F.lit(0.0))))
    out = out.withColumn("dev2", F.pow("dev", F.lit(2.0))).withColumn("dev4", F.pow("dev", F.lit(4.0))).withColumn("z3", F.pow("z", F.lit(3.0)))
    out = out.withColumn("m2", rolling(F.avg, "dev2", n)).withColumn("kappa", F.try_divide(rolling(F.avg, "dev4", n), F.pow(F.col("m2"), F.lit(2.0)))).withColumn("skew", rolling(F.avg, "z3", n))
    out = out.withColumn("body", F.abs(F.col("close") - F.col("open"))).withColumn("range", F.col("high") - F.col("low"))
    burst = F.when(F.abs("diff") > F.nullif(rolling(F.stddev_samp, "diff", n), F.lit(0.0)), 1.0).otherwise(0.0)
    low, high = lag(rolling(F.min, "close", n)), lag(rolling(F.max, "close", n))
    return _lagged(out, {"burst": burst, "vr": F.try_divide(rolling(F.var_pop, "diff2", n), rolling(F.var_pop, "diff", n) * 2), "low_n": rolling(F.min, "close", n), "high_n": rolling(F.max, "close", n), "atr_low": rolling(F.min, "atr_n", n), "atr_high": rolling(F.max, "atr_n", n)})


def _lagged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.select("*", *(c.alias(k) for k, c in columns.items()))


def entry_rules(n: int) -> dict[str, Column]:
    """Of each rule, whether a long and a short entry is kept, over :func:`rule_columns`."""
    c = F.col
    place = F.try_divide(c("close") - lag("low_n"), lag("high_n") - lag("low_n"))
    spread = F.try_divide(lag("atr_n") - lag("atr_low"), lag("atr_high") - lag("atr_low"))
    stuffed = F.coalesce(F.try_divide(lag("body"), F.nullif(lag("range"), F.lit(0.0))), F.lit(0.0))
    both = {
        "RSIge50": lag("rsi") >= 50, "RSIge40": lag("rsi") >= 40,
        "pi": F.try_divide(lag("body"), lag("atr_n")).between(math.pi / 4 - 0.05, math.pi / 4 + 0.05),
        "vr": lag("vr") >= 1, "kurtosis": lag("kappa") >= 5, "kurtosis10": lag("kappa") >= 10, "skew": F.abs(lag("skew")) >= 0.5, "skew0.75": F.abs(lag("skew")) >= 0.75,
        "atr_pct": spread >= 0.7, "atr_pct0.8": spread >= 0.8, "burstfreq": lag("burst_n") >= 0.2,
        "TinyBody": lag("tiny"), "NoNewLowGreen": lag("green"), "RangeSpike": lag("spike"), "YesterdayPeak": lag("peak"), "DeadFlat10": lag("flat"),
        "InsideBar": lag("inside"), "SameDirection": lag("same"), "TopOfRange": lag("top"), "VolContraction": lag("contracted"), "EMAHug": lag("hug"),
    }
    rules = {k: (true(v), true(v)) for k, v in both.items()}
    rules |= {f"Pge{x}": (true(lag("place") >= x), true(lag("place") <= round(1 - x, 1))) for x in (0.8, 0.7)}
    rules["BW_filter"] = (~true(stuffed <= 0.7), F.lit(True))
    del place
    return rules


def rule_flags(bars: DataFrame, n: int) -> DataFrame:
    c = F.col
    base = rule_columns(bars, n)
    return _lagged(base, {
        "burst_n": rolling(F.avg, "burst", n), "place": F.try_divide(c("close") - lag("low_n"), lag("high_n") - lag("low_n")),
        "tiny": c("body") < c("range") * 0.1, "green": true((c("close") > c("open")) & (c("low") > lag("close", 5))),
        "spike": true(c("range") > rolling(F.avg, "range", 20) * 1.3), "peak": true(rolling(F.max, "close", 3) == lag("close")),
        "flat": true(F.abs(F.try_divide(c("close"), lag("close", 10)) - 1) < 0.005), "inside": true((lag("high") <= c("high")) & (lag("low") >= c("low"))),
        "same": (c("close") > c("open")) == true(lag("close") > lag("open")), "top": true(c("close") > rolling(F.max, "high", 50) * 0.99),
        "contracted": true(rolling(F.stddev_samp, "range", 10) < rolling(F.stddev_samp, "range", 100)), "hug": true(F.abs(c("close") - rolling(F.avg, "close", 21)) < c("range") * 0.92),
    })


def confluence(signals: DataFrame, rule: str, n: int) -> DataFrame:
    """``kept``: the raw signal where the rule lets it through; an unknown rule lets all through."""
    long, short = entry_rules(n).get(rule, (F.lit(True), F.lit(True)))
    kept = F.when((F.col("raw") == 1) & long, 1).when((F.col("raw") == -1) & short, 3).otherwise(0)
    return rule_flags(signals, n).withColumn("kept", kept)
