"""Parameter search, robustness scenarios and walk-forward runs: every candidate is a key of one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspan.config import Costs
from quantspan.functions.ewm import span, with_ewm
from quantspan.functions.windows import w
from quantspan.operators.signals import flips
from quantspan.operators.simulate import metrics, simulate


def crosses(bars: DataFrame, lookbacks: list[int], keys: tuple[str, ...] = ("asset",), fast: int = 20) -> DataFrame:
    """Codes of the EMA cross for every look-back: keys and ``lb``. Each mean is computed once."""
    means = with_ewm(bars, [span(f"ema_{n}", "close", n) for n in sorted({fast, *lookbacks})], keys)
    slow = F.explode(F.array(*(F.struct(F.lit(n).alias("lb"), F.col(f"ema_{n}").alias("slow")) for n in lookbacks)))
    rows = means.select(*keys, "bar_idx", "time", "open", "high", "low", "close", F.col(f"ema_{fast}").alias("fast"), slow.alias("s")).select("*", "s.lb", "s.slow").drop("s")
    own = (*keys, "lb")
    raw = F.signum(F.lag("fast").over(w(*own)) - F.lag("slow").over(w(*own)))
    return flips(rows.withColumn("raw", F.coalesce(raw, F.lit(0.0)).cast("int")), *own)


def sweep(signals: DataFrame, costs: Costs = Costs(), keys: tuple[str, ...] = ("asset", "lb"), target: Column | None = None) -> DataFrame:
    """Metrics of every run; a run without a trade has a row of zeros."""
    return with_idle(metrics(simulate(signals, costs, keys, target=target), costs, keys), signals.select(*keys).distinct(), keys)


def with_idle(results: DataFrame, runs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``results`` and, for those of ``runs`` that made no trade, zeros; nothing lost is an endless profit factor."""
    rows = runs.join(results, list(keys), "left")
    return rows.fillna(0, subset=["trades", "roi", "win_rate", "exp", "sharpe", "max_drawdown", "consistency"]).fillna(float("inf"), subset=["pf"])


def excursions(trades: DataFrame, bars: DataFrame, stop_pct: float, keys: tuple[str, ...] = ("asset",), most: float = 3.0) -> DataFrame:
    """``peak_r`` and ``close_r``: the best and the last move of each trade in risks, from the close at entry.

    A trade is spread over the bars it was held, so the join is on keys and bar, not on a range.
    """
    held = trades.select(*keys, "trade_group_id", "side", "entry_idx", "exit_idx", F.explode(F.sequence("entry_idx", "exit_idx")).alias("bar_idx"))
    on = [k for k in (*keys, "bar_idx") if k in bars.columns]
    rows = held.join(bars.select(*on, "high", "low", "close"), on)
    spread = rows.groupBy(*keys, "trade_group_id", "side").agg(F.max("high").alias("high"), F.min("low").alias("low"), F.max(F.when(F.col("bar_idx") == F.col("entry_idx"), F.col("close"))).alias("entry"), F.max(F.when(F.col("bar_idx") == F.col("exit_idx"), F.col("close"))).alias("exit"))
    risk = F.col("entry") * stop_pct / 100
    peak = F.when(F.col("side") == 1, F.col("high") - F.col("entry")).otherwise(F.col("entry") - F.col("low")) / risk
    return spread.select(*keys, "trade_group_id", F.least(peak, F.lit(most)).alias("peak_r"), (F.col("side") * (F.col("exit") - F.col("entry")) / risk).alias("close_r"))


def best_reward(moves: DataFrame, most: int = 3, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """The target in risks that would have earned most; the smaller of equals."""
    sums = F.array(*(F.struct(F.sum(F.when(F.col("peak_r") >= r, float(r)).otherwise(F.col("close_r"))).alias("earned"), F.lit(-r).alias("r")) for r in range(1, most + 1)))
    return moves.groupBy(*keys).agg(F.array_max(sums).alias("best")).select(*keys, (-F.col("best.r")).alias("rrr"), F.col("best.earned").alias("earned"))


def surface(signals: DataFrame, multipliers: list[float], costs: Costs = Costs()) -> DataFrame:
    """Metrics over look-back and stop multiplier."""
    spark = signals.sparkSession
    stops = spark.createDataFrame([(m,) for m in multipliers], "sl_mult double")
    every = signals.crossJoin(F.broadcast(stops))
    keys = ("asset", "lb", "sl_mult")
    return metrics(simulate(every, costs, keys, stop=F.col("sl_mult") * costs.stop_pct), costs, keys)


def windows(bars: DataFrame, in_bars: int, out_bars: int) -> DataFrame:
    """Each bar in every window it is part of: ``window_no, sample, idx``; the out-of-sample parts follow one another.

    Which windows hold a bar is arithmetic on its place, so no range join is made.
    """
    n = F.max("bar_idx").over(Window.partitionBy("asset")) + 1
    out = F.floor((F.col("bar_idx") - in_bars) / out_bars)
    first = F.greatest(F.floor((F.col("bar_idx") - in_bars) / out_bars) + 1, F.lit(0))
    last = F.floor(F.col("bar_idx") / out_bars)
    count = F.ceil((F.col("n") - in_bars) / out_bars)
    seen = F.filter(F.sequence(first.cast("long"), F.greatest(last, first).cast("long")), lambda k: (k * out_bars <= F.col("bar_idx")) & (F.col("bar_idx") < k * out_bars + in_bars) & (k < count))
    parts = F.concat(F.transform(seen, lambda k: F.struct(k.alias("window_no"), F.lit("IS").alias("sample"), (F.col("bar_idx") - k * out_bars).alias("idx"))), F.when((F.col("bar_idx") >= in_bars) & (out < count), F.array(F.struct(out.cast("long").alias("window_no"), F.lit("OOS").alias("sample"), (F.col("bar_idx") - in_bars - out * out_bars).alias("idx")))).otherwise(F.array().cast("array<struct<window_no:bigint,sample:string,idx:bigint>>")))
    return bars.withColumn("n", n).withColumn("part", F.explode(parts)).select("asset", "part.window_no", "part.sample", F.col("part.idx").alias("bar_idx"), "time", "open", "high", "low", "close")


def stitched(trades: DataFrame, costs: Costs = Costs(), seed: float = 1.0) -> DataFrame:
    order = Window.partitionBy("asset").orderBy("window_no", "trade_group_id").rowsBetween(Window.unboundedPreceding, 0)
    return trades.withColumn("equity", F.sum(F.col("pnl") / costs.account).over(order) + seed)


def bar_equity(trades: DataFrame, bars: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Account at each bar's close: what closed trades made and what an open one is worth."""
    ended = trades.groupBy("asset", F.col("exit_idx").alias("bar_idx")).agg(F.sum("pnl").alias("made"))
    held = trades.where("exit_idx > entry_idx").select("asset", "side", "qty", "entry_price", F.explode(F.sequence("entry_idx", F.col("exit_idx") - 1)).alias("bar_idx"))
    worth = held.join(bars.select("asset", "bar_idx", "close"), ["asset", "bar_idx"]).groupBy("asset", "bar_idx").agg(F.sum(F.col("side") * F.col("qty") * (F.col("close") - F.col("entry_price"))).alias("open_pnl"))
    rows = bars.select("asset", "bar_idx", "time").join(ended, ["asset", "bar_idx"], "left").join(worth, ["asset", "bar_idx"], "left")
    so_far = w().rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("asset", "bar_idx", "time", (costs.account + F.sum(F.coalesce("made", F.lit(0.0))).over(so_far) + F.coalesce("open_pnl", F.lit(0.0))).alias("equity"))


def bar_sharpe(equity: DataFrame) -> DataFrame:
    seconds = F.unix_seconds(F.col("time").cast("timestamp"))
    steps = equity.select("asset", (F.col("equity") / F.lag("equity").over(w()) - 1).alias("ret"), (seconds - F.lag(seconds).over(w())).alias("step")).where("ret is not null")
    return steps.groupBy("asset").agg(F.when(F.stddev_pop("ret") > 0, F.avg("ret") / F.stddev_pop("ret") * F.sqrt(F.lit(31557600.0) / F.percentile("step", 0.5))).otherwise(0.0).alias("sharpe"))


def shares(base: Column, other: Column) -> Column:
    return F.try_divide(other, F.nullif(base, F.lit(0.0)))
