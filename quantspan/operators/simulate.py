"""Trades as a relational query.

Between two flips nothing depends on earlier trades: a running count of flips numbers the segments, the
first bar that touches a stop or target ends the trade, else the next flip or the last bar does. Funding is
a difference of two running sums. So any number of assets, look-backs, windows and scenarios is one plan
with one shuffle on their keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspan.config import SEGMENT_WEIGHTS, Costs
from quantspan.functions.windows import so_far


def funding_bar() -> Column:
    return F.hour("time").isin(0, 8, 16) & (F.minute("time") == 0)


def simulate(signals: DataFrame, costs: Costs = Costs(), keys: tuple[str, ...] = ("asset",), fee: Column | None = None, slip: Column | None = None, stop: Column | None = None, target: Column | None = None) -> DataFrame:
    """``signals``: keys, bar_idx, time, prices and ``code`` with alternating entries -> a row a trade.

    ``fee``, ``slip``, ``stop`` and ``target`` may be columns, so that a sweep of them is data. The bar of
    entry is not tested; a bar that touches both levels is a stop; the exit of a flip or of the last bar is
    at its open.
    """
    if costs.pip or costs.max_hold:
        raise ValueError("currency pairs and hold caps need simulate_sequential")
    fee, slip = F.lit(costs.fee) if fee is None else fee, F.lit(costs.slip) if slip is None else slip
    stop, target = F.lit(costs.stop_pct) if stop is None else stop, F.lit(costs.target_pct) if target is None else target
    c = F.col
    if costs.mute_bars:
        signals = signals.withColumn("code", F.when(c("bar_idx") >= costs.mute_bars, c("code")).otherwise(0))
    rows = signals.withColumn("segment", F.sum((c("code") != 0).cast("int")).over(so_far(*keys)))
    rows = rows.withColumn("funded", F.sum(F.when(funding_bar(), c("open")).otherwise(0.0)).over(so_far(*keys)))
    rows = rows.withColumn("last", F.last(F.struct("bar_idx", "open", "funded")).over(Window.partitionBy(*keys).orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where("segment > 0")
    own = so_far(*keys, "segment")
    rows = rows.select(*keys, "segment", "bar_idx", "high", "low", "funded", "last", fee.alias("fee_rate"), slip.alias("slip"), stop.alias("stop"), target.alias("target"), F.first(F.struct(F.when(c("code") == 1, 1).otherwise(-1).alias("side"), "bar_idx", "open", "funded")).over(own).alias("entry"))
    side = c("entry.side")
    rows = rows.withColumn("entry_price", c("entry.open") * (1 + side * c("slip")))
    level_stop, level_target = c("entry_price") * (1 - side * c("stop") / 100), c("entry_price") * (1 + side * c("target") / 100)
    later = c("bar_idx") > c("entry.bar_idx")
    on_stop = later & F.when(side == 1, c("low") <= level_stop).otherwise(c("high") >= level_stop)
    on_target = later & F.when(side == 1, c("high") >= level_target).otherwise(c("low") <= level_target) & ~on_stop
    hit = (on_stop if costs.use_stop else F.lit(False)) | (on_target if costs.use_target else F.lit(False))
    touched = F.when(hit, F.struct("bar_idx", F.when(on_stop, level_stop).otherwise(level_target).alias("price"), "funded", F.when(on_stop, "stop").otherwise("target").alias("kind")))
    trades = rows.groupBy(*keys, "segment").agg(F.first("entry").alias("entry"), F.first("entry_price").alias("entry_price"), F.first("last").alias("last"), F.first("fee_rate").alias("fee_rate"), F.first("slip").alias("slip"), F.first("stop").alias("stop"), F.first("target").alias("target"), F.min(touched).alias("hit"))
    following = F.lead("entry").over(Window.partitionBy(*keys).orderBy("segment"))
    flip = F.when(following.isNotNull(), F.struct(following["bar_idx"].alias("bar_idx"), following["open"].alias("price"), following["funded"].alias("funded"), F.lit("flip").alias("kind")))
    end = F.struct(c("last.bar_idx").alias("bar_idx"), c("last.open").alias("price"), c("last.funded").alias("funded"), F.lit("end").alias("kind"))
    trades = trades.withColumn("exit", F.coalesce(c("hit"), flip, end))
    trades = trades.withColumn("exit_price", c("exit.price") * (1 - side * c("slip"))).withColumn("qty", F.lit(costs.position) / c("entry_price"))
    trades = trades.withColumn("fee", (F.lit(costs.position) + c("qty") * c("exit_price")) * c("fee_rate")).withColumn("funding", c("qty") * costs.funding * (c("exit.funded") - c("entry.funded")))
    move = c("qty") * side * (c("exit_price") - c("entry_price"))
    if costs.clamp and costs.stop_pct > 0:
        risk = c("qty") * c("entry_price") * c("stop") / 100
        move = F.greatest(F.least(move, risk * c("target") / c("stop")), -risk)
    trades = trades.withColumn("pnl", move - c("fee") - c("funding"))
    trades = trades.withColumn("slippage", c("qty") * c("slip") * (c("entry_price") / (1 + side * c("slip")) + c("exit_price") / (1 - side * c("slip"))))
    return trades.select(*keys, (c("segment") - 1).cast("long").alias("trade_group_id"), F.lit(0).alias("leg_id"), side.cast("int").alias("side"), c("entry.bar_idx").alias("entry_idx"), c("exit.bar_idx").alias("exit_idx"), "entry_price", "exit_price", "qty", "pnl", "fee", "slippage", "funding", (c("pnl") + c("fee") + c("slippage") + c("funding")).alias("gross_pnl"), c("pnl").alias("net_pnl"), c("exit.kind").alias("exit_kind"))


def equity(trades: DataFrame, costs: Costs = Costs(), keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """The account after each trade as a share of its start, and the fall from its high.

    For currency pairs: the sum of risks won so far, from 0, and the fall in risks.
    """
    start = 0.0 if costs.pip else 1.0
    rows = Window.partitionBy(*keys).orderBy("trade_group_id").rowsBetween(Window.unboundedPreceding, 0)
    out = trades.withColumn("ret", F.col("pnl") / costs.account).withColumn("equity", start + F.sum(F.col("pnl") / costs.account).over(rows))
    out = out.withColumn("high_water", F.greatest(F.max("equity").over(rows), F.lit(start)))
    fall = F.col("high_water") - F.col("equity")
    return out.withColumn("drawdown", fall if costs.pip else fall / F.col("high_water"))


def metrics(trades: DataFrame, costs: Costs = Costs(), keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """The eight measures of each run."""
    every = Window.partitionBy(*keys)
    at = Window.partitionBy(*keys).orderBy("trade_group_id")
    curve = equity(trades, costs, keys).withColumn("n", F.count("*").over(every)).withColumn("at", F.row_number().over(at) - 1)
    ends = [F.floor((F.col("n") + k) / 5) for k in range(5)]
    part, edge = F.lit(0), F.lit(0).cast("long")
    for k in range(4):
        edge = edge + ends[k]
        part = part + (F.col("at") >= edge).cast("int")
    weight = F.element_at(F.array(*map(F.lit, SEGMENT_WEIGHTS)), part + 1)
    win, ret = F.col("ret") > 0, F.col("ret")
    out = curve.withColumn("weighted", weight * ret).groupBy(*keys).agg(
        F.count("*").alias("trades"), F.sum("ret").alias("roi"), F.sum(F.when(win, ret)).alias("won"), F.sum(F.when(~win, -ret)).alias("lost"), F.avg(win.cast("double")).alias("win_rate"),
        F.avg(F.when(win, ret)).alias("mean_win"), F.avg(F.when(~win, -ret)).alias("mean_loss"), F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("sd"), F.max("drawdown").alias("max_drawdown"), F.sum("weighted").alias("weighted"))
    none = F.lit(0.0)
    return out.select(*keys, "trades", "roi", F.when(F.col("lost").isNull(), F.lit(float("inf"))).otherwise(F.coalesce(F.try_divide(F.coalesce("won", none), "lost"), none)).alias("pf"), "win_rate",
        (F.coalesce("mean_win", none) * F.col("win_rate") - F.coalesce("mean_loss", none) * (1 - F.col("win_rate"))).alias("exp"),
        F.when((F.col("trades") > 1) & (F.col("sd") > 0), F.try_divide("mean", "sd") * F.sqrt("trades")).otherwise(0.0).alias("sharpe"), "max_drawdown", (0.6 * F.col("weighted") + 0.4 * F.col("roi")).alias("consistency"))
