"""Streaming twins of causal operators: bars over event time with a watermark, and a keyed recursion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quantspan.sources.bars import OFFSET


def stream_bars(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``events``: event_type, ts, event_id, value as a stream. A bar is final once the watermark has passed it."""
    ticks = events.select(F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("at"), "event_id", (F.col("value") + OFFSET).alias("price")).withWatermark("at", late)
    order = F.struct("at", "event_id")
    bars = ticks.groupBy("asset", F.window("at", width).alias("slot")).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").cast("double").alias("volume"))
    return bars.select("asset", F.col("slot.start").cast("timestamp_ntz").alias("time"), "open", "high", "low", "close", "volume")


def stream_ema(bars: DataFrame, n: int) -> DataFrame:
    """``bars``: asset, time, close as a stream in time order per asset -> the running mean; the state is one number."""
    alpha = 2.0 / (n + 1)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean = state.get[0] if state.exists else None
        for rows in [pd.concat(list(batches)).sort_values("time")]:
            out = []
            for close in rows["close"]:
                mean = close if mean is None else alpha * close + (1 - alpha) * mean
                out.append(mean)
            state.update((mean,))
            yield pd.DataFrame({"asset": key[0], "time": rows["time"].to_numpy(), "ema": out})

    return bars.groupBy("asset").applyInPandasWithState(step, "asset string, time timestamp, ema double", "mean double", "append", GroupStateTimeout.NoTimeout)


def stream_rolling(bars: DataFrame, width: str = "20 hours", step: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Mean, extremes and deviation of the closes in each sliding window of time; final once the watermark has passed."""
    rows = bars.withColumn("at", F.col("time").cast("timestamp")).withWatermark("at", late)
    found = rows.groupBy("asset", F.window("at", width, step).alias("slot")).agg(F.count("*").alias("bars"), F.avg("close").alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"), F.stddev_samp("close").alias("sd"))
    return found.select("asset", F.col("slot.end").alias("until"), "bars", "mean", "low", "high", "sd")


def stateful(rows: DataFrame, key: str, start: tuple, step: Callable[[tuple, dict], tuple[tuple, tuple | None]], output: str, state: str, order: str = "time") -> DataFrame:
    """Load a key's state, step through its new rows in time order, write the state back and emit.

    ``step(state, row)`` gives the next state and an output row (without the key) or None. ``start`` is the state
    of a key not met before. A batch's rows of a key are stepped through one by one, the state is what ``state`` says.
    """
    names = [x.split()[0] for x in output.split(", ")]

    def run(found: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(held.get) if held.exists else start
        out: list[tuple] = []
        for row in pd.concat(list(batches)).sort_values(order).to_dict("records"):
            now, made = step(now, row)
            if made is not None:
                out.append((found[0], *made))
        held.update(now)
        yield pd.DataFrame(out, columns=[key, *names])

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {output}", state, "append", GroupStateTimeout.NoTimeout)


def stream_session_vwap(bars: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """The volume-weighted price since the day began in ``zone``."""

    def step(state: tuple, row: dict) -> tuple[tuple, tuple]:
        day = pd.Timestamp(row["time"]).tz_localize("UTC").tz_convert(zone).date().isoformat()
        value, volume = (state[1], state[2]) if state[0] == day else (0.0, 0.0)
        value, volume = value + (row["high"] + row["low"] + row["close"]) / 3 * row["volume"], volume + row["volume"]
        return (day, value, volume), (row["time"], value / volume if volume else None)

    return stateful(bars.select("asset", "time", "high", "low", "close", "volume"), "asset", ("", 0.0, 0.0), step, "time timestamp_ntz, vwap double", "day string, value double, volume double")


def stream_kalman(legs: DataFrame, delta: float = 1e-4, noise: float = 1e-3) -> DataFrame:
    """``legs``: pair, time, log_a, log_b -> slope and what is left after each update; the state is two numbers and a matrix."""

    def step(s: tuple, row: dict) -> tuple[tuple, tuple]:
        level, slope, q00, q01, q11 = s[0], s[1], s[2] + delta, s[3], s[4] + delta
        x, y = row["log_b"], row["log_a"]
        h0, h1 = q00 + x * q01, q01 + x * q11
        d = h0 + x * h1 + noise
        v = y - level - slope * x
        level, slope = level + h0 / d * v, slope + h1 / d * v
        after = (level, slope, q00 - h0 * h0 / d, q01 - h0 * h1 / d, q11 - h1 * h1 / d)
        return after, (row["time"], slope, y - level - slope * x)

    return stateful(legs.select("pair", "time", "log_a", "log_b"), "pair", (0.0, 0.0, 1.0, 0.0, 1.0), step, "time timestamp_ntz, beta double, residual double", "level double, slope double, p00 double, p01 double, p11 double")


def stream_asof(rows: DataFrame, feed: DataFrame, value: str) -> DataFrame:
    """Each bar with the latest ``value`` of the feed at or before it: both streams are one, in which a feed row comes
    before a bar of the same time, and the state is the last value. Bars and feed must arrive in time order."""
    bars = rows.select("asset", F.col("time").cast("timestamp_ntz").alias("time"), F.lit(None).cast("double").alias("value"), F.col("close"), F.lit(1).alias("rank"))
    own = feed.select("asset", F.col("time").cast("timestamp_ntz").alias("time"), F.col(value).cast("double").alias("value"), F.lit(None).cast("double").alias("close"), F.lit(0).alias("rank"))
    both = bars.unionByName(own).withColumn("order", F.struct("time", "rank"))
    both = both.withColumn("order", F.unix_micros(F.col("time").cast("timestamp")) * 2 + F.col("rank")).drop("rank")

    def step(state: tuple, row: dict) -> tuple[tuple, tuple | None]:
        if row["close"] != row["close"]:  # a feed row
            return (row["value"],), None
        return state, (row["time"], row["close"], state[0])

    return stateful(both, "asset", (None,), step, f"time timestamp_ntz, close double, {value} double", "value double", "order")
