"""Triggers, signals and schedules over slow feeds; each row sees only rows at or before it."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from quantspan.functions.windows import last_rows, w
from quantspan.operators.asof import asof_backward


def next_funding_time(t: Column, slot: int = 28800) -> Column:
    return (F.ceil(t / slot) * slot).cast("long")


def _order() -> Window:
    return w(order="time")


def funding_flips(feed: DataFrame, least: float = 0.0) -> DataFrame:
    """Rows whose sign differs from the last nonzero one, or follows a zero at the start."""
    sign = F.signum("rate")
    before = F.coalesce(F.last(F.nullif(sign, F.lit(0.0)), ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = feed.withColumn("prev", F.lag("rate").over(_order())).withColumn("sign_before", before)
    fired = F.col("prev").isNotNull() & (sign != 0) & (sign != F.col("sign_before")) & (F.abs("rate") >= least)
    return rows.where(fired).select("asset", "time", sign.cast("int").alias("direction"), "prev", F.col("rate").alias("curr"))


def zscore_before(x: str, n: int) -> Column:
    """Against the ``n`` rows before the current one, population deviation; null without all of them."""
    rows = last_rows(n, order="time", excluding_current=True)
    return F.when(F.count(x).over(rows) == n, F.try_divide(F.col(x) - F.avg(x).over(rows), F.nullif(F.stddev_pop(x).over(rows), F.lit(0.0))))


def blowouts(feed: DataFrame, column: str, window: int = 60, z: float = 3.0) -> DataFrame:
    return feed.withColumn("z", zscore_before(column, window)).where(F.abs("z") >= z)


def persistent_sign(feed: DataFrame, least: int = 3) -> DataFrame:
    """``streak`` of rates of one sign that ends here; from ``least`` on, the side that collects the carry."""
    rows = feed.withColumn("sign", F.signum("rate").cast("int"))
    rows = rows.withColumn("island", F.sum(F.coalesce((F.col("sign") != F.lag("sign").over(_order())).cast("int"), F.lit(1))).over(_order()))
    rows = rows.withColumn("streak", F.row_number().over(Window.partitionBy("asset", "island").orderBy("time")))
    long = F.col("streak") >= least
    quiet = F.col("sign") == 0
    return rows.select("asset", "time", F.when(~quiet & long, -F.col("sign")).otherwise(0).alias("direction"), F.when(quiet, 0.0).when(long, F.col("streak").cast("double")).otherwise(F.col("streak") / least).alias("strength"))


def momentum(feed: DataFrame, window: int = 20, z: float = 1.5) -> DataFrame:
    rows = feed.withColumn("z", zscore_before("rate", window))
    far = F.coalesce(F.abs("z") >= z, F.lit(False))
    return rows.select("asset", "time", F.when(far, -F.signum("z")).otherwise(0.0).cast("int").alias("direction"), F.coalesce(F.abs("z"), F.lit(0.0)).alias("strength"))


def funding_with_interest(feed: DataFrame, interest: DataFrame, window: int = 20, scale: float = 1.0) -> DataFrame:
    """Funding and open interest stretched the same way: the joint z-score, and the side against funding."""
    rows = asof_backward(feed, interest, ["open_interest"])
    rows = rows.withColumn("z_f", zscore_before("rate", window)).withColumn("z_o", zscore_before("open_interest", window))
    rows = rows.withColumn("joint", F.signum("z_f") * F.signum("z_o") * F.least(F.abs("z_f"), F.abs("z_o")) * scale)
    return rows.select("asset", "time", F.when(F.col("joint") > 0, -F.signum("z_f")).otherwise(0.0).cast("int").alias("direction"), F.coalesce(F.abs("joint"), F.lit(0.0)).alias("strength"))


def schedule(ends: DataFrame, cadence: int, feed: DataFrame, triggers: DataFrame) -> DataFrame:
    """``ends``: asset, start, stop. Bars, funding times and triggers in one order: bar, funding, trigger."""
    bars = ends.select("asset", F.explode(F.sequence("start", "stop", F.lit(cadence).cast("long"))).alias("time"), F.lit("bar").alias("kind"), F.lit(0).alias("rank"))
    within = lambda df, kind, rank: df.join(ends, "asset").where("time between start and stop").select("asset", "time", F.lit(kind).alias("kind"), F.lit(rank).alias("rank"))
    every = bars.unionByName(within(feed, "funding", 1)).unionByName(within(triggers, "trigger", 2))
    place = F.row_number().over(Window.partitionBy("asset").orderBy("time", "rank"))
    return every.withColumn("place", place)


def events(feed: DataFrame) -> Iterator[Row]:
    """The rows of a feed in time order, one partition at a time on the driver."""
    return feed.orderBy("time").toLocalIterator()


def next_rebalance(scheduled: DataFrame, after: Column | int) -> DataFrame:
    """Of each asset the first event strictly after a time: ``asset, time, kind``."""
    later = scheduled.where(F.col("time") > (after if isinstance(after, Column) else F.lit(after)))
    return later.groupBy("asset").agg(F.min("time").alias("time"), F.min_by("kind", F.struct("time", "rank")).alias("kind"))
