"""Bars, panels and slow feeds as DataFrames, and the checks made when they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantspan.functions.windows import w

#: Added to event values so that prices stay away from zero.
OFFSET = 100.0


def numbered(bars: DataFrame) -> DataFrame:
    """``bar_idx``: the place of each bar in its asset's series."""
    return bars.withColumn("bar_idx", (F.row_number().over(w(order="time")) - 1).cast("long"))


def ticks_to_bars(ticks: DataFrame) -> DataFrame:
    """``ticks``: asset, time (of the bar), at (order), price -> one bar for each asset and time."""
    bars = ticks.groupBy("asset", "time").agg(F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.count("*").cast("double").alias("volume"))
    return numbered(bars)


def bars_from_events(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    """Bars of each event type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ticks_to_bars(events.select(F.col("event_type").alias("asset"), F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("time"), F.struct("ts", "event_id").alias("at"), (F.col("value") + OFFSET).alias("price")))


def bars_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each order priority."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return ticks_to_bars(orders.select(F.col("o_orderpriority").alias("asset"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("time"), F.struct("o_orderdate", "o_orderkey").alias("at"), F.col("o_totalprice").alias("price")))


def load_ohlc(spark: SparkSession, path: str, asset: str) -> DataFrame:
    """A CSV of ``time`` (UNIX seconds) and prices; the volume is optional. Only bar columns are read."""
    header = spark.read.option("header", True).csv(path).columns
    kind = {"time": "long"}
    raw = spark.read.option("header", True).schema(", ".join(f"`{c}` {kind.get(c, 'double')}" for c in header)).csv(path)
    volume = F.coalesce(F.nanvl("volume", F.lit(0.0)), F.lit(0.0)) if "volume" in header else F.lit(0.0)
    prices = [F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("open", "high", "low", "close")]
    return numbered(raw.select(F.lit(asset).alias("asset"), F.timestamp_seconds("time").cast("timestamp_ntz").alias("time"), *prices, volume.alias("volume")))


def regular_grid(bars: DataFrame, step: str = "1 hour") -> DataFrame:
    """Every step from an asset's first to its last bar; a missing bar repeats the last close with no volume."""
    ends = bars.groupBy("asset").agg(F.min("time").alias("first"), F.max("time").alias("last"))
    grid = ends.select("asset", F.explode(F.sequence("first", "last", F.expr(f"INTERVAL {step}"))).alias("time"))
    both = grid.join(bars.drop("bar_idx"), ["asset", "time"], "left")
    filled = F.last("close", ignorenulls=True).over(w(order="time").rowsBetween(Window.unboundedPreceding, 0))
    return numbered(both.select("asset", "time", *(F.coalesce(c, filled).alias(c) for c in ("open", "high", "low", "close")), F.coalesce("volume", F.lit(0.0)).alias("volume")))


def common_times(bars: DataFrame) -> DataFrame:
    """Bars at the times that every asset has: one aggregate and a semi-join instead of a join per asset."""
    assets = bars.select(F.count_distinct("asset").alias("n"))
    times = bars.groupBy("time").agg(F.count_distinct("asset").alias("here")).join(F.broadcast(assets), F.col("here") == F.col("n")).select("time")
    return numbered(bars.drop("bar_idx").join(times, "time", "left_semi").select("asset", "time", "open", "high", "low", "close", "volume"))


def intervals(bars: DataFrame) -> DataFrame:
    """Seconds between bars: ``asset, delta, n``."""
    seconds = F.unix_seconds(F.col("time").cast("timestamp"))
    delta = seconds - F.lag(seconds).over(w(order="time"))
    return bars.select("asset", delta.alias("delta"), "time").where("delta is not null").groupBy("asset", "delta").agg(F.count("*").alias("n"), F.min("time").alias("first_time"))


def modal_interval(bars: DataFrame) -> DataFrame:
    """The most common interval of each asset; of equals the one met first."""
    place = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("n"), "first_time"))
    return intervals(bars).withColumn("place", place).where("place = 1").select("asset", "delta", "n")


def first_gap(bars: DataFrame) -> DataFrame:
    """Of each asset with one, the first bar that does not follow at the modal interval."""
    seconds = F.unix_seconds(F.col("time").cast("timestamp"))
    steps = bars.select("asset", "time", (seconds - F.lag(seconds).over(w(order="time"))).alias("step"))
    odd = steps.join(modal_interval(bars), "asset").where("step <> delta")
    return odd.groupBy("asset").agg(F.min("time").alias("gap_time"), F.count("*").alias("gaps"))


def panel_faults(bars: DataFrame) -> DataFrame:
    """Duplicate bars, missing prices and fractional times of each asset."""
    keyed = bars.groupBy("asset", "time").agg(F.count("*").alias("n"), F.max((F.col("close").isNull() | F.isnan("close")).cast("int")).alias("missing"))
    return keyed.groupBy("asset").agg(F.count("*").alias("bars"), F.sum((F.col("n") > 1).cast("long")).alias("duplicates"), F.sum(F.col("missing").cast("long")).alias("missing"))


def keep_last(feed: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key, the last in order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return feed.withColumn("place", place).where("place = 1").drop("place")


def funding_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A funding-like feed of each event type: the mean value of each eight hours less the mean of all, scaled."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("event_type", "asset")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    slots = events.groupBy("asset", (F.floor(seconds / 28800) * 28800).alias("time")).agg(F.avg("value").alias("mean"))
    overall = events.groupBy("asset").agg(F.avg("value").alias("overall"))
    return slots.join(overall, "asset").select("asset", "time", ((F.col("mean") - F.col("overall")) / 10000).alias("rate"))


def open_interest_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An open-interest-like feed of each event type: hourly running count of events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("event_type", "asset")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    hours = events.groupBy("asset", (F.floor(seconds / 3600) * 3600).alias("time")).agg(F.count("*").alias("n"))
    return hours.select("asset", "time", F.sum("n").over(w(order="time").rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("open_interest"))


def basis_feed(bars: DataFrame, spot: str = "view", perp: str = "click") -> DataFrame:
    """Spot and perpetual closes at common times and the basis in basis points."""
    legs = bars.groupBy("time").agg(F.max(F.when(F.col("asset") == spot, F.col("close"))).alias("close_spot"), F.max(F.when(F.col("asset") == perp, F.col("close"))).alias("close_perp")).where("close_spot is not null and close_perp is not null")
    return legs.select("time", "close_spot", "close_perp", F.try_divide((F.col("close_perp") - F.col("close_spot")) * 1e4, "close_spot").alias("basis_bp"))


def append_table(df: DataFrame, path: str, *partitions: str) -> None:
    """Append rows; Spark's commit protocol takes the place of a lock file."""
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def snapshot_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and modification time of each file, as columns that joins keep."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("snapshot_sha256"), "modificationTime")


def finite(df: DataFrame, *columns: str) -> DataFrame:
    """The rows whose columns are all finite numbers."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")))
    return df


def complete_times(df: DataFrame, *columns: str) -> DataFrame:
    """The rows at times at which no asset lacks one of the columns."""
    lacking = None
    for c in columns:
        one = F.col(c).isNull()
        lacking = one if lacking is None else lacking | one
    times = df.groupBy("time").agg(F.max(lacking).alias("lacking")).where("not lacking").select("time")
    return df.join(times, "time", "left_semi")


#: Formats that dates in files come in, in the order they are tried.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm", "yyyyMMdd")


def parsed_time(column: str) -> Column:
    """A time from text in any of :data:`TIME_FORMATS`; null if none fits."""
    return F.coalesce(*(F.try_to_timestamp(F.col(column), F.lit(f)) for f in TIME_FORMATS))
