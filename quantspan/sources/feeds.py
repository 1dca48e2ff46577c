"""Loaders of slow feeds, panels and surfaces, with the checks that reject a misread file.

A check is an aggregate over the file; loaders raise :class:`FeedError` with the first offender in time.
Files are Parquet or CSV with a header, by their ending.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantspan.sources.bars import numbered

FUNDING_SECONDS = 28800


class FeedError(ValueError):
    """A feed that must not be used; ``time`` is that of the first offender, where there is one."""

    def __init__(self, message: str, time: int | None = None):
        super().__init__(message)
        self.time = time


def read_table(spark: SparkSession, path: str, needed: tuple[str, ...]) -> DataFrame:
    """A Parquet or CSV file that has the columns ``needed``; CSV columns are numbers."""
    ending = path.rstrip("/").rpartition(".")[2]
    if ending not in ("parquet", "csv"):
        raise FeedError(f"unsupported file ending: {ending}")
    df = spark.read.parquet(path) if ending == "parquet" else spark.read.option("header", True).csv(path)
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise FeedError(f"{path} lacks columns {missing}; it has {df.columns}")
    if ending == "csv":
        df = df.select(*(F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in df.columns))
    return df


def first_fault(df: DataFrame, faulty: Column, what: str) -> None:
    """Raise if a row is faulty, naming the first in time."""
    found = df.where(F.coalesce(faulty, F.lit(True))).agg(F.count("*").alias("n"), F.min("time").alias("time")).first()
    if found["n"]:
        raise FeedError(f"{found['n']} rows with {what}, the first at time {found['time']}", None if found["time"] is None else int(found["time"]))


def _bad(x: str) -> Column:
    return F.col(x).isNull() | F.isnan(x)


def whole_times(df: DataFrame) -> DataFrame:
    """``time`` as whole UNIX seconds; fractional or missing times are rejected."""
    first_fault(df, F.col("time").cast("double") % 1 != 0, "a time that is not whole seconds")
    return df.withColumn("time", F.col("time").cast("long"))


def load_funding(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``time, rate``: no missing rates, the last row of each time in file order, times on funding slots if ``strict``."""
    raw = read_table(spark, path, ("time", "rate")).withColumn("_place", F.monotonically_increasing_id())
    first_fault(raw, _bad("rate"), "no rate")
    rows = whole_times(raw).groupBy("time").agg(F.max_by("rate", "_place").alias("rate"), (F.count("*") - 1).alias("dropped"))
    if strict:
        first_fault(rows, F.col("time") % FUNDING_SECONDS != 0, f"a time off the {FUNDING_SECONDS} s slots")
    return rows


def load_open_interest(spark: SparkSession, path: str, cadence: int = 3600, tolerance: int = 60) -> DataFrame:
    """``time, open_interest`` (and in dollars, if there): steps within ``tolerance`` seconds of ``cadence``, none missing."""
    rows = whole_times(read_table(spark, path, ("time", "open_interest")))
    step = F.col("time") - F.lag("time").over(Window.orderBy("time"))  # one series; feeds of many assets are loaded by asset
    first_fault(rows.withColumn("step", step).where("step is not null"), F.abs(F.col("step") - cadence) > tolerance, f"a step other than {cadence} s")
    first_fault(rows, _bad("open_interest"), "no open interest")
    return rows


def load_basis(spark: SparkSession, path: str, tolerance: float = 0.01) -> DataFrame:
    """``time, close_spot, close_perp, basis_bp``: the basis is computed anew, one in the file must agree."""
    rows = whole_times(read_table(spark, path, ("time", "close_spot", "close_perp")))
    fresh = F.try_divide((F.col("close_perp") - F.col("close_spot")) * 1e4, "close_spot")
    if "basis_bp" in rows.columns:
        first_fault(rows.where(fresh.isNotNull() & ~_bad("basis_bp")), F.abs(F.col("basis_bp") - fresh) > tolerance, "a basis that is not that of its prices")
    return rows.withColumn("basis_bp", fresh)


def load_onchain(spark: SparkSession, path: str, metric: str = "nvt") -> DataFrame:
    """``time, value`` of one metric, and the file's digest and time as columns, which joins keep."""
    rows = whole_times(read_table(spark, path, ("time", metric)))
    files = spark.read.format("binaryFile").load(path if path.endswith(".csv") else f"{path}/*.parquet")
    pins = files.select(F.sha2("content", 256).alias("digest"), "modificationTime").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("digest")), ""), 256).alias("snapshot_sha256"), F.max("modificationTime").alias("snapshot_time"))
    return rows.select("time", F.col(metric).alias("value"), F.lit(metric).alias("metric")).join(F.broadcast(pins), F.lit(True))  # one row


def checked_panel(rows: DataFrame, has_volume: bool = True) -> DataFrame:
    """``rows``: asset, time (seconds), prices, volume -> bars at the times that all assets have.

    Rejected are fractional or repeated times, no common time, fewer than two, and a step other than the most
    common one. Without a volume in every file there is none.
    """
    rows = whole_times(rows)
    double = rows.groupBy("asset", "time").agg(F.count("*").alias("n")).where("n > 1").agg(F.min("time").alias("time"), F.count("*").alias("n")).first()
    if double["n"]:
        raise FeedError(f"{double['n']} repeated times, the first {double['time']}", double["time"])
    assets = rows.select(F.count_distinct("asset").alias("assets"))
    times = rows.groupBy("time").agg(F.count("*").alias("here")).join(F.broadcast(assets), F.col("here") == F.col("assets")).select("time")  # one row
    steps = times.withColumn("step", F.col("time") - F.lag("time").over(Window.orderBy("time")))  # the panel's one grid
    common = steps.where("step is not null").groupBy("step").agg(F.count("*").alias("n"), F.min("time").alias("first")).orderBy(F.desc("n"), "first").limit(1).collect()
    if not common:
        raise FeedError("the assets have fewer than two times in common")
    first_fault(steps.where("step is not null"), F.col("step") != common[0]["step"], f"a step other than {common[0]['step']} s")
    columns = ["open", "high", "low", "close", *(["volume"] if has_volume else [])]
    kept = rows.join(times, "time", "left_semi").select("asset", F.timestamp_seconds("time").cast("timestamp_ntz").alias("time"), *columns)
    return numbered(kept)


def load_panel(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Bars of one file an asset, checked as a panel."""
    if not paths:
        raise FeedError("no files")
    prices = ("time", "open", "high", "low", "close")
    tables = {a: read_table(spark, p, prices) for a, p in paths.items()}
    volume = all("volume" in t.columns for t in tables.values())
    rows = None
    for asset, table in tables.items():
        one = table.select(F.lit(asset).alias("asset"), *prices, *(["volume"] if volume else []))
        rows = one if rows is None else rows.unionByName(one)
    return checked_panel(rows, volume)


def csv_to_parquet(spark: SparkSession, source: str, target: str) -> None:
    """A CSV of bars as Parquet: ``time`` a long, the rest doubles."""
    rows = read_table(spark, source, ("time",))
    rows.withColumn("time", F.col("time").cast("long")).write.mode("overwrite").parquet(target)


def generated(spark: SparkSession, bars: int, seconds: int, start: int, seed: int, price: float = 100.0, drift: float = 2e-5, vol: float = 0.01) -> DataFrame:
    """Seeded random-walk bars: time, open, high, low, close. Numbers are drawn on the driver, in one stream, so that
    a seed gives the same bars everywhere; for large tables use many assets with seeds of their own."""
    rng = np.random.default_rng(seed)
    close = price * np.exp(np.cumsum(rng.normal(drift, vol, size=bars)))
    opened = np.concatenate([[price], close[:-1] * (1 + rng.normal(0.0, vol * 0.25, size=bars - 1))])
    above, below = (np.abs(rng.normal(0.0, vol * 0.8, size=bars)) for _ in range(2))
    high, low = np.maximum(opened, close) * (1 + above), np.minimum(opened, close) * (1 - below)
    times = start + np.arange(bars) * seconds
    rows = [(int(t), *map(float, x)) for t, *x in zip(times, opened, high, low, close, strict=True)]
    return spark.createDataFrame(rows, "time long, open double, high double, low double, close double")


def merged(tables: dict[str, DataFrame], on: str = "time") -> DataFrame:
    """Tables at the ``on`` that all have; a column of several gets its table's name behind it."""
    owners: dict[str, int] = {}
    for t in tables.values():
        for c in t.columns:
            owners[c] = owners.get(c, 0) + 1
    out = None
    for name, t in tables.items():
        one = t.select(on, *(F.col(c).alias(f"{c}_{name}" if owners[c] > 1 else c) for c in t.columns if c != on))
        out = one if out is None else out.join(one, on)
    return out


def load_surface(spark: SparkSession, path: str) -> DataFrame:
    """A written surface; what is no number is null, what has no regime has the empty one."""
    raw = spark.read.parquet(path) if not path.endswith(".csv") else spark.read.option("header", True).csv(path)
    numbers = ("roi", "pf", "sharpe", "mdd", "sl")
    columns = [F.expr(f"try_cast(`{c}` AS double)").alias(c) if c in numbers else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in ("window_idx", "regime") else F.col(c) for c in raw.columns]
    return raw.select(*columns)


def out_of_sample_pick(trades: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Of the trades whose sample starts with OOS: how many, what they made, profit factor and share of winners."""
    out = trades.where(F.col("sample").startswith("OOS"))
    won, lost = F.coalesce(F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), F.lit(0.0)), F.coalesce(-F.sum(F.when(F.col("pnl") < 0, F.col("pnl"))), F.lit(0.0))
    return out.groupBy(*keys).agg(F.count("*").alias("oos_trades"), F.sum("pnl").alias("oos_total_pnl"), F.when(lost > 0, won / lost).otherwise(F.lit(float("inf"))).alias("oos_pf"), F.avg((F.col("pnl") > 0).cast("double")).alias("oos_win_rate"))


def printed(runs: DataFrame, tag: Column, account: float = 100_000.0, risks: bool = False) -> DataFrame:
    """``line``: a run's metrics as one line of text, in dollars or in risks."""
    c = F.col
    note = F.coalesce(F.concat(F.lit("(LB "), c("lb").cast("string"), F.lit(") ")), F.lit(""))
    reward = F.coalesce(F.concat(F.lit("  RRR:"), c("rrr").cast("string")), F.lit(""))
    money = lambda x: F.concat(F.lit("$"), F.format_number(c(x) * account, 2)) if not risks else F.concat(F.format_string("%7.2f", c(x)), F.lit("R"))
    parts = [F.lpad(tag, 8, " "), F.lit(" "), note, F.format_string("| Trades:%4d  ROI:", c("trades").cast("long")), money("roi"), F.format_string("  PF:%6.2f  Shp:%6.2f  Win:%6.2f%%  Exp:", c("pf"), c("sharpe"), c("win_rate") * 100), money("exp"), F.lit("  MaxDD:"), money("max_drawdown"), reward]
    return runs.withColumn("line", F.concat(*parts))
