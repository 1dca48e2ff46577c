"""Regime detectors beside the trend one, and signals blocked by regime and side. A detector is any function from
bars to bars with a column ``regime``; :func:`detector` registers one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspan.functions.windows import lag, rolling, true
from quantspan.operators.signals import regimes as trends
from quantspan.operators.strategies import in_sample

DETECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {"trend": trends}


def detector(name: str) -> Callable:
    def add(f: Callable[[DataFrame], DataFrame]) -> Callable:
        DETECTORS[name] = f
        return f

    return add


def _deviations(bars: DataFrame) -> DataFrame:
    """``sd``: the deviation of 50 changes up to the bar before; ``cut``: its median over 250 bars."""
    rows = bars.withColumn("ret", F.try_divide(F.col("close"), lag("close")) - 1)
    rows = rows.withColumn("sd_now", rolling(F.stddev_samp, "ret", 50)).withColumn("sd", lag("sd_now"))
    return rows.withColumn("cut", rolling(lambda x: F.percentile(x, 0.5), "sd", 250)).drop("sd_now")


@detector("volatility")
def volatility(bars: DataFrame) -> DataFrame:
    wild = true(F.col("sd") > F.col("cut"))
    return _deviations(bars).withColumn("regime", F.when(wild, "Volatile").otherwise("Calm")).drop("ret", "sd", "cut")


@detector("volatility_trend")
def volatility_trend(bars: DataFrame) -> DataFrame:
    rows = _deviations(bars).withColumn("rise", lag("close") - lag("close", 51))
    wild, up = true(F.col("sd") > F.col("cut")), true(F.col("rise") > 0)
    label = F.concat(F.when(wild, "Vol").otherwise("Calm"), F.when(up, "Up").otherwise("Down"))
    return rows.withColumn("regime", label).drop("ret", "sd", "cut", "rise")


@detector("quantiles")
def quantiles(bars: DataFrame) -> DataFrame:
    """Fifths of the last change over its deviation. The cuts are those of the whole series, so this detector
    looks ahead; it is for study and no default."""
    rows = _deviations(bars).withColumn("score", F.coalesce(F.try_divide(F.coalesce(lag("ret"), F.lit(0.0)), F.nullif("sd", F.lit(0.0))), F.lit(0.0)))
    edges = rows.groupBy("asset").agg(F.percentile("score", F.array(*(F.lit(k / 5) for k in range(6)))).alias("edges"))
    place = F.lit(0)
    for k in range(1, 5):
        place = place + (F.col("score") > F.col("edges")[k]).cast("int")
    apart = F.size(F.array_distinct("edges")) == 6
    label = F.concat(F.lit("R"), F.when(apart, place).otherwise(0).cast("string"))
    return rows.join(edges, "asset").withColumn("regime", label).drop("ret", "sd", "cut", "score", "edges")


@detector("clusters")
def clusters(bars: DataFrame, inside: int = 300, outside: int = 200) -> DataFrame:
    """Three k-means clusters of volatility, momentum and range, named by their volatility; fitted in sample."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = bars.withColumn("ret", F.try_divide(F.col("close"), lag("close")) - 1).withColumn("size", F.abs("ret")).withColumn("spread", F.col("high") - F.col("low"))
    now = {"vol_50": rolling(F.stddev_samp, "ret", 50), "vol_200": rolling(F.stddev_samp, "ret", 200), "mom_50": rolling(F.sum, "ret", 50), "abs_50": rolling(F.avg, "size", 50), "range_50": F.try_divide(rolling(F.avg, "spread", 50), F.col("close"))}
    rows = rows.select("*", *(v.alias(f"now_{k}") for k, v in now.items()))
    rows = in_sample(rows.select("*", *(lag(f"now_{k}").alias(k) for k in now)).drop(*(f"now_{k}" for k in now)), inside, outside)
    stages = [VectorAssembler(inputCols=list(now), outputCol="assembled"), StandardScaler(inputCol="assembled", outputCol="features", withMean=True), KMeans(k=3, seed=42, predictionCol="cluster")]
    model = Pipeline(stages=stages).fit(rows.where("fitted").dropna(subset=list(now)))
    order = sorted(range(3), key=lambda k: model.stages[-1].clusterCenters()[k][0])
    names = F.create_map(*(F.lit(x) for k, name in zip(order, ("Calm", "Trending", "Choppy"), strict=True) for x in (k, name)))
    found = model.transform(rows.fillna(0.0, subset=list(now)))
    return found.withColumn("regime", F.element_at(names, F.col("cluster"))).select(*bars.columns, "regime")


def filtered(signals: DataFrame, blocked: DataFrame, labels: tuple[str, ...] = ("Uptrend", "Downtrend", "Ranging")) -> DataFrame:
    """``kept``: the raw signal, 0 where its regime and side are blocked. ``raw`` stays, so that exits still see it.

    ``blocked``: regime, side (long or short); a null stands for any. It is spread over labels and sides, so
    the join is on equal keys, and it has at most two rows a label.
    """
    sides = F.when(F.col("side").isNull(), F.array(F.lit("long"), F.lit("short"))).otherwise(F.array("side"))
    every = F.when(F.col("regime").isNull(), F.array(*map(F.lit, labels))).otherwise(F.array("regime"))
    keys = blocked.select(F.explode(every).alias("regime"), sides.alias("sides")).select("regime", F.explode("sides").alias("side")).distinct().withColumn("gone", F.lit(True))
    side = F.when(F.col("raw") == 1, "long").when(F.col("raw") == -1, "short")
    joined = signals.withColumn("side", side).join(F.broadcast(keys), ["regime", "side"], "left")  # two rows a label
    return joined.withColumn("kept", F.when(F.col("gone"), 0).otherwise(F.col("raw"))).drop("side", "gone")
