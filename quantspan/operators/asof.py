"""As-of joins: the latest row of a feed at or before each time, by one union and one window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, values: list[str], on: str = "time", keys: tuple[str, ...] = ("asset",), prefix: str = "") -> DataFrame:
    """``left`` with ``values`` of the last ``right`` row of its keys at or before ``on``; null before the first.

    At equal times the feed's row counts. Both sides are shuffled once on the keys; nothing is joined.
    """
    own = left.columns
    held = F.struct(*values).alias("_held")
    both = left.select(*keys, on, F.struct(*own).alias("_row"), F.lit(None).cast(right.select(held).schema[0].dataType).alias("_held"), F.lit(1).alias("_kind"))
    feed = right.select(*keys, on, F.lit(None).cast(left.select(F.struct(*own).alias("_row")).schema[0].dataType).alias("_row"), held, F.lit(0).alias("_kind"))
    order = Window.partitionBy(*keys).orderBy(on, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.unionByName(feed).withColumn("_held", F.last("_held", ignorenulls=True).over(order)).where("_kind = 1")
    return found.select("_row.*", *(F.col(f"_held.{v}").alias(prefix + v) for v in values))
