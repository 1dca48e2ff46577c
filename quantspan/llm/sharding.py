"""Minimax contiguous sharding: the smallest shard capacity that lets ordered atomic groups be cut
into a given number of contiguous shards.

Documents with equal texts are one atomic group. Groups are ordered by their smallest id, and a group's
end offset is the sum of sizes up to it. The smallest feasible capacity is found by bisection; each
probe packs greedily, which needs only "the last group end at or before x". The driver answers that
from a skeleton of cells (smallest and largest group end in a range of offsets): a fixed number of
cells whatever the input, refined around the cuts until the answer is exact. Everything that is per
row stays in DataFrame operations.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace, columns_as

#: Cells held by the driver in each refinement.
CELLS = 4096


class Skeleton:
    """Sorted, disjoint cells ``(first end, last end)`` that cover all group ends."""

    def __init__(self, cells: list[tuple[int, int]]):
        self.cells = sorted(cells)
        self.starts = [c[0] for c in self.cells]

    def bounds(self, x: int) -> tuple[int, int]:
        """Between which offsets the last group end at or before ``x`` lies (0: none)."""
        k = bisect_right(self.starts, x) - 1
        if k < 0:
            return 0, 0
        first, last = self.cells[k]
        return (last, last) if x >= last else (first, x)

    def path(self, capacity: int, shards: int, upper: bool) -> list[int]:
        """Greedy cuts; each is the lower or upper bound of what the ends allow."""
        cuts, at = [], 0
        for _ in range(shards):
            at = max(at, self.bounds(at + capacity)[upper])
            cuts.append(at)
        return cuts

    def smallest(self, total: int, shards: int, upper: bool) -> int:
        """Smallest capacity at which the path reaches the end."""
        low, high = 0, total
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (low, middle) if self.path(middle, shards, upper)[-1] >= total else (middle, high)
        return high


def _refine(ends: DataFrame, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Cells of the ends in each of the ranges, at most CELLS in all and one more for each."""
    each = max(2, CELLS // len(ranges))
    which, cell, inside = F.lit(0), F.lit(0).cast("long"), F.lit(False)
    for k, (low, high) in enumerate(ranges):
        here = F.col("ends").between(low, high)
        step = max(1, -(-(high - low + 1) // each))
        inside = inside | here
        which = F.when(here, F.lit(k)).otherwise(which)
        cell = F.when(here, F.floor((F.col("ends") - F.lit(low)) / F.lit(float(step)))).otherwise(cell)
    rows = ends.where(inside).groupBy(which.alias("range"), cell.alias("cell")).agg(F.min("ends").alias("first"), F.max("ends").alias("last"))
    return [(r["first"], r["last"]) for r in rows.collect()]


def minimax_cuts(ends: DataFrame, total: int, shards: int) -> tuple[int, list[int]]:
    """``ends``: a column ``ends`` of distinct group end offsets, the largest being ``total``.

    Returns the smallest feasible capacity and the offsets at which shards end.
    """
    if total <= 0:
        return 0, [0] * shards
    skeleton = Skeleton(_refine(ends, [(0, total)]))
    while True:
        feasible, hopeless = skeleton.smallest(total, shards, False), skeleton.smallest(total, shards, True)
        if feasible == hopeless:
            cuts = skeleton.path(feasible, shards, False)
            if cuts == skeleton.path(feasible, shards, True):
                return feasible, cuts
        low, high = skeleton.path(hopeless, shards, False), skeleton.path(feasible, shards, True)
        touched = [c for c in skeleton.cells if c[0] < c[1] and any(a <= c[1] and b >= c[0] for a, b in zip(low, high, strict=True))]
        ranges = list(touched)
        while len(ranges) > 4 * shards:  # join the closest, so that each range keeps many cells
            k = min(range(len(ranges) - 1), key=lambda i: ranges[i + 1][0] - ranges[i][1])
            ranges[k : k + 2] = [(ranges[k][0], ranges[k + 1][1])]
        keep = [c for c in skeleton.cells if not any(a <= c[0] and c[1] <= b for a, b in ranges)]
        skeleton = Skeleton(keep + _refine(ends, ranges))


def minimax_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8) -> DataFrame:
    """Assign every row to one of ``shards`` contiguous shards under the law ``bytes``.

    Size is the UTF-8 length of the text plus 1. Rows with equal texts stay together; a null text is
    taken as an empty one, a null id sorts first, repeated rows are each placed, an empty table gives
    no rows, and columns other than id and text are not read. ``slot`` numbers the rows of a shard
    from 0 by id.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "sharding")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = columns_as(docs, doc_id=id_col, text=text_col).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"))
    rows = work.table(rows.repartitionByRange(parts, "doc_id", "key").withColumn("part", F.spark_partition_id()), "rows")

    groups = rows.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.sum("size").alias("bytes"))
    groups = groups.repartitionByRange(parts, "first_id", "key").withColumn("block", F.spark_partition_id())
    running = F.sum("bytes").over(Window.partitionBy("block").orderBy("first_id", "key").rowsBetween(Window.unboundedPreceding, 0))
    groups = work.table(groups.select("key", "block", "bytes", running.alias("running")), "groups")
    before, at = [], 0
    for r in groups.groupBy("block").agg(F.sum("bytes").alias("bytes")).orderBy("block").collect():  # a row for each partition
        before.append((r["block"], at))
        at += r["bytes"]
    offsets = spark.createDataFrame(before, "block int, before long")
    groups = groups.join(F.broadcast(offsets), "block").select("key", (F.col("before") + F.col("running")).alias("ends"))
    groups = work.table(groups, "ends")
    _, cuts = minimax_cuts(groups.select("ends"), at, shards)

    shard = F.lit(0)
    for cut in cuts[:-1]:
        shard = shard + (F.col("ends") > F.lit(cut)).cast("int")
    placed = work.table(rows.join(groups.select("key", shard.alias("shard")), "key").drop("key"), "placed")
    counts = placed.groupBy("shard", "part").count()  # at most shards x partitions rows
    counts = counts.select("shard", "part", (F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).alias("earlier"))
    in_part = F.row_number().over(Window.partitionBy("part", "shard").orderBy("doc_id", "text_crc32")) - 1
    return placed.withColumn("in_part", in_part).join(F.broadcast(counts), ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("earlier") + F.col("in_part")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
