"""Windows over bars: per asset, in time order, bounded by preceding rows, so nothing looks ahead."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("asset",)


def w(*keys: str, order: str = "bar_idx") -> WindowSpec:
    return Window.partitionBy(*(keys or KEYS)).orderBy(order)


def last_rows(n: int, *keys: str, order: str = "bar_idx", excluding_current: bool = False) -> WindowSpec:
    """The last ``n`` rows, with or without the current one."""
    return w(*keys, order=order).rowsBetween(-n, -1) if excluding_current else w(*keys, order=order).rowsBetween(1 - n, 0)


def so_far(*keys: str, order: str = "bar_idx") -> WindowSpec:
    return w(*keys, order=order).rowsBetween(Window.unboundedPreceding, 0)


def lag(x: Column | str, k: int = 1, *keys: str) -> Column:
    return F.lag(x, k).over(w(*keys))


def rolling(agg, x: Column | str, n: int, *keys: str, excluding_current: bool = False) -> Column:
    """``agg(x)`` over the last ``n`` rows, null until all of them have a value."""
    rows = last_rows(n, *keys, excluding_current=excluding_current)
    return F.when(F.count(x).over(rows) == n, agg(x).over(rows))


def true(x: Column) -> Column:
    """Null is false, as a comparison with a missing value is."""
    return F.coalesce(x, F.lit(False))
