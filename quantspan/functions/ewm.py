"""Exponentially weighted means: a recursion over each asset's bars.

The recursion is the one thing that row windows cannot express; it runs once per asset and asks for many
means at a time, over columns that only depend on bars up to the current one.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Ewm:
    """``out``: name of the mean; ``adjust``: weights normalised over what there is, else seeded by the first."""

    out: str
    column: str
    alpha: float
    adjust: bool = False
    least: int = 0


def span(out: str, column: str, n: int) -> Ewm:
    return Ewm(out, column, 2.0 / (n + 1))


def with_ewm(df: DataFrame, means: list[Ewm], keys: tuple[str, ...] = ("asset",), order: str = "bar_idx") -> DataFrame:
    """``df`` with a column for each of the means; later ones may be over earlier ones."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(m.out, T.DoubleType()) for m in means)])

    def run(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values(order)
        for m in means:
            bars[m.out] = bars[m.column].ewm(alpha=m.alpha, adjust=m.adjust, min_periods=m.least).mean()
        return bars

    return df.groupBy(*keys).applyInPandas(run, schema)
