"""Checks that users run on their own operators: no look-ahead, grouping of legs, the trade audit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspan.functions.windows import w

PRICES = ("open", "high", "low", "close")
#: Operators that claim to be causal, by name: from bars to rows with asset and bar_idx.
CAUSAL: dict[str, Callable[[DataFrame], DataFrame]] = {}
_SPOILT = "\u0001spoilt"


def causal(name: str) -> Callable:
    """Register an operator whose rows must not depend on later bars."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable:
        CAUSAL[name] = f
        return f

    return add


def missing_after(bars: DataFrame, cut: int) -> DataFrame:
    """The bars without prices from ``cut`` on."""
    return bars.select(*(F.when(F.col("bar_idx") < cut, F.col(c)).alias(c) if c in PRICES else F.col(c) for c in bars.columns))


def changed_after(bars: DataFrame, cut: int) -> DataFrame:
    """The bars with other prices from ``cut`` on."""
    return bars.select(*(F.when(F.col("bar_idx") < cut, F.col(c)).otherwise(F.col(c) * 7 + 3).alias(c) if c in PRICES else F.col(c) for c in bars.columns))


def leaks(f: Callable[[DataFrame], DataFrame], bars: DataFrame, cut: int, spoil: Callable[[DataFrame, int], DataFrame] = changed_after) -> DataFrame:
    """Rows before ``cut`` that change when the bars from ``cut`` on do: ``asset, bar_idx``, none of a causal operator.

    Clean and spoilt bars are assets of one run, and compared by a full join.
    """
    both = bars.unionByName(spoil(bars, cut).withColumn("asset", F.concat("asset", F.lit(_SPOILT))))
    out = f(both).where(F.col("bar_idx") < cut)
    own = F.struct(*[c for c in out.columns if c not in ("asset", "bar_idx")])
    sides = out.select(F.regexp_replace("asset", _SPOILT, "").alias("asset"), "bar_idx", F.col("asset").endswith(_SPOILT).alias("spoilt"), own.alias("row"))
    clean, other = (sides.where(x).select("asset", "bar_idx", F.col("row").alias(n)) for x, n in ((~F.col("spoilt"), "clean"), (F.col("spoilt"), "other")))
    return clean.join(other, ["asset", "bar_idx"], "full").where(~F.col("clean").eqNullSafe(F.col("other"))).select("asset", "bar_idx")


def assert_no_lookahead(f: Callable[[DataFrame], DataFrame], bars: DataFrame, cut: int, spoil: Callable[[DataFrame, int], DataFrame] = changed_after) -> None:
    """Raise if a row before ``cut`` depends on a later bar."""
    found = leaks(f, bars, cut, spoil).agg(F.count("*").alias("n"), F.min("bar_idx").alias("first"), F.max("bar_idx").alias("last")).first()
    if found["n"]:
        raise AssertionError(f"{found['n']} rows before bar {cut} depend on later bars, from bar {found['first']} to {found['last']}")


def leg_groups(legs: DataFrame, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """``legs``: keys, any of leg_id and trade_group_id, and costs -> one row a trade with its legs in order.

    Legs without a group are trades of their own, in the order of ``entry_idx``; those without costs cost nothing.
    """
    rows = legs
    if "trade_group_id" not in rows.columns:
        rows = rows.withColumn("trade_group_id", (F.row_number().over(w(*keys, order="entry_idx")) - 1).cast("long"))
    if "leg_id" not in rows.columns:
        rows = rows.withColumn("leg_id", F.lit(0))
    for c in ("fee", "slippage", "funding"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(0.0))
    for c in ("gross_pnl", "net_pnl"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.col("pnl"))
    fields = ("leg_id", "side", "entry_idx", "exit_idx", "entry_price", "exit_price", "qty", "pnl", "fee", "slippage", "funding", "gross_pnl", "net_pnl")
    return rows.groupBy(*keys, "trade_group_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("legs"), F.count("*").alias("n_legs"), F.sum("net_pnl").alias("net_pnl"), F.min("entry_idx").alias("entry_idx"), F.max("exit_idx").alias("exit_idx"))


def trade_audit(trades: DataFrame, bars: DataFrame, indicators: tuple[str, ...], keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """The first, the last and the trades at the quarters of each run, with indicators as of the bar of entry."""
    n = trades.groupBy(*keys).agg((F.max("trade_group_id") + 1).alias("n"))
    picked = trades.join(n, list(keys)).where("n <= 5 or trade_group_id in (0, n div 4, n div 2, 3 * n div 4, n - 1)").drop("n")
    at = bars.select("asset", F.col("bar_idx").alias("entry_idx"), *(F.col(c).alias(f"{c}_at_entry") for c in indicators))
    return picked.join(at, ["asset", "entry_idx"])
