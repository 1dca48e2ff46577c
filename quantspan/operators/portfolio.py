"""Cross-sections: sizing, neutralisation, caps and long-short baskets, over rows (time, asset, weight)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspan.functions.windows import lag


def at(*more: str) -> Window:
    return Window.partitionBy("time", *more)


def returns(bars: DataFrame) -> DataFrame:
    return bars.withColumn("ret", F.try_divide(F.col("close"), lag("close")) - 1)


def covariances(rets: DataFrame) -> DataFrame:
    """``a, b, cov`` of returns at common times, both orders and the diagonal."""
    x, y = (rets.where("ret is not null").select("time", F.col("asset").alias(k), F.col("ret").alias(f"ret_{k}")) for k in ("a", "b"))
    return x.join(y, "time").groupBy("a", "b").agg(F.covar_samp("ret_a", "ret_b").alias("cov"))


def betas(rets: DataFrame, market: str) -> DataFrame:
    m = rets.where(F.col("asset") == market).select("time", F.col("ret").alias("market_ret"))
    return rets.join(m, "time").where("ret is not null and market_ret is not null").groupBy("asset").agg((F.covar_samp("ret", "market_ret") / F.nullif(F.var_samp("market_ret"), F.lit(0.0))).alias("beta"), F.stddev_samp("ret").alias("vol"))


def risk_contributions(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """``weights``: asset, weight -> the share of variance that each asset adds."""
    own = weights.select(F.col("asset").alias("a"), F.col("weight").alias("wa"))
    other = weights.select(F.col("asset").alias("b"), F.col("weight").alias("wb"))
    return cov.join(own, "a").join(other, "b").groupBy(F.col("a").alias("asset")).agg(F.sum(F.col("wa") * F.col("cov") * F.col("wb")).alias("contribution"))


def equal_risk(cov: DataFrame, group: tuple[str, ...] = ("rebalance",)) -> DataFrame:
    """Weights with equal risk contributions: the minimum of w'Cw/2 - sum(ln w)/n, coordinate by coordinate."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        table = rows.pivot_table(index="a", columns="b", values="cov").sort_index()[sorted(rows["a"].unique())]
        c, n = table.to_numpy(), len(table)
        x = 1 / np.sqrt(np.diag(c))
        for _ in range(500):
            before = x.copy()
            for i in range(n):
                rest = c[i] @ x - c[i, i] * x[i]
                x[i] = (-rest + np.sqrt(rest * rest + 4 * c[i, i] / n)) / (2 * c[i, i])
            if np.abs(x - before).max() <= 1e-14 * np.abs(x).max():
                break
        return pd.DataFrame({**{g: rows[g].iloc[0] for g in group}, "asset": table.index, "weight": x / x.sum()})

    fields = ", ".join(f"{g} {cov.schema[g].dataType.simpleString()}" for g in group)
    return cov.groupBy(*group).applyInPandas(run, f"{fields}, asset string, weight double")


def dollar_neutral(weight: Column) -> Column:
    """Longs sum to a half and shorts to minus a half; null where a side is empty."""
    long, short = (F.sum(F.when(c, F.abs(weight))).over(at()) for c in (weight > 0, weight < 0))
    return F.when(long.isNull() | short.isNull(), None).when(weight > 0, weight * 0.5 / long).when(weight < 0, weight * 0.5 / short).otherwise(0.0)


def beta_neutral(weights: DataFrame) -> DataFrame:
    """``weights``: time, asset, weight, beta. The asset of largest beta takes what cancels the rest."""
    biggest = F.row_number().over(Window.partitionBy("time").orderBy(F.abs("beta").desc(), "asset"))
    rest = F.sum(F.when(F.col("place") == 1, 0.0).otherwise(F.col("weight") * F.col("beta"))).over(at())
    return weights.withColumn("place", biggest).withColumn("neutral", F.when(F.col("place") == 1, -F.try_divide(rest, F.col("beta"))).otherwise(F.col("weight"))).drop("place")


def sigma_neutral(weight: Column, vol: Column) -> Column:
    gross, total = F.sum(F.abs(weight)).over(at()), F.sum(F.lit(1.0) / vol).over(at())
    return F.signum(weight) / vol * gross / total


def capped(weights: DataFrame, cap: float) -> DataFrame:
    """``capped``: no weight above ``cap``; what is cut goes to those below in proportion, again and again until none is above.

    The end of those rounds in one step: the largest weights are at the cap and the rest grow by one factor, which
    running sums over the sizes in order tell. Without room the rest of the sum is lost.
    """
    size = F.abs("weight")
    down = Window.partitionBy("time").orderBy(F.desc("size"), "asset")
    rows = weights.withColumn("size", size).withColumn("place", F.row_number().over(down) - 1)
    total = F.sum("size").over(at())
    rest = F.sum("size").over(down.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("total", total).withColumn("factor", F.try_divide(F.col("total") - F.col("place") * cap, rest))
    rows = rows.withColumn("over", F.coalesce(F.col("size") * F.col("factor") > cap + 1e-12, F.lit(False)))
    first = F.min(F.when(~F.col("over"), F.struct("place", "factor"))).over(at())
    grown = F.when(F.col("place") < first["place"], F.lit(cap)).otherwise(F.least(F.col("size") * F.coalesce(first["factor"], F.lit(0.0)), F.lit(cap)))
    out = F.when(first.isNull(), F.lit(cap)).otherwise(grown)
    return rows.withColumn("capped", F.signum("weight") * out).select(*weights.columns, "capped")


def gross_capped(weight: Column, most: float) -> Column:
    gross = F.sum(F.abs(weight)).over(at())
    return F.when(gross > most, weight * most / gross).otherwise(weight)


def basket(alphas: DataFrame, longs: int, shorts: int) -> DataFrame:
    """Top and bottom assets by alpha at each time, dollar neutral; assets without one take no part."""
    up = F.row_number().over(Window.partitionBy("time").orderBy(F.desc_nulls_last("alpha"), F.desc("asset")))
    down = F.row_number().over(Window.partitionBy("time").orderBy(F.asc_nulls_last("alpha"), "asset"))
    ranked = alphas.withColumn("up", up).withColumn("down", down)
    raw = F.when(F.col("alpha").isNull(), 0.0).when(F.col("up") <= longs, 1.0).when(F.col("down") <= shorts, -1.0).otherwise(0.0)
    return ranked.withColumn("raw", raw).withColumn("weight", F.coalesce(dollar_neutral(F.col("raw")), F.lit(0.0))).drop("up", "down")


def sortino(ret: str, periods: float | None = None) -> Column:
    """Mean over the root of the mean squared loss, annualised by ``periods``; null with fewer than two returns or losses. An aggregate."""
    enough = (F.count(ret) >= 2) & (F.count_if(F.col(ret) < 0) >= 2)
    down = F.sqrt(F.avg(F.pow(F.least(ret, F.lit(0.0)), F.lit(2.0))))
    return F.when(enough, F.try_divide(F.avg(ret), F.nullif(down, F.lit(0.0)))) * (periods or 1.0) ** 0.5


def objective(ret: str, benchmark: str | None = None, turnover: Column | float = 0.0, weights: tuple[float, float, float] = (1.0, 0.5, 0.1), periods: float | None = None, terms: dict[str, tuple[float, Column]] | None = None) -> Column:
    """A score of returns, higher is better: the Sortino ratio less the size of the correlation with a benchmark and less
    turnover, by their weights, and any further aggregates in ``terms`` by theirs. An aggregate; minus infinity for
    fewer than two returns."""
    score = weights[0] * F.coalesce(sortino(ret, periods), F.lit(0.0))
    if benchmark is not None:
        moves = (F.stddev_pop(ret) > 0) & (F.stddev_pop(benchmark) > 0)
        score = score - weights[1] * F.when(moves, F.abs(F.coalesce(F.corr(ret, benchmark), F.lit(0.0)))).otherwise(0.0)
    score = score - weights[2] * (turnover if isinstance(turnover, Column) else F.lit(float(turnover)))
    for weight, term in (terms or {}).values():
        score = score + weight * term
    return F.when(F.count(ret) < 2, F.lit(float("-inf"))).otherwise(score)
