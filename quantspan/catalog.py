"""Every query of the engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantspan.plans import bars, engine, research, search, strategies

PLANS = [bars, research, search, strategies, engine]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the EMA-cross trades of each asset."""
    return bars.QUERIES["a1_metrics"](spark, sf_dir)


def queries() -> dict:
    return {k: v for p in PLANS for k, v in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for p in PLANS for k, v in p.SQL.items()}
