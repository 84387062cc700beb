"""All registered queries of the library proper."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from causaltape.plans import catalogue, conditions, gates, market, reports, statistics, streams

MODULES = (market, statistics, reports, gates, catalogue, conditions, streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the latest purchase known at each click relates to it, and how often there is none."""
    from pyspark.sql import functions as F

    known = market.j1_asof_latest(spark, sf_dir)
    return known.groupBy("instrument").agg(F.count("*").alias("anchors"), F.count_if(F.col("ctx_seq").isNull()).alias("missing_context"), F.round(F.avg("lag_ns") / 1e9, 3).alias("mean_lag_s"))
