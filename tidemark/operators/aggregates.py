"""Aggregates of a keyed table.  Sums raise when they leave 64 bits, and comparisons are signed."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookup import multi_get


def summary(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("min_k"), F.max("k").alias("max_k"), F.sum("v").alias("sum_v"))


def count_below(table: DataFrame, limit: int) -> DataFrame:
    return table.agg(F.count_if(F.col("v") < limit).alias("n"))


def multi_get_sum(table: DataFrame, keys: Iterable[int]) -> DataFrame:
    return multi_get(table, keys).agg(F.count(F.lit(1)).alias("hits"), F.sum("v").alias("sum_v"))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows that only one of the two has, with the side."""
    return left.subtract(right).withColumn("side", F.lit("left")).union(right.subtract(left).withColumn("side", F.lit("right")))
