"""Writes as tables: each takes a table and returns what it becomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows)


def upsert(table: DataFrame, rows: DataFrame, order: str = "v") -> DataFrame:
    """New rows win over old ones of the same key; of new rows with one key, the one with the greatest ``order`` stays."""
    rows = rows.groupBy("k").agg(F.max_by("v", order).alias("v"))
    return table.join(rows.select("k"), "k", "left_anti").select("k", "v").unionByName(rows)


def update(table: DataFrame, where: Column, value: Column) -> DataFrame:
    return table.withColumn("v", F.when(where, value).otherwise(F.col("v")))


def delete(table: DataFrame, where: Column) -> DataFrame:
    """Rows for which the condition is null stay, as in SQL."""
    return table.where(~F.coalesce(where, F.lit(False)))


def rename(table: DataFrame, where: Column, key: Column) -> DataFrame:
    return table.withColumn("k", F.when(where, key).otherwise(F.col("k")))


def renames(table: DataFrame, where: Column, key: Column) -> DataFrame:
    """(old_k, new_k, v) of a statement that changes keys."""
    return table.where(where).select(F.col("k").alias("old_k"), key.cast("long").alias("new_k"), "v").where("old_k <> new_k")


def rename_overlaps(changes: DataFrame) -> DataFrame:
    """Keys that are both old and new in one statement: swaps and chains."""
    return changes.select(F.col("new_k").alias("k")).join(changes.select(F.col("old_k").alias("k")), "k", "left_semi").distinct()


def rename_conflicts(table: DataFrame, changes: DataFrame) -> DataFrame:
    """New keys that another row has, or that two rows would get."""
    stay = table.join(changes.select(F.col("old_k").alias("k")), "k", "left_anti")
    new = changes.select(F.col("new_k").alias("k"))
    return new.join(stay.select("k"), "k", "left_semi").union(duplicates(new)).distinct()


def duplicates(rows: DataFrame) -> DataFrame:
    """Keys that stand in the rows more than once."""
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")


def existing(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Keys of the rows that the table has."""
    return rows.select("k").join(table.select("k"), "k", "left_semi").distinct()
