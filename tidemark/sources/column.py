"""A resident column: loaded once, kept in memory, and aggregated."""

from __future__ import annotations

from time import perf_counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ResidentColumn:
    """One long column in executor memory; loading again replaces it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._rows: DataFrame | None = None
        #: Milliseconds that the last aggregate took.
        self.last_ms = 0.0

    def load(self, n: int) -> int:
        """The numbers 1 to n."""
        if n <= 0:
            raise ValueError("a column needs rows")
        return self.hold(self.spark.range(1, n + 1).select(F.col("id").alias("v")))

    def hold(self, rows: DataFrame) -> int:
        self.release()
        self._rows = rows.select(F.col(rows.columns[0]).cast("long").alias("v")).persist()
        return self._rows.count()

    def release(self) -> None:
        if self._rows is not None:
            self._rows.unpersist()
        self._rows = None

    @property
    def rows(self) -> DataFrame:
        if self._rows is None:
            raise RuntimeError("no column is loaded")
        return self._rows

    def _one(self, what):
        rows, began = self.rows, perf_counter()
        value = rows.agg(what).first()[0]
        self.last_ms = (perf_counter() - began) * 1000
        return value

    def count(self) -> int:
        return self._one(F.count(F.lit(1)))

    def sum(self) -> int | None:
        return self._one(F.sum("v"))

    def count_below(self, limit: int) -> int:
        return self._one(F.count_if(F.col("v") < limit))
