"""Ranks of all rows in a total order, without a single-partition window.

Rows are range-partitioned by the sort columns and sorted within partitions;
a row's place is its index in the partition plus the sizes of the partitions
before it.  The placed rows are checkpointed first, since another execution
may draw other range bounds.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed

_INDEX_BITS = 33
#: The offsets are broadcast up to so many rows, and joined by shuffle beyond.
BROADCAST_ROWS = 100_000


def ranked(df: DataFrame, order: list[Column], group: str | None = None, out: str = "rank", total: str = "total", rows: int | None = None) -> DataFrame:
    """Add ``out``, the row's 0-based rank in ``order`` (within ``group``, if given), and ``total``, the rows ranked with it.

    With ``group`` the rows are ordered by it first, so a group may lie in any
    number of partitions: one with a third of all rows is spread like any other
    rows.  So are rows that are equal in ``order``, as a number tells them
    apart; they get different ranks, and which gets which is free.  Null is a
    group of its own.  An empty frame stays empty.  ``rows`` is the number of
    rows, where that is known.
    """
    keys = ([F.col(group)] if group else []) + order + [F.col("__salt")]
    rows = df.count() if rows is None else rows
    placed = (
        df.withColumn("__salt", F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop("__salt")
        .withColumn("__at", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__at", _INDEX_BITS))
        .withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1)))
    )
    placed = checkpointed(placed, rows)
    by = ["__part"] + ([group] if group else [])
    met = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    every = Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))
    before = every.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = checkpointed(
        met.select(
            *by,
            (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__base"),
            F.sum("__n").over(every).alias("__total"),
        ),
        rows,
    )
    if sizes.count() <= BROADCAST_ROWS:
        sizes = F.broadcast(sizes)
    on = F.col("p.__part") == F.col("s.__part")
    if group:
        on = on & F.col(f"p.{group}").eqNullSafe(F.col(f"s.{group}"))
    joined = placed.alias("p").join(sizes.alias("s"), on)
    return joined.select(*[F.col(f"p.`{c}`") for c in df.columns], (F.col("__at") + F.col("__base")).alias(out), F.col("__total").alias(total))
