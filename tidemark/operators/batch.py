"""Batches of mixed requests, in the order of their numbers.

A request is (seq, op, k, v) with op LOOKUP, INSERT, UPDATE or DELETE.  Insert
and update both write whatever is there; delete and lookup say whether the key
was there.  Requests for one key take effect in order of seq, so the answers
are the same in every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lookup import hits
from .overlay import net_effect


def log_of(requests: DataFrame) -> DataFrame:
    """The writes of a batch as a log for :mod:`overlay`."""
    op = F.when(F.col("op") == "DELETE", "DEL").otherwise("UPD")
    return requests.where(F.col("op").isin("INSERT", "UPDATE", "DELETE")).select("seq", op.alias("op"), "k", "v")


def answers(table: DataFrame, requests: DataFrame) -> DataFrame:
    """(seq, status, out_v) of each request: status 0 for done or found, 1 for not found; out_v for lookups that find.

    A request sees the table and the writes before it in the batch.  An unknown
    operation finds nothing.
    """
    earlier = Window.partitionBy("r.k").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    writes = F.when(F.col("op").isin("INSERT", "UPDATE", "DELETE"), F.struct("op", F.col("r.v").alias("v")))
    seen = requests.alias("r").join(hits(table, requests).alias("t"), F.col("r.k") == F.col("t.k"), "left")
    seen = seen.select("seq", "op", F.col("t.k").isNotNull().alias("stored"), F.col("t.v").alias("old"), F.last(writes, ignorenulls=True).over(earlier).alias("w"))
    there = F.when(F.col("w").isNull(), F.col("stored")).otherwise(F.col("w.op") != "DELETE")
    value = F.when(F.col("w").isNull(), F.col("old")).otherwise(F.col("w.v"))
    done = F.col("op").isin("INSERT", "UPDATE") | (F.col("op").isin("LOOKUP", "DELETE") & there)
    return seen.select("seq", F.when(done, 0).otherwise(1).alias("status"), F.when((F.col("op") == "LOOKUP") & there, value).alias("out_v"))


def delta_of(requests: DataFrame) -> DataFrame:
    """The net effect of a batch."""
    return net_effect(log_of(requests))
