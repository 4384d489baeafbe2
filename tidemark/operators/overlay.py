"""A base table with a log of operations over it.

A log has the columns (seq, op, k, v); op is INS, UPD or DEL, and UPD and DEL
name keys that are there.  The overlay is written as an anti join and a union,
through which Catalyst pushes a filter on the key into both branches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lookup import hits


def net_effect(ops: DataFrame) -> DataFrame:
    """What the log leaves of each key: (k, v, deleted), from its last operation; no sort, one aggregate."""
    last = ops.groupBy("k").agg(F.max_by(F.struct("op", "v"), "seq").alias("last"))
    return last.select("k", F.when(F.col("last.op") != "DEL", F.col("last.v")).alias("v"), (F.col("last.op") == "DEL").alias("deleted"))


def overlay(base: DataFrame, delta: DataFrame) -> DataFrame:
    """The base with a net effect over it."""
    live = delta.where(~F.col("deleted")).select("k", "v")
    return base.join(delta.select("k"), "k", "left_anti").select("k", "v").unionByName(live)


def classified(base: DataFrame, ops: DataFrame) -> DataFrame:
    """The net effect by kind against the base: ins, upd, del; keys made and deleted within the log vanish."""
    delta = net_effect(ops).alias("d").join(hits(base, ops).select("k").alias("b"), F.col("d.k") == F.col("b.k"), "left")
    kind = F.when(F.col("deleted"), F.when(F.col("b.k").isNotNull(), "del")).when(F.col("b.k").isNotNull(), "upd").otherwise("ins")
    return delta.select(F.col("d.k").alias("k"), "v", kind.alias("kind")).where("kind is not null")


def violations(base: DataFrame, ops: DataFrame) -> DataFrame:
    """The keys that the log inserts where they are, at that point of the log."""
    before = F.lag("op").over(Window.partitionBy("o.k").orderBy("seq"))
    tagged = ops.alias("o").join(hits(base, ops.where("op = 'INS'")).select("k").alias("b"), F.col("o.k") == F.col("b.k"), "left")
    tagged = tagged.select("o.k", "op", before.alias("p"), F.col("b.k").isNotNull().alias("c"))
    taken = F.when(F.col("p").isNull(), F.col("c")).otherwise(F.col("p") != "DEL")
    return tagged.where((F.col("op") == "INS") & taken).select("k").distinct()


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two net effects as one; the second wins."""
    return old.join(new.select("k"), "k", "left_anti").select("k", "v", "deleted").unionByName(new)
