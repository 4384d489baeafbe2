"""Connected components of a graph that lies in a DataFrame, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Up to so many edges, the nodes' minima are broadcast to the edges; beyond, both are shuffled.
BROADCAST_EDGES = 250_000


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """``node`` and ``root`` (the smallest node that it reaches) for each end of the edges ``a``, ``b``.

    Each round points the neighbours of every node at the smallest of them:
    first the larger ones (large star), then the smaller ones (small star).
    The edges never become more, and nothing is gathered by node but a minimum.
    Minima are stored before they meet the edges, so that a join in which one
    node has very many of them is one that Spark can split.  It ends when a
    round changes nothing; rounds are checkpointed.  Loops are ignored.
    ``most`` bounds the edges, where that is known.
    """
    seen = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), most)
    state = seen(now)
    while state.n:
        few = state.n <= BROADCAST_EDGES
        met = lambda least: F.broadcast(least) if few else checkpointed(least, 2 * state.n)  # noqa: B023, E731
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = met(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        if not few:
            down = checkpointed(down, state.n)
        least = met(down.groupBy("a").agg(F.min("b").alias("m")))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = checkpointed(small.where("a <> b").distinct(), state.n)
        before, state = state, seen(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
