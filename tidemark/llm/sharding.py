"""Shards that each match the corpus's mixture, by proportional stratified interleaving.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import ranked


def stratified_shards(df: DataFrame, key: str, stratum: str, n_shards: int, seed: int = 17) -> DataFrame:
    """Deal all rows of ``df`` into ``n_shards`` shards of the same mixture of ``stratum``.

    The rows of a stratum are ranked in a seeded random order; row r of n gets
    the fractional rank (2r + 1) / 2n; all rows are sorted by it and cut into
    equal runs.  A shard so gets each stratum's share to within a row or two,
    and shard sizes differ by one row at most (the law ``rows``).

    Adds ``shard`` (int) and ``slot`` (long, gapless from 0 within the shard);
    the other columns are kept, and one that is called shard or slot is
    replaced.  A null stratum is a stratum of its own, a null key a key like
    any other; repeated rows are dealt like distinct ones.  An empty table
    gives no rows; fewer rows than shards leave shards empty.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    columns = [c for c in df.columns if c not in ("shard", "slot")]
    shuffled = df.select(*[F.col(f"`{c}`") for c in columns], F.xxhash64(F.lit(seed), F.col(key)).alias("__h"))
    rows = df.count()
    within = ranked(shuffled, [F.col("__h"), F.col(key)], group=stratum, out="__r", total="__n", rows=rows)
    fraction = (2 * F.col("__r") + 1) / (2 * F.col("__n"))
    spread = within.select(*[F.col(f"`{c}`") for c in columns], "__h", fraction.alias("__f"))
    placed = ranked(spread, [F.col("__f"), F.col("__h"), F.col(key)], out="__pos", total="__all", rows=rows)
    cut = placed.withColumn("__shard", F.expr(f"(__pos * {n_shards}) div __all"))
    first = F.expr(f"(__shard * __all + {n_shards - 1}) div {n_shards}")
    return cut.select(*[F.col(f"`{c}`") for c in columns], F.col("__shard").cast("int").alias("shard"), (F.col("__pos") - first).alias("slot"))
