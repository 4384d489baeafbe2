"""Reads by key.  All are plain filters or joins, so filters and columns reach the scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.schema import local
from ..sources.scratch import scratch

#: Longer key lists go to the table as a join and not as literals.
LITERAL_KEYS = 1000
#: A row's place within its partition has so many bits in Spark's increasing ids.
_PLACE_BITS = 33


def point_get(table: DataFrame, key: int) -> DataFrame:
    return table.where(F.col("k") == F.lit(key).cast("long"))


def multi_get(table: DataFrame, keys: Iterable[int | None]) -> DataFrame:
    """The rows of the keys, each once however often it is asked for.

    Nulls are skipped, and without any key nothing is scanned.  There is no
    limit: a long list becomes a table and a semi join.
    """
    asked = sorted({int(k) for k in keys if k is not None})
    if not asked:
        return table.limit(0)
    if len(asked) <= LITERAL_KEYS:
        return table.where(F.col("k").isin(asked))
    return among(table, local(table.sparkSession, [(k,) for k in asked], "k long"))


def among(table: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key is in the one column of ``keys``; small lists are broadcast by their size."""
    return table.join(keys.toDF("k"), "k", "left_semi")


def hits(table: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of the keys ``k`` of ``asked``.

    The keys are the right side of a semi join, so Spark may broadcast them if
    they are small, and then the table is filtered where it lies.  What is to
    be kept of all requests is joined with these rows and not with the table.
    """
    return table.join(asked.select("k").distinct(), "k", "left_semi")


def find_many(table: DataFrame, requests: DataFrame) -> DataFrame:
    """One row for each request (req_id, k): whether the key was found, and its value.  Hits, misses and repeats stay."""
    hit = F.col("t.k").isNotNull()
    return requests.alias("r").join(hits(table, requests).alias("t"), F.col("r.k") == F.col("t.k"), "left").select("r.req_id", "r.k", hit.alias("found"), F.col("t.v").alias("v"))


def pages(table: DataFrame, rows: int) -> DataFrame:
    """Every row with its page of ``rows`` rows in order of the key.

    The rows are staged in a shared folder, sorted by ranges of keys, as many
    as there are shuffle partitions; a row's number is its place in its range
    and the sizes of the ranges before.  No task sorts more than a range.
    """
    placed = table.select("k", "v").repartitionByRange("k").sortWithinPartitions("k").withColumn("id", F.monotonically_increasing_id())
    staged = f"{scratch(table.sparkSession, 'pages')}"
    placed.write.parquet(staged)
    place = F.col("id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    spread = table.sparkSession.read.schema(placed.schema).parquet(staged).select("k", "v", F.shiftright("id", _PLACE_BITS).alias("part"), place.alias("at"))
    sizes = spread.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row a range
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return spread.join(F.broadcast(before), "part").select("k", "v", F.floor((F.col("base") + F.col("at")) / rows).alias("page"))
