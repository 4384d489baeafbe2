"""The schema of a keyed table, checked on the way in."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..errors import NullValue

KV = StructType([StructField("k", LongType()), StructField("v", LongType())])
OPS = "seq long, op string, k long, v long"
_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def local(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a relation of known size, which Spark may broadcast; no Python worker reads them."""
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return spark.createDataFrame(pa.table([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields]))


def kv(df: DataFrame, key: str, value: str | Column | None = None) -> DataFrame:
    """Any integer columns as (k, v); a table of keys alone has the value 0."""
    v = F.lit(0) if value is None else F.col(value) if isinstance(value, str) else value
    return df.select(F.col(key).cast("long").alias("k"), v.cast("long").alias("v"))


def unsigned32(value: str | Column) -> Column:
    """The low 32 bits as a number from 0, for stores that keep no more."""
    return F.col(value).bitwiseAND(F.lit(0xFFFFFFFF)) if isinstance(value, str) else value.bitwiseAND(F.lit(0xFFFFFFFF))


def refuse_nulls(df: DataFrame) -> None:
    """Raise if a key or value is null; no null is ever stored as 0."""
    if not df.where("k is null or v is null").isEmpty():
        raise NullValue("null key or value")
