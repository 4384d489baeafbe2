"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch that goes to a Python worker: a text longer than that goes alone, so a worker's
#: memory is bounded by BATCH_BYTES or its longest document, whichever is more, a few times over.
BATCH_ROWS = 1024
BATCH_BYTES = 1 << 20
#: Rows of a narrow table in one file of a checkpoint.
FILE_ROWS = 100_000
#: Files of a checkpoint at least, where there are so many rows for each: tasks that may write at once.
FILES, SMALL_FILE_ROWS = 6, 10_000
#: Bytes of a row group that a task gathers before it writes them.
ROW_GROUP_BYTES = 16 << 20
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Small Arrow batches for the Python operators of this session, the same for all of them; workers import this package from where the driver has it."""
    path = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in path:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*filter(None, path), ROOT])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session (tests) may name none, and gets a temporary one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def checkpointed(df: DataFrame, most: int | None = None, file_rows: int = FILE_ROWS) -> DataFrame:
    """Cut the lineage through the shared folder; survives lost executors.

    ``most`` bounds the rows of ``df``, where that is known: the checkpoint then
    has no more files than rows need, as each one costs a task, two files and,
    on some file systems, two processes.
    """
    shared_dir(df.sparkSession)
    if most is not None:
        df = df.coalesce(max(min(FILES, -(-most // SMALL_FILE_ROWS)), -(-most // file_rows), 1))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tidemark-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a Parquet table in the shared folder and read it again; small row groups bound what a task holds."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of :func:`stored` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


# --- words of whole texts as 64-bit hashes ---------------------------------

_PIECE = 1 << 17
_MULTIPLIER = 0x9E3779B97F4A7C13 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply, three rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_MULTIPLIER, _PIECE)
_DOWN = _powers(pow(_MULTIPLIER, -1, 1 << 64), _PIECE)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column on end, and the n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(at):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+`` of the texts, in order, and the words of each text.

    A word's hash is a polynomial over a random value of each byte, taken from
    prefix sums of a piece of the buffer, so nothing is done word by word.
    """
    data, at = text_buffer(column)
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(at) - 1, np.int64)
    space = SPACE[data]
    begins = np.empty(n + 1, bool)
    begins[0] = True
    begins[1:n] = space[:-1]
    begins[n] = True
    begins[at[at < n]] = True
    ends = begins[1:].copy()
    ends[:-1] |= space[1:]
    starts = np.flatnonzero(begins[:n] & ~space)
    stops = np.flatnonzero(ends & ~space) + 1
    hashes = np.empty(len(starts), np.uint64)
    up, down = _UP, _DOWN
    done = 0
    while done < len(starts):
        base = starts[done]
        upto = max(done + 1, int(np.searchsorted(stops, base + _PIECE, "right")))
        size = int(stops[upto - 1] - base)
        if size > len(up):  # one word longer than a piece
            up, down = _powers(_MULTIPLIER, size), _powers(pow(_MULTIPLIER, -1, 1 << 64), size)
        piece = data[base : base + size]
        sums = np.empty(size + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE_VALUE[_LOWER[piece] if lower else piece] * up[:size], out=sums[1:])
        s, e = starts[done:upto] - base, stops[done:upto] - base
        hashes[done:upto] = (sums[e] - sums[s]) * down[s]
        done = upto
    owner = np.searchsorted(at, starts, "right") - 1
    # an empty text shares its offset with the next one; "right" picks the last, which holds the byte
    return mix(hashes), np.bincount(owner, minlength=len(at) - 1).astype(np.int64)
