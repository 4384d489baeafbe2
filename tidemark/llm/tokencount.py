"""Token counts without tokens: a Viterbi search that carries the best score and its number of pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .unigram import UNIT, Vocabulary, worker_segmenter


def token_counts(df: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``n_tokens`` and ``token_score`` (log probability of the best segmentation) to the columns ``keep`` (default: all).

    Every whole text is searched, in one pass without a shuffle: an automaton
    finds all pieces, and a position keeps a score and a count, so memory holds
    one segment's positions and not the text's pieces.  A null or empty text
    has 0 tokens and score 0.  Repeated rows get the same values; a column with
    one of these names is replaced.
    """
    spark = df.sparkSession
    bound_batches(spark)
    added = ["n_tokens", "token_score"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in added]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + ["n_tokens long, token_score double"])
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_segmenter(shared)
        for batch in batches:
            found = model.count_all([t or "" for t in batch.column(len(keep)).to_pylist()])
            made = [pa.array([n for n, _ in found], pa.int64()), pa.array([s / UNIT for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(batch.columns[: len(keep)] + made, names=keep + added)

    return source.mapInArrow(run, schema)
