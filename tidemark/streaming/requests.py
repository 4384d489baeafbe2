"""Streams of requests (seq, op, k, v), applied to a store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.batch import answers, delta_of
from ..sources.store import Store


def apply_batch(store: Store, requests: DataFrame, name: str, number: int, answers_path: str | None = None) -> bool:
    """Apply one batch; False if the store has it already.

    The batch's number is part of the version that it makes, so a batch that
    comes again after a failure changes nothing.
    """
    version = store.version
    if store.manifest(version)["batches"].get(name, -1) >= number:
        return False
    if answers_path:
        answers(store.snapshot(version), requests).write.mode("overwrite").parquet(f"{answers_path}/batch={number}")
    store.commit_delta(delta_of(requests), version, (name, number))
    return True


def start(store: Store, requests: DataFrame, checkpoint: str, name: str = "requests", answers_path: str | None = None, **trigger) -> StreamingQuery:
    """Apply a stream until it is stopped, or what is there with ``availableNow=True``."""
    writer = requests.writeStream.queryName(name).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(lambda batch, number: apply_batch(store, batch, name, number, answers_path) and None).start()
