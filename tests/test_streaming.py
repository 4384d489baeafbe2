from pyspark.sql import functions as F

from tidemark.plans.catalogue import REQUESTS, log
from tidemark.sources.store import Store
from tidemark.streaming.requests import apply_batch, start


def state(store):
    return {r.k: r.v for r in store.snapshot().collect()}


def test_batches_apply_once(spark, folder):
    store = Store(spark, f"{folder}/t")
    store.upsert([(1, 5), (2, 6)])
    requests = log(spark, REQUESTS)
    assert apply_batch(store, requests, "q", 0, f"{folder}/answers")
    after, version = state(store), store.version
    assert after == {2: 21, 9000001: 5}
    assert not apply_batch(store, requests, "q", 0)
    assert store.version == version
    assert apply_batch(store, log(spark, ((0, "INSERT", 1, 1),)), "q", 1)
    assert state(store) == after | {1: 1}
    got = {r.seq: (r.status, r.out_v) for r in spark.read.parquet(f"{folder}/answers").collect()}
    assert [got[i] for i in range(10)] == [(0, 5), (0, None), (0, 10), (0, None), (1, None), (1, None), (0, None), (0, 5), (1, None), (1, None)]


def test_stream(spark, folder):
    store = Store(spark, f"{folder}/t")
    for i in range(3):
        spark.range(100).select(F.col("id").alias("seq"), F.lit("INSERT").alias("op"), (F.col("id") + 100 * i).alias("k"), F.lit(i).cast("long").alias("v")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema("seq long, op string, k long, v long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    for _ in range(2):  # the second run finds nothing new
        start(store, stream, f"{folder}/checkpoint", "three").awaitTermination()
        assert store.snapshot().count() == 300
        assert store.manifest()["batches"] == {"three": 2}
