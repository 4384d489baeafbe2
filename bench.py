"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each is run REPEATS times, and the best counts.  Queries return rows to a sink
that drops them; those named ``stored_`` write to a stored table.  ``lookup_``
has a sweep of batch sizes, ``mixed_`` batches of lookups and writes.
"""

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.operators import batch, lookup
from tidemark.plans.catalogue import QUERIES, table
from tidemark.sources.scratch import scratch
from tidemark.sources.store import Store

REPEATS = 3
HEADLINE = [
    "point_get",
    "multi_get_in",
    "multi_get_agg",
    "multi_get_subquery",
    "multi_get_long_list",
    "multi_get_found_flags",
    "full_scan",
    "snapshot_pages",
    "agg_minmax",
    "count_lt",
    "resident_count",
    "except_both",
    "bulk_insert_select",
    "update_bulk",
    "delete_modulo",
    "upsert",
    "ryw_scan",
    "pk_violations",
    "mixed_batch",
    "txn_commit",
    "stream_ops",
]
BATCHES = (1, 512, 32_768, 1_048_576)


def drop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def stored(spark: SparkSession, t):
    """Writes of a stored table: (name, what to time, what makes it ready)."""

    def fresh():
        store = Store(spark, scratch(spark, "bench"))
        store.insert_many(t)
        return store

    def change(do):
        def run(store):
            with store.begin() as txn:
                do(txn)

        return run

    yield "stored_insert_select", change(lambda x: x.insert(spark.range(1_000_000_000, 1_000_100_000).select(F.col("id").alias("k"), (F.col("id") * 7).alias("v")))), fresh
    yield "stored_update_one", change(lambda x: x.update(F.col("k") == 500, F.lit(1))), fresh
    yield "stored_update_bulk", change(lambda x: x.update(F.col("k") % 7 == 0, F.col("v") + 1)), fresh
    yield "stored_delete_modulo", change(lambda x: x.delete(F.col("k") % 13 == 0)), fresh
    yield "stored_point_get", lambda store: store.get(500), fresh


def keys(spark: SparkSession, n: int, top: int, zipf: bool):
    """``n`` keys below ``top``: uniform, or by Zipf's law with exponent 1 (the inverse of a logarithm)."""
    u = F.abs(F.xxhash64("id") % 1_000_003) / 1_000_003.0
    k = F.floor(F.pow(F.lit(float(top)), u)) - 1 if zipf else F.floor(u * top)
    return spark.range(n).select(F.col("id").alias("seq"), F.col("id").alias("req_id"), k.cast("long").alias("k"))


def workloads(spark: SparkSession, t):
    top = t.agg(F.max("k")).first()[0] + 1
    for n in BATCHES:
        yield f"lookup_{n}", lambda n=n: drop(lookup.find_many(t, keys(spark, n, top, False)))
    for zipf in (False, True):
        for writes in (5, 50):
            op = F.when(F.col("seq") % 100 < writes, "UPDATE").otherwise("LOOKUP")
            requests = keys(spark, 100_000, top, zipf).select("seq", op.alias("op"), "k", F.col("seq").alias("v"))
            yield f"mixed_{'zipf' if zipf else 'uniform'}_{writes}", lambda r=requests: drop(batch.answers(t, r))


def best(run, ready=lambda: None) -> float:
    took = []
    for _ in range(REPEATS):
        state = ready()
        began = time.perf_counter()
        run(state) if state is not None else run()
        took.append(time.perf_counter() - began)
    return round(min(took), 4)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {name: best(lambda name=name: drop(QUERIES[name](spark, sf_dir))) for name in HEADLINE}
    t = table(spark, sf_dir)
    times |= {name: best(run, ready) for name, run, ready in stored(spark, t)}
    times |= {name: best(run) for name, run in workloads(spark, t)}
    print(json.dumps({"metric": f"total seconds of the headline queries, best of {REPEATS}", "value": round(sum(times[n] for n in HEADLINE), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
