"""The query catalogue: each query as a DataFrame plan, with the SQL that must give the same rows.

The keyed table is made of ``orders``: k is the order's key, v its price in cents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import OPS, kv, local
from ..operators import aggregates, batch, dml, lookup, overlay
from ..sources.column import ResidentColumn

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

KEYS = (1, 5, 7, 42, 100, 256, 500, 777, 999, 1024, 1333, 1499, 5, 123456789)
KV_SQL = "kv AS (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders)"
IN_SQL = f"({', '.join(map(str, KEYS))})"
#: A log: inserts, updates and deletes of one key after another, then of many.
LOG = ((0, "UPD", 1, 11), (1, "DEL", 2, None), (2, "INS", 2, 22), (3, "INS", 9000001, 1), (4, "UPD", 9000001, 2), (5, "INS", 9000002, 3), (6, "DEL", 9000002, None), (7, "DEL", 3, None), (8, "UPD", 1, 12))
#: A log with inserts of keys that are there: 4, at the start; 9000003, by then; 5 is free by then.
BAD_LOG = (*LOG, (9, "INS", 4, 1), (10, "INS", 9000003, 1), (11, "INS", 9000003, 2), (12, "DEL", 5, None), (13, "INS", 5, 1))
REQUESTS = ((0, "LOOKUP", 1, None), (1, "INSERT", 1, 10), (2, "LOOKUP", 1, None), (3, "DELETE", 1, None), (4, "LOOKUP", 1, None), (5, "DELETE", 1, None), (6, "UPDATE", 9000001, 5), (7, "LOOKUP", 9000001, None), (8, "LOOKUP", 9000002, None), (9, "DELETE", 9000002, None), (10, "UPDATE", 2, 20), (11, "INSERT", 2, 21))


def values(rows: tuple, columns: str) -> str:
    cells = lambda row: ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in row)
    return f"(SELECT CAST(a AS BIGINT) AS seq, b AS op, CAST(c AS BIGINT) AS k, CAST(d AS BIGINT) AS v FROM (VALUES {', '.join(f'({cells(r)})' for r in rows)}) AS t({columns}))"


LOG_SQL = f"ops AS {values(LOG, 'a, b, c, d')}"
LAST_SQL = "last AS (SELECT k, op, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM ops) AS x WHERE rn = 1)"
STATE_SQL = "SELECT k, v FROM kv WHERE k NOT IN (SELECT k FROM last) UNION ALL SELECT k, v FROM last WHERE op <> 'DEL'"


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", F.round(F.col("o_totalprice") * 100))


def log(spark: SparkSession, rows: tuple = LOG) -> DataFrame:
    return local(spark, rows, OPS)


def query(sql: str | None, *names: str):
    """Register a function of the keyed table under its name and others, with its SQL."""

    def add(f):
        for name in (f.__name__, *names):
            QUERIES[name] = lambda spark, sf_dir: f(spark, table(spark, sf_dir))
            if sql:
                SQL[name] = f"WITH {KV_SQL}{sql}" if sql.startswith(",") else f"WITH {KV_SQL} {sql}"
        return f

    return add


# reads


@query("SELECT k, v FROM kv WHERE k = 500")
def point_get(spark, t):
    return lookup.point_get(t, 500)


@query("SELECT k, v FROM kv WHERE k = 777")
def point_get_param(spark, t):
    return spark.sql("SELECT k, v FROM {t} WHERE k = :key", args={"key": 777}, t=t)


@query(f"SELECT k, v FROM kv WHERE k IN {IN_SQL}")
def multi_get_in(spark, t):
    return lookup.multi_get(t, KEYS)


@query(f"SELECT k, v FROM kv WHERE k IN {IN_SQL}")
def multi_get_any(spark, t):
    """An array constructor, as a statement spells it."""
    from ..sources.session import to_spark

    return spark.sql(to_spark(f"SELECT k, v FROM {{t}} WHERE k = ANY(ARRAY[{', '.join(map(str, KEYS))}])"), t=t)


@query(f"SELECT k, v FROM kv WHERE k IN {IN_SQL}")
def multi_get_param(spark, t):
    """An array that is bound to a prepared statement's parameter."""
    from ..sources.session import Prepared

    return Prepared("SELECT k, v FROM {t} WHERE k = ANY($1)").bind(spark, [f"ARRAY[{', '.join(map(str, KEYS))}]"], t=t)


@query(f"SELECT k, v FROM kv WHERE k IN {IN_SQL} AND k = 42")
def multi_get_conj(spark, t):
    return lookup.point_get(lookup.multi_get(t, KEYS), 42)


@query("SELECT count(v) AS n, CAST(sum(v) AS BIGINT) AS sum_v FROM kv WHERE k IN (SELECT * FROM range(0, 100000, 100))")
def multi_get_subquery(spark, t):
    return lookup.among(t, spark.range(0, 100000, 100)).agg(F.count("v").alias("n"), F.sum("v").alias("sum_v"))


@query("SELECT count(v) AS n, CAST(sum(v) AS BIGINT) AS sum_v FROM kv WHERE k IN (SELECT * FROM range(0, 30000, 3))")
def multi_get_long_list(spark, t):
    return lookup.multi_get(t, range(0, 30000, 3)).agg(F.count("v").alias("n"), F.sum("v").alias("sum_v"))


@query("SELECT k, v FROM kv WHERE false")
def multi_get_empty(spark, t):
    return lookup.multi_get(t, [None])


@query(", r AS (SELECT range AS req_id, (range * 37) % 20000 AS k FROM range(0, 1200)) SELECT r.req_id, r.k, kv.k IS NOT NULL AS found, coalesce(kv.v, 0) AS v FROM r LEFT JOIN kv ON r.k = kv.k")
def multi_get_found_flags(spark, t):
    return lookup.find_many(t, spark.range(0, 1200).select(F.col("id").alias("req_id"), ((F.col("id") * 37) % 20000).alias("k"))).fillna(0, ["v"])


@query(f"SELECT count(*) AS hits, CAST(sum(v) AS BIGINT) AS sum_v FROM kv WHERE k IN {IN_SQL}")
def multi_get_agg(spark, t):
    return aggregates.multi_get_sum(t, KEYS)


@query("SELECT k, v FROM kv WHERE k = 1 OR k = 2 OR v < 200000")
def filter_or(spark, t):
    return t.where("k = 1 or k = 2 or v < 200000")


@query("SELECT k, v FROM kv WHERE k % 7 = 0")
def filter_modulo(spark, t):
    return t.where("k % 7 = 0")


@query("SELECT k, v FROM kv WHERE k <= 1000")
def filter_key_range(spark, t):
    return t.where("k <= 1000")


@query("SELECT k, v FROM kv")
def full_scan(spark, t):
    return t


@query("SELECT k, CAST(0 AS BIGINT) AS v FROM kv")
def key_set_scan(spark, t):
    return kv(t.select("k"), "k")


@query("SELECT k, v & 4294967295 AS v FROM (SELECT k, v * 1000 - 5 AS v FROM kv)")
def unsigned_values(spark, t):
    from ..functions.schema import unsigned32

    return t.select("k", unsigned32(F.col("v") * 1000 - 5).alias("v"))


@query("SELECT k, v, CAST(floor((row_number() OVER (ORDER BY k) - 1) / 700) AS BIGINT) AS page FROM kv")
def snapshot_pages(spark, t):
    return lookup.pages(t, 700)


@query("SELECT k, v FROM kv ORDER BY k")
def order_by_key(spark, t):
    return t.orderBy("k")


@query("SELECT (SELECT v FROM kv WHERE k = 7) AS k7, (SELECT v FROM kv WHERE k = -1) AS missing")
def scalar_subquery(spark, t):
    return spark.sql("SELECT (SELECT v FROM {t} WHERE k = 7) AS k7, (SELECT v FROM {t} WHERE k = -1) AS missing", t=t)


# aggregates


@query("SELECT count(*) AS n FROM kv")
def agg_count(spark, t):
    return t.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, min(k) AS min_k, max(k) AS max_k, CAST(sum(v) AS BIGINT) AS sum_v FROM kv")
def agg_minmax(spark, t):
    return aggregates.summary(t)


@query("SELECT CAST(sum(v) AS BIGINT) AS sum_v FROM kv")
def agg_sum(spark, t):
    return t.agg(F.sum("v").alias("sum_v"))


@query("SELECT count(*) AS n FROM kv WHERE v < 10000000")
def count_lt(spark, t):
    return aggregates.count_below(t, 10_000_000)


@query("SELECT count(*) AS n, CAST(sum(range) AS BIGINT) AS sum_v, CAST(sum(CASE WHEN range < 500000 THEN 1 ELSE 0 END) AS BIGINT) AS below FROM range(1, 1000001)")
def resident_count(spark, t):
    column = ResidentColumn(spark)
    column.load(1_000_000)
    try:
        return local(spark, [(column.count(), column.sum(), column.count_below(500_000))], "n long, sum_v long, below long")
    finally:
        column.release()


@query(", a AS (SELECT k, CASE WHEN k % 7 = 0 THEN v + 1 ELSE v END AS v FROM kv), d AS ((SELECT *, 'left' AS side FROM (SELECT * FROM kv EXCEPT SELECT * FROM a)) UNION ALL (SELECT *, 'right' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM kv))) SELECT k, v, side FROM d")
def except_both(spark, t):
    return aggregates.differences(t, dml.update(t, F.col("k") % 7 == 0, F.col("v") + 1))


@query("SELECT CASE WHEN (SELECT count(*) FROM (SELECT * FROM kv EXCEPT SELECT k, v FROM kv WHERE k >= 0) AS d) = 0 THEN 'PASS' ELSE 'FAIL' END AS result")
def verdict_case(spark, t):
    left = aggregates.differences(t, t.where("k >= 0")).agg(F.count(F.lit(1)).alias("n"))
    return left.select(F.when(F.col("n") == 0, "PASS").otherwise("FAIL").alias("result"))


# writes as tables


@query("SELECT k, v FROM kv UNION ALL SELECT * FROM (VALUES (9000001, 11), (9000002, 22)) AS t(k, v)")
def insert_values(spark, t):
    return dml.insert(t, local(spark, [(9000001, 11), (9000002, 22)], "k long, v long"))


@query("SELECT k, v FROM kv UNION ALL SELECT range, range * 7 FROM range(1000000, 1100000)")
def bulk_insert_select(spark, t):
    return dml.insert(t, spark.range(1_000_000, 1_100_000).select(F.col("id").alias("k"), (F.col("id") * 7).alias("v")))


@query("SELECT k, CASE WHEN k = 500 THEN 42 ELSE v END AS v FROM kv")
def update_point(spark, t):
    return dml.update(t, F.col("k") == 500, F.lit(42).cast("long"))


@query("SELECT k, CASE WHEN k % 7 = 0 THEN v + 1 ELSE v END AS v FROM kv")
def update_bulk(spark, t):
    return dml.update(t, F.col("k") % 7 == 0, F.col("v") + 1)


@query("SELECT k, v FROM kv WHERE k <> 500")
def delete_key(spark, t):
    return dml.delete(t, F.col("k") == 500)


@query("SELECT k, v FROM kv WHERE k % 13 <> 0")
def delete_modulo(spark, t):
    return dml.delete(t, F.col("k") % 13 == 0)


@query(", n AS (SELECT range AS k, range * 3 AS v FROM range(0, 40000, 4)) SELECT k, v FROM kv WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT k, v FROM n")
def upsert(spark, t):
    return dml.upsert(t, spark.range(0, 40000, 4).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v")))


@query("SELECT CASE WHEN k = 1 THEN 9000001 ELSE k END AS k, v FROM kv")
def rename_free(spark, t):
    return dml.rename(t, F.col("k") == 1, F.lit(9000001).cast("long"))


@query("SELECT k + 1000000 AS k, v FROM kv")
def rename_disjoint(spark, t):
    return dml.rename(t, F.lit(True), F.col("k") + 1_000_000)


@query("SELECT DISTINCT n.k FROM (SELECT k + 10 AS k FROM kv WHERE k < 10) AS n JOIN kv ON n.k = kv.k AND kv.k >= 10")
def rename_conflict(spark, t):
    return dml.rename_conflicts(t, dml.renames(t, F.col("k") < 10, F.col("k") + 10))


@query("SELECT DISTINCT a.k + 1 AS k FROM kv AS a JOIN kv AS b ON a.k + 1 = b.k AND a.k < 10 AND b.k < 10")
def rename_overlap_detect(spark, t):
    return dml.rename_overlaps(dml.renames(t, F.col("k") < 10, F.col("k") + 1))


@query("SELECT k FROM kv WHERE k IN (500, 501)")
def pk_dup_existing(spark, t):
    return dml.existing(t, local(spark, [(500, 1), (501, 1), (-3, 1)], "k long, v long"))


@query("SELECT CAST(5000 AS BIGINT) AS k")
def pk_dup_in_batch(spark, t):
    return dml.duplicates(local(spark, [(5000, 1), (5000, 2), (6000, 1)], "k long, v long"))


# logs


@query(f", {LOG_SQL}, {LAST_SQL} SELECT k, CASE WHEN op <> 'DEL' THEN v ELSE 0 END AS v, op = 'DEL' AS deleted FROM last")
def net_effect(spark, t):
    return overlay.net_effect(log(spark)).fillna(0, ["v"])


@query(f", {LOG_SQL}, {LAST_SQL}, s AS ({STATE_SQL}) SELECT k, v FROM s WHERE k = 1")
def ryw_point(spark, t):
    return lookup.point_get(overlay.overlay(t, overlay.net_effect(log(spark))), 1)


@query(f", {LOG_SQL}, {LAST_SQL} {STATE_SQL}")
def ryw_scan(spark, t):
    return overlay.overlay(t, overlay.net_effect(log(spark)))


@query(f", {LOG_SQL}, {LAST_SQL} SELECT l.k, coalesce(l.v, 0) AS v, CASE WHEN op = 'DEL' THEN 'del' WHEN kv.k IS NOT NULL THEN 'upd' ELSE 'ins' END AS kind FROM (SELECT k, op, CASE WHEN op <> 'DEL' THEN v END AS v FROM last) AS l LEFT JOIN kv ON l.k = kv.k WHERE op <> 'DEL' OR kv.k IS NOT NULL")
def commit_classes(spark, t):
    return overlay.classified(t, log(spark)).fillna(0, ["v"])


@query(f", ops AS {values(BAD_LOG, 'a, b, c, d')}, tag AS (SELECT o.*, lag(op) OVER (PARTITION BY o.k ORDER BY seq) AS p, kv.k IS NOT NULL AS c FROM ops o LEFT JOIN kv ON o.k = kv.k) SELECT DISTINCT k FROM tag WHERE op = 'INS' AND CASE WHEN p IS NULL THEN c ELSE p <> 'DEL' END")
def pk_violations(spark, t):
    return overlay.violations(t, log(spark, BAD_LOG))


def _expected_batch() -> tuple[str, str]:
    """The requests' answers and the state that they leave, as SQL over the log and the table."""
    reqs = f"r AS {values(REQUESTS, 'a, b, c, d')}"
    prior = "(SELECT w.op || ':' || coalesce(CAST(w.v AS VARCHAR), '') FROM r AS w WHERE w.k = r.k AND w.seq < r.seq AND w.op <> 'LOOKUP' ORDER BY w.seq DESC LIMIT 1)"
    seen = f"s AS (SELECT r.seq, r.op, {prior} AS w, kv.k IS NOT NULL AS stored, kv.v AS old FROM r LEFT JOIN kv ON r.k = kv.k)"
    there = "CASE WHEN w IS NULL THEN stored ELSE w NOT LIKE 'DELETE%' END"
    answers = f", {reqs}, {seen} SELECT seq, CASE WHEN op IN ('INSERT', 'UPDATE') OR {there} THEN 0 ELSE 1 END AS status, CASE WHEN op = 'LOOKUP' AND {there} THEN CASE WHEN w IS NULL THEN old ELSE CAST(split_part(w, ':', 2) AS BIGINT) END ELSE 0 END AS out_v FROM s"
    state = f", {reqs}, ops AS (SELECT seq, CASE WHEN op = 'DELETE' THEN 'DEL' ELSE 'UPD' END AS op, k, v FROM r WHERE op <> 'LOOKUP'), {LAST_SQL} {STATE_SQL}"
    return answers, state


@query(_expected_batch()[0])
def mixed_batch(spark, t):
    return batch.answers(t, log(spark, REQUESTS)).fillna(0, ["out_v"])


@query(_expected_batch()[1])
def mixed_batch_state(spark, t):
    return overlay.overlay(t, batch.delta_of(log(spark, REQUESTS)))


# stored tables and streams


def _store(spark: SparkSession, t: DataFrame, unique: bool = True):
    from ..sources.scratch import scratch
    from ..sources.store import Store

    store = Store(spark, scratch(spark, "store"), unique=unique)
    with store.begin() as txn:
        txn.insert(t)
    return store


@query("SELECT k, v FROM kv")
def txn_rollback(spark, t):
    store = _store(spark, t)
    txn = store.begin()
    txn.update(F.col("k") % 2 == 0, F.col("v") + 1)
    txn.delete(F.col("k") == 1)
    txn.rollback()
    return store.snapshot()


@query("SELECT k, v FROM kv")
def atomic_fail(spark, t):
    from ..errors import UniqueViolation

    store = _store(spark, t)
    txn = store.begin()
    txn.delete(F.col("k") == 2)
    txn.insert([(3, 999)])
    try:
        txn.commit()
    except UniqueViolation:
        pass
    return store.snapshot()


@query("SELECT k, v FROM kv UNION ALL SELECT range, range FROM range(1000000, 1300001)")
def atomic_multichunk(spark, t):
    """Many rows in one commit; the SQL keeps them beside rows of the same keys, so the table has no unique key."""
    store = _store(spark, t, unique=False)
    with store.begin() as txn:
        txn.insert(spark.range(1_000_000, 1_300_001).select(F.col("id").alias("k"), F.col("id").alias("v")))
    return store.snapshot()


@query(f", {LOG_SQL}, {LAST_SQL} {STATE_SQL}")
def commit_apply(spark, t):
    """The log's net effect as a version of a stored table."""
    store = _store(spark, t)
    store.commit_delta(overlay.net_effect(log(spark)), store.version)
    return store.snapshot()


@query(f", {LOG_SQL}, {LAST_SQL} SELECT k, CASE WHEN op <> 'DEL' THEN v ELSE 0 END AS v, op = 'DEL' AS deleted FROM last")
def net_effect_of_log(spark, t):
    """The log that a transaction's statements write."""
    txn = _store(spark, t).begin()
    for _, op, k, v in LOG:
        if op == "INS":
            txn.insert([(k, v)])
        elif op == "UPD":
            txn.update(F.col("k") == k, F.lit(v))
        else:
            txn.delete(F.col("k") == k)
    return overlay.net_effect(txn.ops).fillna(0, ["v"])


@query("SELECT CASE WHEN k = 4 THEN 9000004 ELSE k END AS k, CASE WHEN k % 7 = 0 THEN v + 1 ELSE v END AS v FROM kv WHERE k % 13 <> 0 OR k = 0 UNION ALL SELECT 9000001, 5")
def txn_commit(spark, t):
    store = _store(spark, t)
    with store.begin() as txn:
        txn.update(F.col("k") % 7 == 0, F.col("v") + 1)
        txn.delete((F.col("k") % 13 == 0) & (F.col("k") > 0))
        txn.rename(F.col("k") == 4, F.lit(9000004))
        txn.insert([(9000001, 5)])
    return store.snapshot()


@query("SELECT k, CASE WHEN k = 1 THEN 100 ELSE v END AS v FROM kv")
def savepoint_rollback(spark, t):
    store = _store(spark, t)
    with store.begin() as txn:
        txn.update(F.col("k") == 1, F.lit(100))
        mark = txn.savepoint()
        txn.delete(F.col("k") < 500)
        txn.rollback_to(mark)
    return store.snapshot()


@query("SELECT CASE k WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE k END AS k, v FROM kv")
def rename_swap(spark, t):
    store = _store(spark, t)
    with store.begin(allow_overlap=True) as txn:
        txn.rename(F.col("k").isin(1, 2), 3 - F.col("k"))
    return store.snapshot()


@query(_expected_batch()[1])
def stream_ops(spark, t):
    from ..sources.scratch import scratch
    from ..streaming.requests import start

    store, folder = _store(spark, t), scratch(spark, "stream")
    requests = log(spark, REQUESTS).repartition(1).sortWithinPartitions("seq")
    requests.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(requests.schema).parquet(f"{folder}/in")
    start(store, stream, f"{folder}/checkpoint").awaitTermination()
    return store.snapshot()
