"""Transactions on stored tables: the rules, one by one, and against a dict."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.errors import NullValue, RepeatedKeys, UniqueViolation, UnsupportedRename, WriteConflict
from tidemark.sources.column import ResidentColumn
from tidemark.sources.store import Store


def K():
    return F.col("k")


def rows(df):
    return sorted((r.k, r.v) for r in df.collect())


@pytest.fixture
def store(spark, folder):
    return Store(spark, folder)


def fill(store, pairs):
    with store.begin() as txn:
        txn.insert(pairs)
    return store


def sevens(spark, a, b, by=7):
    return spark.range(a, b + 1).select(F.col("id").alias("k"), (F.col("id") * by).alias("v"))


def test_differential(spark, store):
    fill(store, sevens(spark, 1, 100_000))
    with store.begin() as txn:
        txn.update(K() % 7 == 0, F.col("v") + 1)
    with store.begin() as txn:
        txn.delete(K() % 13 == 0)
    heap = sevens(spark, 1, 100_000).select("k", F.expr("if(k % 7 = 0, v + 1, v)").alias("v")).where("k % 13 <> 0")
    got = store.snapshot()
    assert got.subtract(heap).isEmpty() and heap.subtract(got).isEmpty()
    assert got.count() == heap.count()
    assert (store.get(7), store.get(13), store.get(100)) == (50, None, 700)


def test_rollback_commit_and_own_writes(store):
    txn = store.begin()
    txn.insert([(1, 10), (2, 20)])
    assert txn.scan().count() == 2
    txn.rollback()
    assert store.snapshot().count() == 0
    with store.begin() as txn:
        txn.insert([(1, 10), (2, 20), (3, 30)])
        assert txn.get(2) == 20
    assert store.snapshot().count() == 3
    txn = store.begin()
    txn.update(K() == 1, F.lit(999))
    assert txn.get(1) == 999
    txn.delete(K() == 2)
    assert txn.scan().count() == 2
    txn.rollback()
    assert store.get(1) == 10 and store.snapshot().count() == 3
    txn = store.begin()
    txn.insert([(1, 111)])  # against committed rows: at commit
    with pytest.raises(UniqueViolation) as e:
        txn.commit()
    assert e.value.keys == [1] and store.get(1) == 10


def test_unique_keys(spark, store):
    fill(store, sevens(spark, 1, 1000))
    with pytest.raises(UniqueViolation):
        fill(store, [(500, 999)])
    with pytest.raises(UniqueViolation):
        fill(store, [(5000, 1), (5000, 2)])
    fill(store, [(2000, 11), (2001, 22)])
    assert store.snapshot().count() == 1002
    with store.begin() as txn:
        txn.update(K() == 500, F.lit(42))
    assert store.get(500) == 42
    fill(store, [(3000, 33)])
    assert store.snapshot().count() == 1003


def test_all_or_nothing(spark, store):
    fill(store, sevens(spark, 1, 5))
    txn = store.begin()
    txn.delete(K() == 2)
    txn.insert([(3, 999)])
    with pytest.raises(UniqueViolation):
        txn.commit()
    assert store.get(2) == 14 and store.snapshot().count() == 5
    many = sevens(spark, 1000, 301_000, 1)
    txn = store.begin()
    txn.insert(many)
    txn.insert([(4, 123)])
    with pytest.raises(UniqueViolation):
        txn.commit()
    assert store.snapshot().count() == 5
    fill(store, many)
    assert store.snapshot().count() == 300_006


def test_without_a_unique_key(spark, folder):
    """All rows stay, whichever way they lie: as a base, as a net effect, as a new base."""
    store = fill(Store(spark, folder, unique=False), [(n, 0) for n in range(100)] + [(5, 0), (5, 7)])
    want = [(n, 0) for n in range(100)] + [(5, 0), (5, 7)]
    for more in ([(5, 0), (5, 1)], [(5, 1)], [(n, 1) for n in range(50)] * 2):
        mark = store.version
        with store.begin() as txn:
            txn.insert(more)
            txn.insert(more[:1])
            kept = txn.savepoint()
            txn.insert([(8, 8)])
            txn.rollback_to(kept)
            assert rows(txn.scan()) == sorted(want + more + more[:1])
        assert rows(store.snapshot(mark)) == sorted(want)
        want += more + more[:1]
        assert rows(store.snapshot()) == sorted(want)
        assert rows(store.get_many([5])) == sorted(r for r in want if r[0] == 5)
    assert sorted((r.k, r.v) for page in store.pages(30) for r in page) == sorted(want)
    txn = store.begin()
    txn.insert([(1, 1)])
    with pytest.raises(NullValue):
        txn.insert([(None, 1)])
    txn.rollback()
    again = Store(spark, folder)  # as it was made
    assert not again.unique and rows(again.snapshot()) == sorted(want)
    a, b = again.begin(), again.begin()
    for txn in (a, b):
        txn.insert([(1, 1)])
    a.commit()
    with pytest.raises(WriteConflict):
        b.commit()
    txn = again.begin()
    for refused in (lambda: again.put(1, 2), lambda: again.remove(1), lambda: again.get(1), lambda: txn.get(1), lambda: txn.update(K() == 1, F.lit(2)), lambda: txn.delete(K() == 1), lambda: txn.rename(K() == 1, F.lit(2)), lambda: again.find_many(again.snapshot())):
        with pytest.raises(RepeatedKeys):
            refused()
    txn.rollback()
    assert rows(again.snapshot()) == sorted([*want, (1, 1)])
    other = Store(spark, folder + "/other")
    assert other.unique
    with pytest.raises(ValueError):
        other.commit_rows(again.snapshot(), other.version)


def test_key_updates(store):
    fill(store, [(1, 10), (2, 20)])
    with pytest.raises(UniqueViolation), store.begin() as txn:
        txn.rename(K() == 1, F.lit(2))
    assert rows(store.snapshot()) == [(1, 10), (2, 20)]
    with store.begin() as txn:
        txn.delete(K() == 1)
        txn.insert([(1, 99)])
    assert rows(store.snapshot()) == [(1, 99), (2, 20)]
    with store.begin() as txn:
        txn.rename(K() == 2, F.lit(3))
    assert rows(store.snapshot()) == [(1, 99), (3, 20)]


def test_swaps_and_chains(store):
    fill(store, [(1, 10), (2, 20)])
    for key in (3 - K(), K() + 1):
        with pytest.raises(UnsupportedRename), store.begin() as txn:
            txn.rename(K().isin(1, 2), key)
        assert rows(store.snapshot()) == [(1, 10), (2, 20)]
    with store.begin() as txn:
        txn.rename(K().isin(1, 2), K() + 100)
    assert rows(store.snapshot()) == [(101, 10), (102, 20)]
    with store.begin(allow_overlap=True) as txn:
        txn.rename(K() > 0, K() + 1)
    assert rows(store.snapshot()) == [(102, 10), (103, 20)]


def test_overlap_is_judged_by_statement(store):
    fill(store, [(1, 10), (2, 20)])
    with store.begin() as txn:
        txn.rename(K() == 1, F.lit(3))
        txn.rename(K() == 2, F.lit(1))
    assert rows(store.snapshot()) == [(1, 20), (3, 10)]


def test_pages(spark, store):
    fill(store, sevens(spark, 1, 300_000, 3))
    pinned = store.version
    with store.begin() as txn:
        txn.delete(K() > 10)
    n = total = 0
    for page in store.pages(65_536, pinned):
        n, total = n + len(page), total + sum(r.v for r in page)
    assert (n, total) == (300_000, 135_000_450_000)
    paged = store.paged(70_000, pinned).groupBy("page").count().orderBy("page").collect()
    assert [r["count"] for r in paged] == [70_000] * 4 + [20_000]


def test_same_transaction_sequences(store):
    fill(store, [(1, 10)])
    with store.begin() as txn:  # delete, insert, delete: the row goes
        txn.delete(K() == 1)
        txn.insert([(1, 11)])
        txn.delete(K() == 1)
    assert rows(store.snapshot()) == []
    fill(store, [(1, 10)])
    txn = store.begin()  # insert, delete, insert over a committed key
    txn.insert([(1, 11)])
    txn.delete(K() == 1)
    txn.insert([(1, 12)])
    with pytest.raises(UniqueViolation):
        txn.commit()
    txn = store.begin()
    txn.insert([(2, 1)])
    with pytest.raises(UniqueViolation):
        txn.insert([(2, 2)])
    txn.update(K() == 2, F.lit(5))
    txn.commit()
    assert store.get(2) == 5
    txn = store.begin()  # an insert that is then updated is still checked
    txn.insert([(2, 7)])
    txn.update(K() == 2, F.lit(8))
    with pytest.raises(UniqueViolation):
        txn.commit()


def test_savepoint(store):
    fill(store, [(1, 10), (2, 20)])
    with store.begin() as txn:
        txn.update(K() == 1, F.lit(11))
        mark = txn.savepoint()
        txn.delete(K() == 2)
        assert txn.scan().count() == 1
        txn.rollback_to(mark)
    assert rows(store.snapshot()) == [(1, 11), (2, 20)]


def test_conflict(store):
    a, b = store.begin(), store.begin()
    a.insert([(1, 1)])
    b.insert([(2, 2)])
    a.commit()
    with pytest.raises(WriteConflict):
        b.commit()
    assert rows(store.snapshot()) == [(1, 1)]
    with pytest.raises(RuntimeError):
        b.scan()


def test_values(spark, store, folder):
    big = [(-5, -1), (0, (1 << 32) - 1), (7, 1 << 40), (-(1 << 63), (1 << 63) - 1)]
    fill(store, big)
    assert rows(store.snapshot()) == sorted(big)
    narrow = fill(Store(spark, f"{folder}/narrow", u32_values=True), big)
    assert rows(narrow.snapshot()) == sorted((k, v & 0xFFFFFFFF) for k, v in big)
    for bad in ([(None, 1)], [(9, None)]):
        with pytest.raises(NullValue), store.begin() as txn:
            txn.insert(bad)
    assert rows(store.get_many([7, 7, None, 0])) == [(0, (1 << 32) - 1), (7, 1 << 40)]
    assert rows(store.get_many([None])) == []
    store.put(7, 8)
    store.remove(0)
    assert (store.get(7), store.get(0)) == (8, None)
    found = store.find_many(spark.createDataFrame([(0, 7), (1, 7), (2, 12)], "req_id long, k long"))
    assert sorted(map(tuple, found.collect())) == [(0, 7, True, 8), (1, 7, True, 8), (2, 12, False, None)]


def test_repeated_keys_in_one_batch(spark, store):
    store.upsert([(1, 10), (2, 5), (1, 20)])
    assert rows(store.snapshot()) == [(1, 20), (2, 5)]
    with pytest.raises(UniqueViolation):
        store.upsert(spark.createDataFrame([(1, 1), (1, 2)], "k long, v long"))
    store.upsert(spark.createDataFrame([(1, 9, 2), (1, 8, 3), (1, 7, 1)], "k long, v long, at long"), order="at")
    assert rows(store.snapshot()) == [(1, 8), (2, 5)]


def test_bulk_writes_and_vacuum(spark, store):
    store.insert_many(sevens(spark, 1, 2000))
    with pytest.raises(UniqueViolation):
        store.insert_many([(2001, 1), (5, 1)])
    assert store.snapshot().count() == 2000
    store.remove_many([1, 2, 99_999])
    store.remove_many(spark.range(3, 6))
    assert store.snapshot().count() == 1995 and store.get(6) == 42
    before, names = rows(store.snapshot()), store.folder.names("data")
    assert store.vacuum(keep=1) and store.versions() == [store.version]
    assert rows(store.snapshot()) == before and len(store.folder.names("data")) < len(names)


def test_a_point_get_reads_one_range(spark, store):
    """A version lies in ranges of keys, so statistics leave out all row groups but one."""
    fill(store, sevens(spark, 1, 200_000).repartition(8))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        fill(store, sevens(spark, 200_001, 400_000).repartition(8))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = store.snapshot().where("k = 123456")
    assert got.collect() == [(123_456, 7 * 123_456)]
    plan = got._jdf.queryExecution().executedPlan()
    scans = plan.collectLeaves()
    read = sum(scans.apply(i).metrics().apply("numOutputRows").value() for i in range(scans.size()))
    assert 0 < read <= 400_000 // 4 + 10_000


def test_tables_share_nothing(spark, folder):
    a, b = Store(spark, f"{folder}/a"), Store(spark, f"{folder}/b")
    fill(a, [(1, 1)])
    assert rows(b.snapshot()) == [] and rows(Store(spark, f"{folder}/a").snapshot()) == [(1, 1)]


def test_against_dict(spark, store):
    rng, model = random.Random(3), {}
    for _ in range(12):
        txn, state, failed = store.begin(), dict(model), False
        for _ in range(rng.randint(1, 3)):
            kind, k, m = rng.choice(("insert", "update", "delete", "rename")), rng.randint(0, 9), rng.randint(2, 4)
            try:
                if kind == "insert":
                    txn.insert([(k, m)])
                    if k in state:
                        failed = True
                    state[k] = m
                elif kind == "update":
                    txn.update(K() % m == 0, F.col("v") + k)
                    state = {a: v + k if a % m == 0 else v for a, v in state.items()}
                elif kind == "delete":
                    txn.delete(K() % m == 1)
                    state = {a: v for a, v in state.items() if a % m != 1}
                else:
                    txn.rename(K() == k, K() + 10 * m)
                    if k in state:
                        failed |= k + 10 * m in state
                        state[k + 10 * m] = state.pop(k)
            except UniqueViolation:
                failed = True
                break
        if failed:
            with pytest.raises(UniqueViolation):
                txn.commit()
                raise UniqueViolation("refused at the statement")
        else:
            txn.commit()
            model = state
        assert dict(rows(store.snapshot())) == model


def test_resident_column(spark):
    column = ResidentColumn(spark)
    with pytest.raises(RuntimeError):
        column.sum()
    with pytest.raises(ValueError):
        column.load(0)
    column.load(10)
    assert column.load(1000) == 1000
    assert (column.count(), column.sum(), column.count_below(10)) == (1000, 500_500, 9)
    assert column.last_ms > 0
    column.hold(spark.createDataFrame([(-1,), (5,)], "v long"))
    assert column.count_below(0) == 1
    column.release()
