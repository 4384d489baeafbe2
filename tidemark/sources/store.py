"""Stored keyed tables: immutable versions and transactions over them.

A table is a folder.  A version is a manifest that names a base (Parquet), a
net effect over it (Parquet, small; merged and rewritten by each commit), and
the batches of a stream that it includes.  A manifest is published under a
name that must not exist yet; that is the commit point.  A reader resolves one
manifest and stays on it.  When the net effect outgrows a share of the base,
a commit writes a new base.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NullValue, RepeatedKeys, UniqueViolation, UnsupportedRename, WriteConflict
from ..functions.schema import KV, OPS, local, refuse_nulls, unsigned32
from ..operators import dml
from ..operators.lookup import find_many, multi_get, pages, point_get
from ..operators.overlay import merged, net_effect, overlay, violations

DELTA = "k long, v long, deleted boolean"
#: A new base is written when the net effect has more than this share of the base's rows.
COMPACT_AT = 0.1
#: Keys that an error names.
NAMED = 5


class _Folder:
    """The file operations that a store needs, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Write a whole file under a name that isn't there; False if it is, by now."""
        own = self._path(f"tmp/{uuid.uuid4().hex}")
        stream = self.fs.create(own, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        target = self._path(name)
        if self.fs.getUri().getScheme() == "file":  # a rename would replace the target there; a link does not
            files, at = self.jvm.java.nio.file.Files, self.jvm.java.io.File
            self.fs.mkdirs(target.getParent())
            try:
                files.createLink(at(target.toUri().getPath()).toPath(), at(own.toUri().getPath()).toPath())
            except Exception as e:
                if "FileAlreadyExists" in str(e):
                    return False
                raise
            finally:
                self.fs.delete(own, False)
            return True
        self.fs.mkdirs(target.getParent())
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            self.context.rename(own, target, options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                self.fs.delete(own, False)
                return False
            raise
        return True

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class Store:
    """One keyed table in one folder; tables share nothing.

    ``u32_values`` keeps the low 32 bits of values only, at commit.  A table
    that is made with ``unique=False`` has no unique key, as one without a
    primary key in SQL: inserted rows stay beside those of the same key, and
    what needs a key to name one row is refused.  A table stays as it was made.
    """

    def __init__(self, spark: SparkSession, path: str, u32_values: bool = False, unique: bool = True):
        self.spark, self.u32_values = spark, u32_values
        self.folder = _Folder(spark, path)
        if not self.versions():
            self.folder.publish("versions/0.json", json.dumps({"version": 0, "base": None, "base_rows": 0, "delta": None, "batches": {}, "unique": unique}))
        self.unique = self.manifest().get("unique", True)

    # versions

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.folder.names("versions") if n.endswith(".json") and not n.startswith("."))

    @property
    def version(self) -> int:
        return self.versions()[-1]

    def manifest(self, version: int | None = None) -> dict:
        return json.loads(self.folder.read(f"versions/{self.version if version is None else version}.json"))

    def _read(self, name: str | None, schema) -> DataFrame:
        if name is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder.path}/{name}")

    def snapshot(self, version: int | None = None) -> DataFrame:
        """The rows of one version, the newest by default; it stays the same whatever is committed later."""
        m = self.manifest(version)
        base = self._read(m["base"], KV)
        return base if m["delta"] is None else self.over(base, self._read(m["delta"], DELTA))

    scan = snapshot

    def over(self, base: DataFrame, delta: DataFrame) -> DataFrame:
        """The base with a net effect over it; without a unique key that is more rows."""
        return overlay(base, delta) if self.unique else base.unionByName(delta.select("k", "v"))

    def require_unique(self) -> None:
        if not self.unique:
            raise RepeatedKeys("the table has no unique key: it takes inserts and scans, and gets of all rows of keys")

    def pages(self, rows: int, version: int | None = None) -> Iterator[list]:
        """The rows of one version, page by page in order of the key; the driver holds a page at a time."""
        paged = self.paged(rows, version)
        last = paged.agg(F.max("page")).first()[0]
        for page in range(0 if last is None else last + 1):
            yield paged.where(F.col("page") == page).select("k", "v").orderBy("k").collect()

    def paged(self, rows: int, version: int | None = None) -> DataFrame:
        return pages(self.snapshot(version), rows)

    # reads

    def get(self, key: int) -> int | None:
        self.require_unique()
        row = point_get(self.snapshot(), key).first()
        return None if row is None else row.v

    def get_many(self, keys: Iterable[int | None]) -> DataFrame:
        return multi_get(self.snapshot(), keys)

    def find_many(self, requests: DataFrame) -> DataFrame:
        self.require_unique()
        return find_many(self.snapshot(), requests)

    # writes

    def begin(self, allow_overlap: bool = False) -> Transaction:
        return Transaction(self, allow_overlap)

    def put(self, key: int, value: int) -> None:
        """Insert or overwrite one key, without a check."""
        self.upsert([(key, value)])

    def upsert(self, rows: DataFrame | list, order: str | None = None) -> None:
        """Insert or overwrite; of rows with one key the last of a list stays, or the one with the greatest ``order``.

        Without an order, a DataFrame with repeated keys is refused.
        """
        self.require_unique()
        if isinstance(rows, list):
            rows, order = local(self.spark, [(k, v, n) for n, (k, v) in enumerate(rows)], "k long, v long, n long"), "n"
        refuse_nulls(rows)
        if order:
            rows = rows.groupBy("k").agg(F.max_by("v", order).alias("v"))
        else:
            refuse_repeated(rows)
        self.commit_delta(rows_of(self.spark, rows).withColumn("deleted", F.lit(False)), self.version)

    def insert_many(self, rows: DataFrame | list) -> int:
        """Insert keys that must be new where keys are unique, all or nothing; returns the version."""
        txn = self.begin()
        try:
            txn.insert(rows)
        except Exception:
            txn.rollback()
            raise
        return txn.commit()

    def remove(self, key: int) -> None:
        self.remove_many([key])

    def remove_many(self, keys: DataFrame | Iterable[int]) -> None:
        """Delete keys, there or not; a DataFrame gives them in its first column."""
        if not isinstance(keys, DataFrame):
            keys = local(self.spark, [(int(k),) for k in keys], "k long")
        keys = keys.select(F.col(keys.columns[0]).cast("long").alias("k")).where("k is not null").distinct()
        self.commit_delta(keys.select("k", F.lit(None).cast("long").alias("v"), F.lit(True).alias("deleted")), self.version)

    def vacuum(self, keep: int = 1) -> list[int]:
        """Remove all versions but the newest ``keep``, and data that none of these names; returns the versions that went.

        Readers of a version that goes lose it, and so do open transactions on one.
        """
        if keep < 1:
            raise ValueError("one version stays at least")
        versions = self.versions()
        gone, stay = versions[:-keep], versions[-keep:]
        named = {m[part] for m in map(self.manifest, stay) for part in ("base", "delta") if m[part]}
        for version in gone:
            self.folder.remove(f"versions/{version}.json")
        for name in self.folder.names("data"):
            if f"data/{name}" not in named and int(name.split("-")[0]) <= stay[-1]:
                self.folder.remove(f"data/{name}")
        return gone

    def commit_delta(self, delta: DataFrame, based_on: int, batch: tuple[str, int] | None = None) -> int:
        """Publish the version after ``based_on``: its rows with a net effect over them."""
        self.require_unique()
        return self._commit(delta, based_on, batch)

    def commit_rows(self, rows: DataFrame, based_on: int) -> int:
        """Publish the version after ``based_on`` of a table without a unique key: its rows and these."""
        if self.unique:
            raise ValueError("rows come unchecked, so the table's keys must not be unique")
        return self._commit(rows.select("k", "v", F.lit(False).alias("deleted")), based_on)

    def _commit(self, delta: DataFrame, based_on: int, batch: tuple[str, int] | None = None) -> int:
        m = self.manifest(based_on)
        if self.u32_values:
            delta = delta.withColumn("v", unsigned32("v"))
        if m["delta"] is not None:
            old = self._read(m["delta"], DELTA)
            delta = merged(old, delta) if self.unique else old.unionByName(delta)
        new = based_on + 1
        name = f"data/{new}-{uuid.uuid4().hex}"
        out = m | {"version": new, "delta": f"{name}.delta"}
        compact = m["base"] is None
        if not compact:
            delta.select("k", "v", "deleted").write.parquet(f"{self.folder.path}/{name}.delta")
            delta = self._read(f"{name}.delta", DELTA)
            compact = delta.count() > COMPACT_AT * m["base_rows"]
        if compact:
            # ranges of keys in order, so that the files' and row groups' statistics leave out all but a few for a key
            ranges = ["k"] if self.unique else ["k", "v"]  # rows of one key are spread by their values
            self.over(self._read(m["base"], KV), delta).repartitionByRange(*ranges).sortWithinPartitions("k").write.parquet(f"{self.folder.path}/{name}")
            out |= {"base": name, "delta": None, "base_rows": self._read(name, KV).count()}
        if batch:
            out["batches"] = m["batches"] | {batch[0]: batch[1]}
        if not self.folder.publish(f"versions/{new}.json", json.dumps(out)):
            self.folder.remove(f"{name}.delta")
            self.folder.remove(name)
            raise WriteConflict(f"version {new} has been published by another writer")
        return new


def refuse_repeated(rows: DataFrame) -> None:
    if found := [r.k for r in dml.duplicates(rows).orderBy("k").limit(NAMED).collect()]:
        raise UniqueViolation("keys twice in one batch", found)


def rows_of(spark: SparkSession, rows: DataFrame | list) -> DataFrame:
    return rows.select(F.col("k").cast("long").alias("k"), F.col("v").cast("long").alias("v")) if isinstance(rows, DataFrame) else local(spark, rows, "k long, v long")


class Transaction:
    """An ordered log of operations over a pinned version.

    Reads see the version with the log over it.  Each statement writes its
    resolved rows as Parquet, so that plans do not grow with the statements.
    A key that is inserted twice in the transaction is refused at once, one
    that is there already at commit.  A table without a unique key takes
    inserts only and keeps all of their rows.  A failed commit, and a
    rollback, leave the table as it was.  Used as a context manager it commits
    at the end.
    """

    def __init__(self, store: Store, allow_overlap: bool = False):
        self.store, self.spark, self.allow_overlap = store, store.spark, allow_overlap
        self.version = store.version
        self.base = store.snapshot(self.version)
        self._folder = f"tmp/txn-{uuid.uuid4().hex}"
        self._logs: list[str] = []
        self._seq = 0
        self._open = True

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if self._open:
            self.commit() if kind is None else self.rollback()

    # the log

    def _check_open(self) -> None:
        if not self._open:
            raise RuntimeError("the transaction has ended")

    @property
    def ops(self) -> DataFrame:
        if not self._logs:
            return local(self.spark, [], OPS)
        return self.spark.read.schema(OPS).parquet(*[f"{self.store.folder.path}/{n}" for n in self._logs])

    def _resolved(self, rows: DataFrame) -> tuple[str, DataFrame]:
        """A statement's rows, written once; checks and the log read them from there."""
        path = f"{self._folder}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.store.folder.path}/{path}")
        return path, self.spark.read.schema(rows.schema).parquet(f"{self.store.folder.path}/{path}")

    def _log(self, path: str) -> None:
        self._logs.append(path)
        self._seq += 2

    def _step(self, op: str, at: int = 0):
        return F.lit(self._seq + at).cast("long").alias("seq"), F.lit(op).alias("op")

    def _refuse_bad(self, rows: DataFrame, message: str = "keys twice in one statement") -> None:
        """Refuse nulls and repeated keys, in one pass."""
        found = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v").isNull()).alias("null_v")).where("k is null or null_v > 0 or n > 1")
        bad = found.orderBy("k").limit(NAMED).collect()
        if any(r.k is None or r.null_v for r in bad):
            raise NullValue("null key or value")
        if bad:
            raise UniqueViolation(message, [r.k for r in bad])

    def _live(self) -> DataFrame:
        """Keys that this transaction has written and not deleted."""
        return net_effect(self.ops).where(~F.col("deleted")).select("k")

    def _refuse(self, keys: DataFrame, error, message: str) -> None:
        if found := [r.k for r in keys.orderBy("k").limit(NAMED).collect()]:
            raise error(message, found)

    # reads

    def scan(self) -> DataFrame:
        self._check_open()
        if not self._logs:
            return self.base
        return self.store.over(self.base, net_effect(self.ops) if self.store.unique else self.ops)

    def get(self, key: int) -> int | None:
        self.store.require_unique()
        row = point_get(self.scan(), key).first()
        return None if row is None else row.v

    def get_many(self, keys: Iterable[int | None]) -> DataFrame:
        return multi_get(self.scan(), keys)

    # statements

    def insert(self, rows: DataFrame | list) -> None:
        self._check_open()
        path, written = self._resolved(rows_of(self.spark, rows).select(*self._step("INS"), "k", "v"))
        if self.store.unique:
            self._refuse_bad(written)
            if self._logs:
                self._refuse(dml.existing(self._live(), written), UniqueViolation, "keys are there in this transaction")
        else:
            refuse_nulls(written)
        self._log(path)

    def update(self, where: Column, value: Column) -> None:
        self.store.require_unique()
        rows = self.scan().where(where).select(*self._step("UPD"), "k", value.cast("long").alias("v"))
        path, written = self._resolved(rows)
        refuse_nulls(written)
        self._log(path)

    def delete(self, where: Column) -> None:
        self.store.require_unique()
        self._log(self._resolved(self.scan().where(where).select(*self._step("DEL"), "k", F.lit(None).cast("long").alias("v")))[0])

    def rename(self, where: Column, key: Column, value: Column | None = None) -> None:
        """Change keys, and values with them if one is given; both are computed from the old row.

        Keys that are both old and new in the statement are refused, unless overlaps are allowed.
        """
        self.store.require_unique()
        value = F.col("v") if value is None else value
        rows = self.scan().where(where).select(F.col("k").alias("old_k"), key.cast("long").alias("k"), value.cast("long").alias("v"))
        _, rows = self._resolved(rows)
        moved = rows.where("k is null or old_k <> k")
        self._refuse_bad(rows if self.allow_overlap else moved)
        if not self.allow_overlap:
            self._refuse(dml.rename_overlaps(moved.withColumnRenamed("k", "new_k")), UnsupportedRename, "keys are both old and new")
        if self._logs:
            live = self._live().join(moved.select(F.col("old_k").alias("k")), "k", "left_anti")
            self._refuse(dml.existing(live, moved), UniqueViolation, "keys are there in this transaction")
        stay = rows.where("old_k = k").select(*self._step("UPD"), "k", "v")
        gone = moved.select(*self._step("DEL"), F.col("old_k").alias("k"), F.lit(None).cast("long").alias("v"))
        path, written = self._resolved(stay.unionByName(gone).unionByName(moved.select(*self._step("INS", 1), "k", "v")))
        refuse_nulls(written.where("op <> 'DEL'"))
        self._log(path)

    # ends

    def savepoint(self) -> int:
        return len(self._logs)

    def rollback_to(self, mark: int) -> None:
        """Forget the statements after a savepoint."""
        self._check_open()
        del self._logs[mark:]

    def rollback(self) -> None:
        self._open = False
        self.store.folder.remove(self._folder)

    def commit(self) -> int:
        """Publish the log's net effect, all or nothing; returns the version."""
        self._check_open()
        try:
            if not self._logs:
                return self.version
            if not self.store.unique:
                return self.store.commit_rows(self.ops, self.version)
            if self.store.manifest(self.version)["base"] is not None:  # else the statements' checks are enough
                self._refuse(violations(self.base, self.ops), UniqueViolation, "keys are there")
            return self.store.commit_delta(net_effect(self.ops), self.version)
        finally:
            self.rollback()
