"""Nearest neighbours by inner product, with score-aware quantisation.

A vector is cut into pairs of components, and each pair is coded in four bits
by a codebook of 16 centres.  Codes and centres minimise a loss in which the
part of the residual that is parallel to the vector weighs more than the rest:
that part moves large inner products, which alone matter.  A query's table
holds its inner product with every centre; a scan adds table entries by code.
The best of a scan are scored again on the original vectors, and so is every
other row whose rough score, with all that its code may have left out of it,
reaches the last of them: what a block returns are its true nearest rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, checkpointed

CENTRES = 16
#: Rows that the codebooks are fitted on, at most; all rows are coded.
SAMPLE = 8192
#: The share of a vector's length from which inner products count, in the loss.
THRESHOLD = 0.2
#: Bytes of vectors that are scanned at once.
BLOCK_BYTES = 4 << 20
#: Bytes of queries that go out at once, by broadcast; more go in several rounds.
QUERY_BYTES = 16 << 20
#: Queries that are scanned at once.
QUERY_BLOCK = 128
#: Scores that are held at once.
CELLS = 1 << 20
#: Candidates of each block that are scored first, for each neighbour asked for; the rest follow as far as the bounds tell.
SHORTLIST = 16


@dataclass(frozen=True)
class Codebooks:
    dim: int
    centres: np.ndarray  # pair, centre, 2
    eta: float

    def pairs(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, x.shape[1] % 2))).reshape(len(x), -1, 2)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes of the vectors: for each pair in turn the centre of the least loss, given the others."""
        v = self.pairs(x.astype(np.float32))
        norm2 = np.maximum((v * v).sum((1, 2)), 1e-30)
        codes = np.empty(v.shape[:2], np.uint8)
        along = np.zeros(v.shape[:2], np.float32)  # the residual of each pair times the vector
        for j in range(v.shape[1]):
            r = v[:, j, None, :] - self.centres[j]
            codes[:, j] = (r * r).sum(2).argmin(1)
            along[:, j] = ((v[:, j] - self.centres[j][codes[:, j]]) * v[:, j]).sum(1)
        total = along.sum(1)
        for _ in range(sweeps):
            for j in range(v.shape[1]):
                r = v[:, j, None, :] - self.centres[j]
                own = (r * v[:, j, None, :]).sum(2)
                rest = (total - along[:, j])[:, None]
                loss = (r * r).sum(2) + (self.eta - 1) * (rest + own) ** 2 / norm2[:, None]
                codes[:, j] = loss.argmin(1)
                new = own[np.arange(len(v)), codes[:, j]]
                total += new - along[:, j]
                along[:, j] = new
        return codes

    def left(self, packed: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The length of the residual of each vector with its packed codes."""
        codes = np.stack([packed & 15, packed >> 4], 2).reshape(len(packed), -1)
        v, total = self.pairs(x), np.zeros(len(x))
        for j, centres in enumerate(self.centres):
            r = v[:, j] - centres[codes[:, j]]
            total += (r * r).sum(1)
        return np.sqrt(total)


def fit(x: np.ndarray, rounds: int = 4, seed: int = 5) -> Codebooks:
    """Codebooks for vectors like the rows of ``x``: k-means for a start, then codes and centres in turn."""
    dim = x.shape[1]
    t2 = THRESHOLD**2
    eta = max(1.0, (dim - 1) * t2 / (1 - t2))
    rng = np.random.default_rng(seed)
    books = Codebooks(dim, np.zeros((-(-dim // 2), CENTRES, 2), np.float32), eta)
    v = books.pairs(x.astype(np.float32))
    for j in range(v.shape[1]):
        c = v[rng.permutation(len(v))[np.arange(CENTRES) % len(v)], j].copy()
        for _ in range(8):
            at = ((v[:, j, None, :] - c) ** 2).sum(2).argmin(1)
            n = np.bincount(at, minlength=CENTRES)
            for axis in (0, 1):
                s = np.bincount(at, v[:, j, axis], CENTRES)
                c[n > 0, axis] = s[n > 0] / n[n > 0]
        books.centres[j] = c
    norm2 = np.maximum((v * v).sum((1, 2)), 1e-30)
    for _ in range(rounds):
        codes = books.encode(x, sweeps=1)
        chosen = np.stack([books.centres[j][codes[:, j]] for j in range(v.shape[1])], 1)
        along = ((v - chosen) * v).sum(2)
        total = along.sum(1)
        for j in range(v.shape[1]):
            own, w = v[:, j], (eta - 1) / norm2
            a = np.eye(2) + w[:, None, None] * own[:, :, None] * own[:, None, :]
            b = own * (1 + w * (total - along[:, j] + (own * own).sum(1)))[:, None]
            for k in range(CENTRES):
                if (at := codes[:, j] == k).any():
                    books.centres[j, k] = np.linalg.solve(a[at].sum(0), b[at].sum(0))
            new = ((own - books.centres[j][codes[:, j]]) * own).sum(1)
            total += new - along[:, j]
            along[:, j] = new
    return books


def usable(vector: str) -> Column:
    """Whether a vector takes part: there, without null or non-finite components, and not zero."""
    c = F.col(vector)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(c, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().cast(pa.float64())).reshape(-1, dim)


@dataclass
class Index:
    blocks: DataFrame  # n, ids, codes, vectors: packed arrays of about BLOCK_BYTES of vectors
    books: Codebooks | None


def build(df: DataFrame, key: str, vector: str) -> Index:
    """Code every usable row of ``df``.  Vectors of another length than the most frequent one (ties: the shorter) take no part."""
    spark = df.sparkSession
    bound_batches(spark)
    rows = df.where(F.col(key).isNotNull() & usable(vector)).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    schema = "n int, ids binary, codes binary, vectors binary"
    if common is None:
        return Index(spark.createDataFrame([], schema), None)
    dim = common.dim
    rows = rows.where(F.size("v") == dim)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    books = fit(_matrix(sample.column("v").combine_chunks(), dim))
    shared = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ids, x = t["id"].to_numpy(), _matrix(t["v"].combine_chunks() if isinstance(t["v"], pa.ChunkedArray) else t["v"], dim)
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            codes = shared.value.encode(x)
            codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
            packed = codes[:, 0::2] | codes[:, 1::2] << 4
            return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32())] + [pa.array([y.tobytes()], pa.binary()) for y in (ids, packed, x)], names=["n", "ids", "codes", "vectors"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) * dim * 8 >= BLOCK_BYTES:
                yield out()
                held = []
        if held:
            yield out()

    return Index(checkpointed(rows.mapInArrow(run, schema)), books)


def exact(x: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inner products, in double precision and in order of the components, of queries with the rows ``at`` of each."""
    out = np.zeros(at.shape)
    for d in range(x.shape[1]):
        out += x[:, d][at] * q[:, d, None]
    return out


def _early(x: np.ndarray, most: int) -> np.ndarray:
    """The rows, in order of id, without those that equal ``most`` earlier ones: such a row can be no neighbour, as ties go to smaller ids."""
    whole = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, group = np.unique(whole, return_inverse=True)
    order = np.argsort(group, kind="stable")
    first = np.searchsorted(group[order], group[order])
    return np.sort(order[np.arange(len(x)) - first < most])


def scan(books: Codebooks, ids: np.ndarray, packed: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, ids and scores of the ``k`` nearest rows of each within one block, rows in order of id.

    A rough score errs by no more than the lengths of the query and of the
    row's residual, multiplied.  All rows that may reach the ``k``-th best
    exact score of the shortlist, by that, are scored again.
    """
    rows = _early(x, k + 1)
    ids, packed, x = ids[rows], packed[rows], x[rows]
    take = min(len(ids), k * SHORTLIST + 1)
    codes = packed.T.astype(np.int64)
    length, left = np.linalg.norm(x, axis=1), books.left(packed, x)
    reach = left + (books.dim + 8) * 2.0**-23 * (length + left)  # with the rounding of single precision
    rounding = books.dim * 2.0**-50 * length.max(initial=0.0)
    step = max(1, min(QUERY_BLOCK, CELLS // max(1, len(ids))))
    found = []
    for a in range(0, len(q), step):
        part, own = q[a : a + step], ids == query_ids[a : a + step, None]
        size = np.linalg.norm(part, axis=1)[:, None]
        table = np.einsum("qjd,jcd->qjc", books.pairs((part / size).astype(np.float32)), books.centres)
        table = np.pad(table, ((0, 0), (0, table.shape[1] % 2), (0, 0)))
        both = (table[:, 1::2, :, None] + table[:, 0::2, None, :]).reshape(len(part), -1, CENTRES * CENTRES)
        rough = np.zeros((len(part), len(ids)), np.float32)
        for j, code in enumerate(codes):
            rough += np.take(both[:, j], code, axis=1)
        at = np.argpartition(-rough, take - 1, axis=1)[:, :take] if take < len(ids) else np.tile(np.arange(len(ids)), (len(part), 1))
        score = exact(x, part, at)
        score[np.take_along_axis(own, at, 1)] = -np.inf
        least = np.sort(score, axis=1)[:, -k, None] if take >= k else -np.inf
        near = ~((rough + reach) * size < least) & ~own
        need = np.flatnonzero(near.any(0))
        near = near[:, need]
        score = np.where(near, part @ x[need].T, -np.inf)
        if len(need) > k:
            near &= ~(score < np.partition(score, len(need) - k, axis=1)[:, len(need) - k, None] - rounding * size)
        place, at = np.nonzero(near)
        at = need[at]
        score = exact(x, part[place], at[:, None])[:, 0]
        order = np.lexsort((ids[at], -score, place))
        order = order[np.arange(len(order)) - np.searchsorted(place, place) < k]
        found.append((a + place[order], ids[at[order]], score[order]))
    return tuple(map(np.concatenate, zip(*found)))


def search(index: Index, queries: DataFrame, key: str, vector: str, k: int = 20) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``: the ``k`` nearest rows for each usable query, all if there are fewer.

    Nearness is the inner product of the original vectors in double precision,
    ties go to the smaller id, and rows with the query's id are left out.  All
    rows are scanned, a block at a time; queries go to the rows in batches of a
    bounded size.  A task returns its best ``k`` of all its blocks.  Rows that
    are null, zero, not finite or of another length take no part on either
    side; an id that is asked for twice is answered once; empty tables give no
    rows.
    """
    spark = queries.sparkSession
    schema = "query_id long, vec_id long, score double"
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if index.books is None:
        return none
    books = spark.sparkContext.broadcast(index.books)
    dim = index.books.dim
    asked = queries.where(F.col(key).isNotNull() & usable(vector)).where(F.size(vector) == dim).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).dropDuplicates(["id"])
    asked = checkpointed(asked)  # read once for each batch
    batches = -(-asked.count() * dim * 8 // QUERY_BYTES)
    best = none.drop("rank")
    for n in range(batches):
        batch = asked.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == n).toArrow()
        ids, q = batch["id"].to_numpy(), _matrix(batch["v"].combine_chunks(), dim) if batch.num_rows else np.empty((0, dim))
        sent = spark.sparkContext.broadcast((ids, q))

        def run(parts: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            query_ids, q = sent.value
            held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
            for part in parts:
                for n, own, packed, x in zip(*(c.to_pylist() for c in part.columns)):
                    own, packed, x = np.frombuffer(own, np.int64), np.frombuffer(packed, np.uint8).reshape(n, -1), np.frombuffer(x, np.float64).reshape(n, -1)
                    held = [np.concatenate(c) for c in zip(held, scan(books.value, own, packed, x, query_ids, q, k))]
                    order = np.lexsort((held[1], -held[2], held[0]))
                    place = held[0][order]
                    order = order[np.arange(len(place)) - np.searchsorted(place, place) < k]
                    held = [c[order] for c in held]
            for a in range(0, len(held[0]), 65536):
                place, own, score = (c[a : a + 65536] for c in held)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[place], pa.int64()), pa.array(own, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])

        best = best.union(index.blocks.mapInArrow(run, schema))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")
    return ranked.where(F.col("rank") <= k)
