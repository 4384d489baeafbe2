"""An interpolated modified Kneser-Ney bigram model, counted in Spark.

The vocabulary is kept as sorted 64-bit word hashes; a word's id is its place
there.  A bigram's key packs two ids, and a bijective mix of the key is its
hash.  Both lie in files of the shared folder, sorted, cut into shards by hash
range, so that any shard is as large as another however frequent a word is.
Workers map the files into memory and find words and bigrams by binary search.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import bound_batches, mix, scratch_path, word_hashes

#: The hash of the token after a text's last word.
END = np.uint64(0xE17A1465)
#: Tokens that a task counts before it hands on what it has.
CHUNK_TOKENS = 2_000_000
#: Bytes of text for each shard of the model's arrays, so that a shard is of about the same size in a corpus of any.
SHARD_BYTES = 16 << 20
#: Entries of one shard that are unpacked before they are merged.
HELD = 4_000_000
#: Files that a worker maps at once.
MAPS = 8192
_ID_BITS = np.uint64(32)
_ID_MASK = np.uint64((1 << 32) - 1)


# --- blobs ------------------------------------------------------------------


def _planes(x: np.ndarray) -> bytes:
    """The bytes of integers by place, which compress well where high bytes hardly vary."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplanes(raw: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def pack(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Sorted keys, as differences, and counts beside them."""
    steps = np.diff(keys, prepend=np.uint64(0))
    parts = [_planes(steps)] + [_planes(v.astype(np.uint64)) for v in values]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes, values: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    size = len(raw) // (1 + values)
    parts = [_unplanes(raw[i * size : (i + 1) * size], np.uint64) for i in range(1 + values)]
    return [np.cumsum(parts[0], dtype=np.uint64), *parts[1:]]


def merge(blobs: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Distinct keys in order, and the sums of what stands beside each."""
    columns = [np.concatenate(c) for c in zip(*blobs)]
    order = np.argsort(columns[0], kind="stable")
    keys = columns[0][order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return [keys[first]] + [np.add.reduceat(c[order], first) if len(first) else c for c in columns[1:]]


class Merged:
    """Blobs merged as they come: what is held is what is distinct and HELD entries more."""

    def __init__(self, values: int):
        self.values, self.parts, self.new = values, [], 0

    def add(self, blob: bytes) -> None:
        self.parts.append(unpack(blob, self.values))
        self.new += len(self.parts[-1][0])
        if self.new >= HELD:
            self.get()

    def get(self) -> list[np.ndarray]:
        """Keys and sums."""
        none = [np.empty(0, np.uint64)] * (1 + self.values)
        self.parts, self.new = [merge(self.parts) if self.parts else none], 0
        return self.parts[0]


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a hash: shards are ranges of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _blob_rows(kind: int, shard: np.ndarray, columns: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
    """Rows (shard, kind, blob) of columns whose first is sorted within each shard."""
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
    return [(int(shard[a]), kind, pack(*[c[order[a:b]] for c in columns])) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]


_BLOBS = "shard int, kind int, blob binary"


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    shard, kind, blob = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=["shard", "kind", "blob"])


def _by_shard(batches: Iterator[pa.RecordBatch], values: dict[int, int]) -> Iterator[tuple[int, dict[int, Merged]]]:
    """A partition's blobs, which come sorted by shard, merged by kind, one shard at a time; ``values`` of each kind."""
    now, held = None, {}
    for batch in batches:
        for shard, kind, blob in zip(*batch.columns):
            shard = shard.as_py()
            if shard != now:
                if now is not None:
                    yield now, held
                now, held = shard, {k: Merged(n) for k, n in values.items()}
            held[kind.as_py()].add(blob.as_py())
    if now is not None:
        yield now, held


def _dealt(blobs: DataFrame, shards: int) -> DataFrame:
    return blobs.repartition(shards, "shard").sortWithinPartitions("shard")


# --- files ------------------------------------------------------------------


def local_path(uri: str) -> str:
    """The path under which every worker sees the shared folder; memory can be mapped only from a mounted one."""
    at = urlparse(uri)
    if at.scheme not in ("", "file"):
        raise ValueError(f"the model's folder must be mounted on the workers, not {at.scheme}:")
    return at.path


def _write(path: str, x: np.ndarray) -> None:
    """Whole or not at all: a task that is run again, or twice at once, leaves the same file."""
    own = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    x.tofile(own)
    os.replace(own, path)


def _map(path: str, kind, n: int) -> np.ndarray:
    """``n`` numbers of ``kind``, or as wide as the file has them where that is None; a file that is missing or of another size is an error."""
    if not n:
        return np.empty(0, kind or np.uint64)
    size = os.path.getsize(path)  # raises if it isn't there
    kind = kind or {4: np.uint32, 8: np.uint64}.get(size // n, np.uint64)
    if size != n * np.dtype(kind).itemsize:
        raise ValueError(f"{path} has {size} bytes, and not {n} numbers")
    return np.memmap(path, kind, "r")


# --- tokens -----------------------------------------------------------------


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's words and its end, and the tokens of each text."""
    words, sizes = word_hashes(column, lower=True)
    out = np.full(len(words) + len(sizes), END, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)] = words
    return out, sizes + 1


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held, n = [], 0
    for batch in batches:
        held.append(tokens(batch.column(0)))
        n += len(held[-1][0])
        if n >= CHUNK_TOKENS:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


@dataclass
class Model:
    """Where the arrays are, and the numbers that hold for all of them.

    Ids: a word's place in the vocabulary, ``v`` for any other word and
    ``v + 1`` for a text's beginning.
    """

    folder: str
    shards: int
    starts: list[int] = field(default_factory=list)  # of each vocabulary shard
    words: list[int] = field(default_factory=list)  # by shard
    pairs: list[int] = field(default_factory=list)  # by shard
    stats: frozenset = frozenset()  # shards that have statistics
    v: int = 0
    n: int = 0
    bigram_discounts: tuple = (0.0, 0.0, 0.0)
    word_discounts: tuple = (0.0, 0.0, 0.0)
    bigrams: int = 0
    word_kinds: tuple = (0, 0, 0)  # words by the number of words before them: one, two, more


class Arrays:
    """A model's files, mapped by one worker as they are needed; a process can hold only so many maps."""

    def __init__(self, model: Model):
        self.m = model
        self.of = lru_cache(MAPS)(lambda name, i: _map(f"{model.folder}/{name}-{i}", None if name == "times" else np.uint64, self.size(name, i)))

    def size(self, name: str, i: int) -> int:
        """The numbers in a file; statistics are written for shards of ids that any bigram has."""
        if name == "stats":
            a, b = id_range(i, self.m)
            return 5 * (b - a) if i in self.m.stats else 0
        return (self.m.words if name in ("word", "count") else self.m.pairs)[i]

    def _find(self, sorted_hashes: np.ndarray, name: str) -> Iterator[tuple[slice, int, np.ndarray, np.ndarray]]:
        cuts = np.searchsorted(shard_of(sorted_hashes, self.m.shards), np.arange(self.m.shards + 1, dtype=np.uint64))
        for i in np.flatnonzero(np.diff(cuts)):
            own, known = sorted_hashes[cuts[i] : cuts[i + 1]], self.of(name, int(i))
            at = np.searchsorted(known, own)
            hit = np.zeros(len(own), bool)
            inside = at < len(known)
            hit[inside] = known[at[inside]] == own[inside]
            yield slice(cuts[i], cuts[i + 1]), int(i), at, hit

    def ids(self, sorted_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and training counts of distinct, sorted words."""
        ids, counts = np.full(len(sorted_hashes), self.m.v, np.uint64), np.zeros(len(sorted_hashes), np.uint64)
        for part, i, at, hit in self._find(sorted_hashes, "word"):
            ids[part][hit] = at[hit].astype(np.uint64) + np.uint64(self.m.starts[i])
            counts[part][hit] = self.of("count", i)[at[hit]]
        return ids, counts

    def times_of(self, sorted_hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(sorted_hashes), np.uint64)
        for part, i, at, hit in self._find(sorted_hashes, "hash"):
            out[part][hit] = self.of("times", i)[at[hit]]
        return out

    def stats_of(self, ids: np.ndarray) -> np.ndarray:
        """By id, sorted: tokens after it, words after it once, twice, more often, words before it."""
        out = np.zeros((len(ids), 5))
        shard = ids * np.uint64(self.m.shards) // np.uint64(self.m.v + 2)
        cuts = np.searchsorted(shard, np.arange(self.m.shards + 1, dtype=np.uint64))
        for i in np.flatnonzero(np.diff(cuts)):
            if len(stats := self.of("stats", int(i)).reshape(-1, 5)):
                out[cuts[i] : cuts[i + 1]] = stats[(ids[cuts[i] : cuts[i + 1]] - np.uint64(id_range(i, self.m)[0])).astype(np.int64)]
        return out


def id_range(shard: int, model: Model) -> tuple[int, int]:
    """The ids of one shard of the statistics."""
    size = model.v + 2
    return -(-shard * size // model.shards), -(-(shard + 1) * size // model.shards)


def _pairs(chunk: np.ndarray, sizes: np.ndarray, arrays: Arrays) -> tuple[np.ndarray, ...]:
    """Each token's bigram key, and the distinct words' ids and counts with each token's place among them."""
    known, place = np.unique(chunk, return_inverse=True)
    ids, counts = arrays.ids(known)
    own = ids[place]
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[np.cumsum(sizes) - sizes] = arrays.m.v + 1
    return before << _ID_BITS | own, ids, counts, place


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's discounts for counts of one, two, and three or more; fixed ones where a count of counts is missing."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def fit(df: DataFrame, text: str = "text", folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> Model:
    """Count the texts of ``df`` and write the model to ``folder`` (default: a new one in the shared folder).

    All words of all whole texts are counted.  Tasks count chunks of a bounded
    number of tokens and hand on distinct words and bigrams; these meet by
    hash, so a very frequent word is one entry like any other.  There is a shard
    for each ``shard_bytes`` of text; the driver gets a few numbers of each, and
    the model knows the size of each file.  Counts have 64 bits; more than 2^32
    distinct words are refused.  A null text counts as empty, with its end as the
    only token; repeated rows count each time; without rows the model is empty.
    """
    spark = df.sparkSession
    bound_batches(spark)
    size = df.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0
    shards = max(1, -(-size // shard_bytes))
    where = local_path(folder or scratch_path(spark, "lm"))
    os.makedirs(where, exist_ok=True)
    model = Model(where, shards)
    texts = df.select(F.col(text).alias("text"))

    def count_words(batches):
        for chunk, _ in _chunks(batches):
            words, n = np.unique(chunk, return_counts=True)
            yield _batch(_blob_rows(0, shard_of(words, shards), [words, n]))

    def write_words(batches):
        rows = []
        for shard, held in _by_shard(batches, {0: 1}):
            words, n = held[0].get()
            _write(f"{where}/word-{shard}", words)
            _write(f"{where}/count-{shard}", n)
            rows.append((shard, len(words), int(n.sum())))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 3, names=["shard", "v", "n"])

    found = {r.shard: (r.v, r.n) for r in _dealt(texts.mapInArrow(count_words, _BLOBS), shards).mapInArrow(write_words, "shard long, v long, n long").collect()}
    for i in range(shards):
        model.starts.append(model.v)
        model.words.append(found.get(i, (0, 0))[0])
        model.v += found.get(i, (0, 0))[0]
        model.n += found.get(i, (0, 0))[1]
    if model.v + 2 >= 1 << 32:
        raise ValueError("ids take 32 bits")
    plan = model  # as far as the workers need it

    def count_pairs(batches):
        arrays = Arrays(plan)
        for chunk, sizes in _chunks(batches):
            keys, n = np.unique(_pairs(chunk, sizes, arrays)[0], return_counts=True)
            yield _batch(_blob_rows(0, shard_of(mix(keys), shards), [keys, n]))

    def write_pairs(batches):
        for shard, held in _by_shard(batches, {0: 1}):
            keys, n = held[0].get()
            hashes = mix(keys)
            order = np.argsort(hashes)
            _write(f"{where}/hash-{shard}", hashes[order])
            _write(f"{where}/times-{shard}", n[order].astype(np.uint32 if n.max(initial=0) < 1 << 32 else np.uint64))
            left, right = keys >> _ID_BITS, keys & _ID_MASK
            after = merge([[left, n, (n == 1).astype(np.uint64), (n == 2).astype(np.uint64), (n > 2).astype(np.uint64)]])
            words, before = np.unique(right, return_counts=True)
            size, k = np.uint64(plan.v + 2), np.uint64(shards)
            rows = _blob_rows(0, after[0] * k // size, after) + _blob_rows(1, words * k // size, [words, before])
            # bigrams that occur once to four times, and, as the fifth, all of the shard
            rows.append((shard, 2, pack(np.arange(1, 6, dtype=np.uint64), np.array([*((n == i).sum() for i in range(1, 5)), len(n)]))))
            yield _batch(rows)

    def write_stats(batches):
        rows = []
        for shard, held in _by_shard(batches, {0: 4, 1: 1, 2: 1}):
            a, b = id_range(shard, plan)
            stats = np.zeros((b - a, 5), np.uint64)
            after, (words, before) = held[0].get(), held[1].get()
            stats[(after[0] - np.uint64(a)).astype(np.int64), :4] = np.stack(after[1:], 1)
            stats[(words - np.uint64(a)).astype(np.int64), 4] = before
            _write(f"{where}/stats-{shard}", stats)
            kinds = [int((stats[:, 4] == i).sum()) for i in range(1, 5)]
            of = dict(zip(*(x.tolist() for x in held[2].get())))
            rows.append((shard, *kinds, int((stats[:, 4] > 2).sum()), int(stats[:, 4].sum()), *(of.get(i, 0) for i in range(1, 6))))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(names), names=names)

    names = ["shard", "w1", "w2", "w3", "w4", "w3up", "bigrams", "b1", "b2", "b3", "b4", "pairs"]
    pairs = _dealt(texts.mapInArrow(count_pairs, _BLOBS), shards).mapInArrow(write_pairs, _BLOBS)
    by_shard = _dealt(pairs, shards).mapInArrow(write_stats, ", ".join(f"{x} long" for x in names)).collect()
    model.stats = frozenset(r.shard for r in by_shard)
    in_shard = {r.shard: r.pairs for r in by_shard}
    model.pairs = [in_shard.get(i, 0) for i in range(shards)]
    totals = Row(**{x: sum(r[x] for r in by_shard) for x in names[1:]})
    model.bigrams = totals.bigrams
    model.word_kinds = (totals.w1, totals.w2, totals.w3up)
    model.word_discounts = discounts(totals.w1, totals.w2, totals.w3, totals.w4)
    model.bigram_discounts = discounts(totals.b1, totals.b2, totals.b3, totals.b4)
    return model


def _off(n: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *by])[np.minimum(n, 3).astype(np.int64)]


def log_scores(arrays: Arrays, chunk: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By text: known tokens, base score, the model's log10 probability."""
    m = arrays.m
    starts = np.cumsum(sizes) - sizes
    keys, ids, counts, place = _pairs(chunk, sizes, arrays)
    # by distinct word: base, and probability after any word
    base = np.log10((counts + 1.0) / (m.n + m.v + 1.0))
    order = np.argsort(ids, kind="stable")
    stats = np.empty((len(ids), 5))
    stats[order] = arrays.stats_of(ids[order])
    if m.bigrams:
        spare = sum(d * k for d, k in zip(m.word_discounts, m.word_kinds)) / m.bigrams
        alone = np.maximum(stats[:, 4] - _off(stats[:, 4], m.word_discounts), 0) / m.bigrams + spare / (m.v + 1)
    else:
        alone = np.full(len(ids), 1.0 / (m.v + 1))
    # by distinct bigram: what is left of its own count, and the weight of the shorter context
    known, at = np.unique(keys, return_inverse=True)
    hashes = mix(known)
    order = np.argsort(hashes)
    times = np.empty(len(known))
    times[order] = arrays.times_of(hashes[order])
    left, first = np.unique(known >> _ID_BITS, return_index=True)
    after = np.repeat(arrays.stats_of(left), np.diff(np.append(first, len(known))), axis=0)
    total = after[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.where(total > 0, np.maximum(times - _off(times, m.bigram_discounts), 0) / total, 0.0)
        weight = np.where(total > 0, after[:, 1:4] @ np.array(m.bigram_discounts) / total, 1.0)
    p = own[at] + weight[at] * alone[place]
    return np.add.reduceat((counts > 0)[place].astype(np.int64), starts), np.add.reduceat(base[place], starts), np.add.reduceat(np.log10(p), starts)


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and ``perplexity`` to the columns ``keep`` (default: all).

    Every whole text is scored, in one pass without a shuffle; a null text is
    empty and has its end as its one token.  ``score`` is the log10 probability
    of all tokens, ``perplexity`` 10 to the power -score / n_tokens.  An empty
    model gives every token the same probability, 1.  A column of ``df`` with
    one of these names is replaced.
    """
    bound_batches(df.sparkSession)
    added = {"n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64(), "perplexity": pa.float64()}
    keep = [c for c in (df.columns if keep is None else keep) if c not in added]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + [f"{k} {'long' if t == pa.int64() else 'double'}" for k, t in added.items()])

    def run(batches):
        arrays = Arrays(model)
        held: list[pa.RecordBatch] = []

        def out():
            batch = pa.Table.from_batches(held).combine_chunks()
            chunk, sizes = tokens(batch.column(len(keep)))
            known, base, own = log_scores(arrays, chunk, sizes)
            values = [sizes, known, np.full(len(sizes), model.n), base, own, 10.0 ** np.minimum(-own / sizes, 300)]
            made = [pa.array(v, t) for v, t in zip(values, added.values())]
            return pa.Table.from_arrays([batch.column(i) for i in range(len(keep))] + made, names=keep + list(added)).to_batches()

        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += pc.sum(pc.binary_length(batch.column(len(keep)))).as_py() or 0
            if n > 4 * CHUNK_TOKENS:
                yield from out()
                held, n = [], 0
        if held:
            yield from out()

    return source.mapInArrow(run, schema)
