"""Near duplicates by bottom-k sketches and exact Jaccard similarity.

A document is the set of its word shingles, as 64-bit hashes.  Its sketch is
the k smallest of them: one hash function makes both.

1. Documents with equal sets form a class, and one of them stands for it.
2. Inverted lists hold, for each retained value, the documents that retain it.
   Two documents as similar as asked share at least ``need`` of their k values
   (six standard deviations below the mean), so they share one among the
   k - need + 1 that are rarest in the corpus; only those go into lists.
3. Each list's first document is compared with all others in it.  That links
   most groups of copies, however large, with one pair for each entry.
4. Lists that still hold several components: the pairs across components in
   lists of up to SMALL_LIST documents are compared one by one; what is in
   larger ones is cut into blocks of a bounded number of documents and
   shingles, and blocks are compared with each other, in the same three steps:
   overlaps from the lists of their sketches, the estimate, the full sets.
5. Pairs go through the estimate from the sketch of their union, then through
   the exact similarity of their full sets; only this makes a link.

Steps 3 and 4 leave no candidate out: a pair is skipped only when links found
already connect it.

A value, text or group may have any share of all rows.  Counts are aggregated
before the shuffle and stored; the joins that bring them, or texts, to the rows
are joins of two stored tables, which Spark splits where one key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import FILE_ROWS, bound_batches, checkpointed, mix, stored, word_hashes
from .components import components

SKETCH = 64
#: Lists up to this length are compared pair by pair.
SMALL_LIST = 128
#: Documents, and shingles, in a block of step 4, on average.
BLOCK, BLOCK_SHINGLES = 256, 400_000
#: Ids are broadcast to pick documents up to so many, and joined by shuffle beyond.
BROADCAST_IDS = 500_000
#: Texts, and sketches, in one file of a checkpoint.
FILE_TEXTS, FILE_SKETCHES = 1_000, 4_000


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text as signed hashes; a text of fewer words is one shingle, without words none."""
    hashes, sizes = word_hashes(column, lower=True)
    ends = np.cumsum(sizes)
    out = []
    for n, end in zip(sizes, ends):
        own = hashes[end - n : end]
        m = max(min(int(n), 1), int(n) - words + 1)
        width = min(words, int(n))
        total = np.full(m, width, np.uint64)
        for i in range(width):
            total = mix(total * np.uint64(0xD6E8FEB86659FD93) + own[i : i + m])
        out.append(np.unique(total.view(np.int64)))
    return out


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def floor_of(percent: int, size: int) -> float:
    """The least estimate that passes: six standard deviations below the threshold."""
    p = percent / 100
    return p - 6 * sqrt(p * (1 - p) / size)


def sketches(docs: DataFrame, words: int, size: int) -> DataFrame:
    """``id``, ``h``, ``n`` (shingles), ``fp`` (128 bits of the whole set) and ``sketch`` of the rows ``id``, ``h``, ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(2), words)
            low = [s[:size] for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in low])]).astype(np.int32)
            flat = np.concatenate(low) if low else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                names=["id", "h", "n", "fp", "sketch"],
            )

    return docs.mapInArrow(run, "id long, h long, n long, fp binary, sketch array<bigint>")


@dataclass
class Corpus:
    """The documents ``id``, ``h``, ``text``; ``reps`` has one row for each class, unique by ``id``: ``id``, ``h``, ``n``, ``sketch``."""

    docs: DataFrame
    reps: DataFrame
    words: int
    percent: int
    size: int

    def texts(self, ids: DataFrame) -> DataFrame:
        """``id`` and ``text`` of the checkpointed ``ids``, stored, each once."""
        n = ids.count()
        few = F.broadcast if n <= BROADCAST_IDS else lambda df: df
        asked = few(checkpointed(self.reps.join(few(ids), "id", "left_semi").select("id", "h").repartition(max(1, -(-n // FILE_ROWS)))))
        return checkpointed(self.docs.join(asked, ["id", "h"], "left_semi").dropDuplicates(["id"]).select("id", "text"), n, FILE_TEXTS)


def _ends(pairs: DataFrame, most: int) -> DataFrame:
    return checkpointed(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), 2 * most)


def confirm(pairs: DataFrame, corpus: Corpus, most: int) -> DataFrame:
    """The links among ``most`` candidate pairs ``a`` < ``b``, or fewer: the estimate first, then the full sets."""
    pairs = checkpointed(pairs.distinct(), most)
    n = pairs.count()
    words, percent, size = corpus.words, corpus.percent, corpus.size
    ends = _ends(pairs, n)
    own = corpus.reps.select("id", "sketch")
    if ends.count() <= BROADCAST_IDS:
        own = own.join(F.broadcast(ends), "id", "left_semi")
    joined = pairs.join(own.select(F.col("id").alias("a"), F.col("sketch").alias("x")), "a").join(own.select(F.col("id").alias("b"), F.col("sketch").alias("y")), "b")
    union = F.slice(F.array_sort(F.array_union("x", "y")), 1, size)
    joined = joined.select("a", "b", "x", "y", union.alias("u"))
    shared = F.size(F.array_intersect(F.array_intersect("u", "x"), "y"))
    likely = checkpointed(joined.where(shared >= F.size("u") * floor_of(percent, size)).select("a", "b"), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = shingle_sets(batch.column(2), words), shingle_sets(batch.column(3), words)
            yield batch.select([0, 1]).filter(pa.array([alike(s, t, percent) for s, t in zip(x, y)], pa.bool_()))

    texts = corpus.texts(_ends(likely, n))
    whole = likely.join(texts.select(F.col("id").alias("b"), F.col("text").alias("t")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("s")), "a")
    return checkpointed(whole.select("a", "b", "s", "t").mapInArrow(run, "a long, b long"), n, FILE_TEXTS)


def incidence(sets: list[np.ndarray], step: int = 4096) -> Iterator[np.ndarray]:
    """Which sets have which values, for the values that two or more have, ``step`` of them at a time."""
    flat = np.concatenate(sets)
    _, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    common = times[at] > 1
    column, owner = (np.cumsum(times > 1) - 1)[at[common]], owner[common]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for a in range(0, int((times > 1).sum()), step):
        i, j = np.searchsorted(column, [a, a + step])
        part = np.zeros((len(sets), step), np.float32)
        part[owner[i:j], column[i:j] - a] = 1
        yield part


def overlaps(first: list[np.ndarray], second: list[np.ndarray] | None) -> np.ndarray:
    """The shared values of each set of ``first`` with each of ``second`` (None: of ``first``), by a product of incidence matrices."""
    n, m = len(first), len(first) + len(second or [])
    lo = 0 if second is None else n
    shared = np.zeros((n, m - lo), np.int64)
    for part in incidence(first + (second or [])):
        shared += (part[:n] @ part[lo:].T).astype(np.int64)
    return shared


def likely(first: list[np.ndarray], second: list[np.ndarray] | None, close: np.ndarray, least: float, size: int) -> np.ndarray:
    """Which of the pairs in ``close`` share enough of the sketch of their union: its values are the ``size`` smallest of both, or all if there are fewer."""
    other = first if second is None else second
    width = max(map(len, other))
    top = np.iinfo(np.int64).max
    padded = np.stack([np.append(s, np.full(width - len(s), top)) for s in other])
    sizes = np.array([len(s) for s in other])
    real = np.arange(width) < sizes[:, None]
    close = close.copy()
    for i in np.flatnonzero(close.any(1)):
        at = np.flatnonzero(close[i])
        own, rows = first[i], padded[at]
        before = np.searchsorted(own, rows)  # values of the first that are smaller
        both = real[at] & (own[np.minimum(before, len(own) - 1)] == rows)
        place = np.arange(width) + before - (np.cumsum(both, 1) - both)  # in the union
        union = np.minimum(len(own) + sizes[at] - both.sum(1), size)
        close[i, at] = (both & (place < size)).sum(1) >= union * least
    return close


def block_links(first: list[np.ndarray], second: list[np.ndarray] | None, percent: int, size: int = SKETCH, apart: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Places of the alike pairs between two blocks, or within one (second: None), of those that are still ``apart``.

    The lists of the sketches' values give overlaps, the estimate from the
    sketch of the union picks the likely pairs, and these are compared on full
    sets; where they are many, by a product of incidence matrices of the sets
    that are in any.
    """
    other = first if second is None else second
    low, low2 = [s[:size] for s in first], None if second is None else [s[:size] for s in second]
    close = overlaps(low, low2) > 0
    if second is None:
        close &= np.tri(len(first), k=-1, dtype=bool).T
    if apart is not None:
        close &= apart
    close = likely(low, low2, close, floor_of(percent, size), size)
    rows, columns = np.flatnonzero(close.any(1)), np.flatnonzero(close.any(0))
    if not len(rows):
        return []
    if close.sum() <= 4 * (len(rows) + len(columns)):
        return [(int(i), int(j)) for i, j in np.argwhere(close) if alike(first[i], other[j], percent)]
    x, y = [first[i] for i in rows], [other[j] for j in columns]
    shared = overlaps(x, y)
    sizes = lambda sets: np.array([len(s) for s in sets])
    alike_ = 100 * shared >= percent * (sizes(x)[:, None] + sizes(y)[None, :] - shared)
    return [(int(rows[i]), int(columns[j])) for i, j in np.argwhere(alike_ & close[np.ix_(rows, columns)])]


def in_blocks(clumps: DataFrame, corpus: Corpus) -> DataFrame:
    """Links across the components ``root`` of the clumps ``id``, ``clump``: their blocks meet two by two, and each meeting returns a spanning forest of its links."""
    words, percent, size = corpus.words, corpus.percent, corpus.size
    n = clumps.count()
    clumps = checkpointed(clumps.join(corpus.reps.select("id", "n"), "id"), n)
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int")
    sizes = checkpointed(clumps.groupBy("clump").agg(blocks.alias("blocks")), n)
    placed = clumps.join(sizes, "clump").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = placed.select("id", "root", "clump", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    met = met.select("id", "root", "clump", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")
    texts = corpus.texts(checkpointed(clumps.select("id").distinct(), n))

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        _, i, j = (x.as_py() for x in key)
        ids, block, root = rows["id"].to_pylist(), rows["block"].to_pylist(), rows["root"].to_numpy()
        sets = shingle_sets(rows["text"], words)
        first = [k for k, b in enumerate(block) if b == i]
        second = [k for k, b in enumerate(block) if b == j] if i != j else None
        other = first if second is None else second
        parent = list(range(len(ids)))

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        if first and other:
            apart = root[first][:, None] != root[other][None, :]
            for x, y in block_links([sets[k] for k in first], None if second is None else [sets[k] for k in second], percent, size, apart):
                x, y = first[x], other[y]
                if find(x) != find(y):
                    parent[find(x)] = find(y)
                    out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return met.join(texts, "id").select("id", "root", "clump", "i", "j", "block", "text").groupBy("clump", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, size: int = SKETCH) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` and ``kept`` for every row of ``df``.

    Linked are documents with 100 * intersection >= percent * union of their
    sets of ``words``-word shingles.  ``component_id`` is the smallest key
    that a document reaches over links, its own included; ``kept`` is true for
    the document with that key.  A text of fewer words is one shingle.  A null
    text, or one without words, has no shingle and links with nothing.  Rows
    with a null key link with nothing, have a null component and are kept.
    Keys are to be unique.  Rows with the same key and text count as one
    document.  Rows with the same key and different texts have each their own
    ``n_shingles`` and equal texts' links; where the key is the smallest of two
    classes of equal sets, the one with the smaller fingerprint finds the links
    of both.  An empty table gives no rows; other columns are not carried.
    """
    spark = df.sparkSession
    bound_batches(spark)
    docs = df.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    every, _ = stored(sketches(docs, words, size), "sketches")
    worded = every.where("n > 0 and id is not null")
    rows = worded.count()
    need = max(1, floor(size * floor_of(percent, size)))

    classes = checkpointed(worded.groupBy("fp").agg(F.min("id").alias("rep")), rows)
    reps = every.join(classes.select("fp", F.col("rep").alias("id")), ["fp", "id"], "left_semi")
    first = F.min_by(F.struct("h", "n", "sketch"), F.struct("fp", "h")).alias("r")
    reps = checkpointed(reps.groupBy("id").agg(first).select("id", "r.*"), rows, FILE_SKETCHES)
    corpus = Corpus(docs, reps, words, percent, size)

    # inverted lists of each sketch's rarest values
    postings = reps.select("id", F.explode("sketch").alias("v"))
    shared = checkpointed(postings.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), rows * size // 2)
    met = postings.join(shared, "v")
    rarest = Window.partitionBy("id").orderBy("c", "v")
    ranked = met.select("id", "v", F.row_number().over(rarest).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("id")).alias("k"))
    sizes = reps.select("id", "n", F.size("sketch").alias("s"))
    least = F.least(F.lit(need), F.ceil(F.col("n") * percent / 100))
    # values that no other document has come first, and take their places
    lists = ranked.join(sizes, "id").where((F.col("s") - F.col("k") + F.col("r")) <= F.col("s") - least + 1).select("v", "id", "n")
    lists = checkpointed(lists, rows * (size - need + 1))
    entries = lists.count()

    fits = "least(n, o) * 100 >= {0} * greatest(n, o)".format(percent)
    heads = lists.groupBy("v").agg(F.min_by("n", "id").alias("o"), F.min("id").alias("a"), F.count(F.lit(1)).alias("len")).where("len > 1")
    heads = checkpointed(heads, entries // 2)
    pairs = lists.join(heads, "v").where("id <> a").where(fits).select("a", F.col("id").alias("b"))
    links = confirm(pairs, corpus, entries)
    roots = checkpointed(components(links, entries), entries)

    # what is left of lists in which more than one component remains
    rest = lists.join(heads, "v").where("id <> a").select("v", "id", "n").join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    rest = checkpointed(rest.select("v", "id", "n", F.coalesce("root", "id").alias("root")), entries)
    mixed = rest.groupBy("v").agg(F.count(F.lit(1)).alias("len"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("id").alias("head")).where("lo <> hi")
    mixed = checkpointed(mixed.select("v", "len", "head"), entries // 2)
    rest = checkpointed(rest.join(mixed, "v"), entries)
    few = rest.where(F.col("len") <= SMALL_LIST)
    other = few.select("v", F.col("id").alias("b"), F.col("n").alias("o"), F.col("root").alias("to"))
    pairs = few.join(other, "v").where("id < b and root <> to").where(fits).select(F.col("id").alias("a"), "b")
    links = links.union(confirm(pairs, corpus, SMALL_LIST * few.count()))
    many = checkpointed(rest.where(F.col("len") > SMALL_LIST).select(F.col("head").alias("a"), F.col("id").alias("b"), "root"), entries)
    if unresolved := many.count():
        clumps = components(many, unresolved).select(F.col("node").alias("id"), F.col("root").alias("clump"))
        of = many.select(F.col("b").alias("id"), "root").distinct()  # the head of a list is in it, and has its own row
        links = links.union(in_blocks(clumps.join(of, "id"), corpus))

    roots = checkpointed(components(links, 3 * entries), rows)
    of_class = classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("root"))
    mine = F.when(F.col("id").isNull(), F.lit(None)).when(F.col("n") > 0, F.col("root")).otherwise(F.col("id"))
    out = every.select("id", "n", "fp").join(of_class, "fp", "left").select("id", "n", mine.alias("component"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
