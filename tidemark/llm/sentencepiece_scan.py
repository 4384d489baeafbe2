"""SentencePiece encoding and decoding, with giant texts cut into chunks.

A piece that starts in a chunk may reach up to ``longest - 1`` characters into
the next one, so what passes a boundary is a state: how far beyond it the next
piece starts.  In the max-plus algebra a chunk is a matrix of best scores from
entry state to exit state, and matrices combine associatively.  From them each
chunk gets the scores of its entry states; then it knows by itself, for each
exit state, the entry state that the best path comes from; these maps combine
from the last chunk back; and each chunk writes its own ids.  Scores are whole
numbers, so the result is that of one run over the whole text.

Chunks of a text are cut by SQL functions and dealt out to all workers, and the
two scans go by levels: runs of FAN elements combine to one element each, the
scan of these gives every run its first state, and each run goes on by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, checkpointed
from .ranking import BROADCAST_ROWS
from .unigram import NONE, SPACE, Segmenter, Vocabulary, worker_segmenter

#: Texts of more characters are cut.
GIANT = 65_536
CHUNK = 16_384
#: Elements of a scan that one task combines.
FAN = 64
#: Chunks for which a task is worth while; giant texts, and chunks, in one file of a checkpoint.
TASK_CHUNKS, FILE_TEXTS, FILE_CHUNKS = 16, 64, 64


def transfer(model: Segmenter, part: str, size: int) -> np.ndarray:
    """The chunk's matrix: ``part`` is its ``size`` characters and those of the next chunk that a piece may reach."""
    states = model.longest
    out = np.full((states, states), NONE, np.int64)

    def leave(best: list[int], offset: int, row: np.ndarray) -> None:
        for j in range(min(states, len(best) - (size - offset))):
            row[j] = best[size - offset + j]

    cut = _cut(model, part, size)
    if cut is None:  # each entry state goes all the way
        for i in range(min(states, size + 1)):
            leave(model.forward(part, size, {i: 0})[0], 0, out[i])
        return out
    rest = np.full(states, NONE, np.int64)
    leave(model.forward(part[cut:], size - cut, {0: 0})[0], cut, rest)
    for i in range(min(states, cut + 1)):
        head = model.forward(part[:cut], cut, {i: 0})[0][cut]
        if head != NONE:
            out[i] = np.where(rest == NONE, NONE, head + rest)
    return out


def _cut(model: Segmenter, part: str, size: int) -> int | None:
    """The first place beyond all entry states that every path goes through."""
    m = model.cuts.search(part, model.longest) if model.cuts else None
    return m.start() if m and m.start() < size else None


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product, which is associative."""
    total = np.where((a[..., :, :, None] == NONE) | (b[..., None, :, :] == NONE), NONE, a[..., :, :, None] + b[..., None, :, :])
    return total.max(-2)


@dataclass(frozen=True)
class Action:
    """How an element acts on a state, and how two elements, one after the other, make one; both are flat lists of whole numbers."""

    first: list[int]
    act: Callable[[np.ndarray, np.ndarray], np.ndarray]
    join: Callable[[np.ndarray, np.ndarray], np.ndarray]


def _square(x: np.ndarray) -> np.ndarray:
    return x.reshape(int(len(x) ** 0.5), -1)


def scores(states: int) -> Action:
    """Scores of the entry states; an element is a chunk's matrix."""
    return Action([0] + [NONE] * (states - 1), lambda e, m: times(e[None, :], _square(m))[0], lambda a, b: times(_square(a), _square(b)).ravel())


#: The state in which the best path passes a boundary, from the last one back; an element is a chunk's map from exit to entry states.
PATHS = Action([0], lambda e, m: m[e], lambda a, b: np.where(a >= 0, b[a], -1))


def scanned(elements: DataFrame, action: Action, longest: int) -> DataFrame:
    """``row``, ``at`` and ``state``: what the elements ``row``, ``at`` (from 0, ``longest`` at most), ``m`` before it make of each row's first state."""
    out = "row long, at long, state array<bigint>"

    def walk(rows: pa.Table, state: np.ndarray) -> pa.Table:
        order = np.argsort(rows["at"].to_numpy())
        states, ms = [], rows["m"].combine_chunks()
        for k in order:
            states.append(state.tolist())
            state = action.act(state, np.array(ms[int(k)].as_py(), np.int64))
        return pa.table({"row": rows["row"].take(pa.array(order)), "at": rows["at"].take(pa.array(order)), "state": pa.array(states, pa.list_(pa.int64()))})

    if longest <= FAN:
        return elements.groupBy("row").applyInArrow(lambda key, rows: walk(rows, np.array(action.first, np.int64)), out)

    def joined(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        order, ms = np.argsort(rows["at"].to_numpy()), rows["m"].combine_chunks()
        total = np.array(ms[int(order[0])].as_py(), np.int64)
        for k in order[1:]:
            total = action.join(total, np.array(ms[int(k)].as_py(), np.int64))
        return pa.table({"row": pa.array([key[0].as_py()], pa.int64()), "at": pa.array([key[1].as_py()], pa.int64()), "m": pa.array([total.tolist()], pa.list_(pa.int64()))})

    runs = elements.withColumn("run", F.expr(f"at div {FAN}"))
    above = checkpointed(runs.groupBy("row", "run").applyInArrow(joined, "row long, at long, m array<bigint>"))
    begun = scanned(above, action, -(-longest // FAN)).select("row", F.col("at").alias("run"), F.col("state").alias("begin"))
    whole = runs.join(begun, ["row", "run"])
    return whole.groupBy("row", "run").applyInArrow(lambda key, rows: walk(rows, np.array(rows["begin"][0].as_py(), np.int64)), out)


def _backs(model: Segmenter, part: str, size: int, entry: list[int]) -> list[int]:
    """By exit state, the entry state that the best path comes from; -1 if there is none."""
    best, back = model.forward(part, size, {i: s for i, s in enumerate(entry) if s != NONE and i <= len(part)})
    out = []
    for j in range(model.longest):
        at = size + j
        out.append(model.trace(part, back, at)[0] if at < len(best) and best[at] != NONE else -1)
    return out


def _ids(model: Segmenter, part: str, size: int, entry: list[int], exit_: int) -> list[int]:
    _, back = model.forward(part, size, {i: s for i, s in enumerate(entry) if s != NONE and i <= len(part)})
    return model.trace(part, back, size + exit_)[1]


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[str] | None = None, giant: int = GIANT, chunk: int = CHUNK, verify: bool = False) -> DataFrame:
    """Add ``ids`` (array of int) to the columns ``keep`` (default: all); with ``verify`` also ``round_trip``.

    Texts up to ``giant`` characters are encoded by one worker each, segment by
    segment; longer ones in chunks of ``chunk`` characters by any number of
    workers, with the same ids.  ``round_trip`` says whether decoding gives the
    text again; it does unless the text holds the space mark U+2581 itself.  A
    null or empty text has no ids.  Repeated rows are encoded like distinct
    ones; a column with one of these names is replaced.
    """
    spark = df.sparkSession
    bound_batches(spark)
    added = ["ids"] + (["round_trip"] if verify else [])
    keep = [c for c in (df.columns if keep is None else keep) if c not in added]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    schema = ", ".join([*([kept] if kept else []), "ids array<int>"] + (["round_trip boolean"] if verify else []))
    shared = spark.sparkContext.broadcast(vocabulary)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_segmenter(shared)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            ids = model.encode_all(texts)
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            made = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))]
            if verify:
                made.append(pa.array([model.decode(i.tolist()) == t for i, t in zip(ids, texts)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(batch.columns[: len(keep)] + made, names=keep + added)

    is_long = F.coalesce(F.char_length("__text") > giant, F.lit(False))
    short = source.where(~is_long).mapInArrow(whole, schema)
    size = max(chunk, vocabulary.longest)
    of_text = F.ceil((F.char_length("__text") + 1) / F.lit(size))
    giants = source.where(is_long)
    many = giants.agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum(of_text), F.lit(0)).alias("chunks"), F.coalesce(F.max(of_text), F.lit(0)).alias("longest")).first()
    if not many.texts:
        return short
    tasks = -(-many.chunks // TASK_CHUNKS)
    # a shuffle, so that the scan for them keeps its tasks
    rows = checkpointed(giants.withColumn("__row", F.monotonically_increasing_id()).repartition(-(-many.texts // FILE_TEXTS)))

    # characters are counted from a string's beginning: runs of chunks are cut first, and chunks from these
    mark = F.lit(SPACE if vocabulary.prefix else "")
    normal = rows.select(F.col("__row").alias("row"), F.concat(mark, F.translate("__text", " ", SPACE)).alias("t"))
    reach = vocabulary.longest - 1
    runs = normal.select("row", F.expr(f"posexplode(transform(sequence(0, (char_length(t) - 1) div {FAN * size}), i -> substring(t, i * {FAN * size} + 1, {FAN * size + reach})))").alias("run", "t"), F.char_length("t").alias("n"))
    runs = runs.select("row", "run", "t", F.least(F.lit(FAN * size), F.col("n") - F.col("run") * (FAN * size)).alias("n")).repartition(max(1, -(-tasks // FAN) * TASK_CHUNKS))
    cut = runs.select("row", "run", F.expr(f"posexplode(transform(sequence(0, (n - 1) div {size}), i -> substring(t, i * {size} + 1, {size + reach})))").alias("k", "part"), "n")
    cut = cut.select("row", (F.col("run") * FAN + F.col("k")).cast("long").alias("chunk"), "part", F.least(F.lit(size), F.col("n") - F.col("k") * size).cast("int").alias("size"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_segmenter(shared)
        for batch in batches:
            made = [transfer(model, p, n).ravel().tolist() for p, n in zip(batch.column("part").to_pylist(), batch.column("size").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.int64()))], names=["row", "chunk", "part", "size", "m"])

    chunks = checkpointed(cut.repartition(tasks).mapInArrow(matrices, "row long, chunk long, part string, size int, m array<bigint>"))
    entries = scanned(chunks.select("row", F.col("chunk").alias("at"), "m"), scores(vocabulary.longest), many.longest)
    entries = entries.select("row", F.col("at").alias("chunk"), F.col("state").alias("entry"))
    seeded = checkpointed(chunks.drop("m").join(entries, ["row", "chunk"]), many.chunks, FILE_CHUNKS)

    def backs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_segmenter(shared)
        for batch in batches:
            made = [_backs(model, p, s, e) for p, s, e in zip(*(batch.column(c).to_pylist() for c in ("part", "size", "entry")))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("chunk"), pa.array(made, pa.list_(pa.int64()))], names=["row", "chunk", "m"])

    maps = seeded.repartition(tasks).mapInArrow(backs, "row long, chunk long, m array<bigint>")
    last = F.broadcast(seeded.groupBy("row").agg(F.max("chunk").alias("last"))) if many.texts <= BROADCAST_ROWS else seeded.groupBy("row").agg(F.max("chunk").alias("last"))
    turned = maps.join(last, "row").select("row", (F.col("last") - F.col("chunk")).alias("at"), "m")
    exits = scanned(turned, PATHS, many.longest).join(last, "row").select("row", (F.col("last") - F.col("at")).alias("chunk"), F.col("state")[0].cast("int").alias("exit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_segmenter(shared)
        for batch in batches:
            made = [_ids(model, p, s, e, x) for p, s, e, x in zip(*(batch.column(c).to_pylist() for c in ("part", "size", "entry", "exit")))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("chunk"), pa.array(made, pa.list_(pa.int32()))], names=["__row", "chunk", "ids"])

    written = seeded.join(exits, ["row", "chunk"]).repartition(tasks).mapInArrow(write, "__row long, chunk long, ids array<int>")
    joined = written.groupBy("__row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("ids"))
    found = rows.join(joined, "__row").select(*[F.col(f"`{c}`") for c in keep], "__text", "ids")
    if not verify:
        return short.union(found.drop("__text"))
    checked = decode(found, vocabulary, keep=[*keep, "__text", "ids"])
    return short.union(checked.select(*[F.col(f"`{c}`") for c in keep], "ids", F.col("decoded").eqNullSafe(F.col("__text"))))


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Add ``decoded``, the text of ``ids``, to the columns ``keep`` (default: all).

    Null ids give null; ids that stand for no text (control pieces) give none;
    bytes that form no UTF-8 give the replacement character.
    """
    spark = df.sparkSession
    bound_batches(spark)
    keep = [c for c in (df.columns if keep is None else keep) if c != "decoded"]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(ids).alias("__ids"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + ["decoded string"])
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_segmenter(shared)
        for batch in batches:
            texts = [None if i is None else model.decode(i) for i in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(batch.columns[: len(keep)] + [pa.array(texts, pa.string())], names=[*keep, "decoded"])

    return source.mapInArrow(run, schema)
