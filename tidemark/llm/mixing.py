"""Mixing sources to target weights by Pfair scheduling.

Time is a row of slots, each of which takes one block of rows.  Block j of a
source with weight w is released at floor(j / w) and due at ceil((j + 1) / w);
earliest deadline first then meets every deadline, so that after any number t
of slots a source has had t * w blocks to within less than one.

Weights are taken as they are, as fractions, so the bound holds against the
given weights after any number of slots.  The state of a schedule is how many
blocks each source has had.  The driver walks through the slots and keeps the
state at the beginning of each of at most WINDOWS windows; tasks walk through
the windows again and write the slots.  The place of a row follows by
arithmetic, in DataFrame operations.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, checkpointed
from .ranking import BROADCAST_ROWS, ranked

BLOCK_ROWS = 64
#: Slots of a window at least; schedules that are no longer are written by the driver.
WINDOW_SLOTS = 65_536
#: Windows, at most, of a schedule.
WINDOWS = 4096
_SLOTS = "idx int, block long, phase int, slot long, missing long"


@dataclass
class State:
    """Where a schedule stands: the next slot, its phase, and the blocks that sources had by now and when the phase began."""

    slot: int
    phase: int
    start: int
    had: list[int]
    base: list[int]


@dataclass(frozen=True)
class Schedule:
    """Earliest deadline first over all blocks of all sources; as one runs out, the others go on in proportion to their weights (a new phase)."""

    blocks: list[int]
    weights: list[float]

    @property
    def slots(self) -> int:
        return sum(self.blocks)

    def begin(self) -> State:
        none = [0] * len(self.blocks)
        return State(0, 0, 0, none, list(none))

    def shares(self, base: list[int]) -> tuple[list[int], list[int], int]:
        """The sources of a phase, and their exact weights as whole numbers with their sum; those without a weight come when no other is left."""
        live = [i for i, n in enumerate(self.blocks) if base[i] < n]
        weighed = [i for i in live if self.weights[i] > 0]
        exact = [Fraction(self.weights[i]) for i in weighed] or [Fraction(self.blocks[i]) for i in live]
        scale = lcm(*(w.denominator for w in exact))
        a = [int(w * scale) for w in exact]
        return weighed or live, a, sum(a)

    def run(self, state: State, until: int) -> Iterator[tuple[int, int, int, tuple[int, ...]]]:
        """(source, block, phase, sources that ended before the phase) of each slot before ``until``; the state goes along."""
        until = min(until, self.slots)
        while state.slot < until:
            live, a, q = self.shares(state.base)
            ended = tuple(i for i, n in enumerate(self.blocks) if state.base[i] == n)
            ready: list[tuple[int, int]] = []  # by deadline
            waiting = [((state.had[i] - state.base[i]) * q // w, k) for k, (i, w) in enumerate(zip(live, a))]  # by release
            heapq.heapify(waiting)
            while state.slot < until:
                while waiting and waiting[0][0] <= state.slot - state.start:
                    k = heapq.heappop(waiting)[1]
                    heapq.heappush(ready, (-(-(state.had[live[k]] - state.base[live[k]] + 1) * q // a[k]), k))
                k = heapq.heappop(ready)[1]
                i = live[k]
                yield i, state.had[i], state.phase, ended
                state.had[i] += 1
                state.slot += 1
                if state.had[i] == self.blocks[i]:
                    state.phase, state.start, state.base = state.phase + 1, state.slot, list(state.had)
                    break
                heapq.heappush(waiting, ((state.had[i] - state.base[i]) * q // a[k], k))


def slot_batches(schedule: Schedule, state: State, until: int, short: list[int], rows: int = 65_536) -> Iterator[pa.RecordBatch]:
    """The slots of a window: source, block, phase, slot, and the rows that last blocks before the phase lack (``short``, by source)."""
    held: list[tuple[int, int, int, int, int]] = []
    missing: dict[int, int] = {}
    slot = state.slot

    def out():
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=["idx", "block", "phase", "slot", "missing"])

    for i, block, phase, ended in schedule.run(state, until):
        if phase not in missing:
            missing = {phase: sum(short[x] for x in ended)}
        held.append((i, block, phase, slot, missing[phase]))
        slot += 1
        if len(held) == rows:
            yield out()
            held.clear()
    if held:
        yield out()


def slot_table(spark: SparkSession, schedule: Schedule, short: list[int]) -> DataFrame:
    """All slots, ``_SLOTS``, each once."""
    total = schedule.slots
    if total <= WINDOW_SLOTS:
        batches = list(slot_batches(schedule, schedule.begin(), total, short))
        kinds = pa.schema([("idx", pa.int32()), ("block", pa.int64()), ("phase", pa.int32()), ("slot", pa.int64()), ("missing", pa.int64())])
        return spark.createDataFrame(pa.Table.from_batches(batches, kinds))
    size = max(WINDOW_SLOTS, -(-total // WINDOWS))
    state, states = schedule.begin(), []
    while state.slot < total:
        states.append(deepcopy(state))
        for _ in schedule.run(state, state.slot + size):
            pass
    bound_batches(spark)
    windows = pa.table({"slot": [s.slot for s in states], "phase": [s.phase for s in states], "start": [s.start for s in states], "had": [s.had for s in states], "base": [s.base for s in states]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from slot_batches(schedule, State(**row), row["slot"] + size, short)

    return checkpointed(spark.createDataFrame(windows).repartition(len(states)).mapInArrow(run, _SLOTS))


def mix(df: DataFrame, key: str, source: str, weights: dict | None = None, temperature: float = 0.5, block_rows: int = BLOCK_ROWS, seed: int = 23) -> DataFrame:
    """Put all rows in an order that follows the sources' target weights at every point.

    ``weights`` has a positive weight for each source; without it the weights
    are the row counts to the power ``temperature``.  The rows of a source are
    shuffled by a seed and cut into blocks of ``block_rows``.  While all sources
    last, each has its share of the slots to within less than one block; when
    one runs out, the same holds of the others among themselves (a new phase).
    No row is dropped or repeated.  Sources without a weight come after the
    others, in proportion to their sizes.

    Adds ``block`` (of the source), ``phase``, ``slot`` and ``position`` (long,
    gapless from 0 over all rows).  A null source is a source of its own;
    repeated rows are placed like distinct ones; an empty table gives no rows.
    The driver walks through the slots, one for ``block_rows`` rows (some two
    microseconds each), and holds the sources' counts at each of at most
    WINDOWS points.
    """
    spark = df.sparkSession
    columns = [c for c in df.columns if c not in ("block", "phase", "slot", "position")]
    counted = sorted(df.groupBy(source).count().collect(), key=lambda r: (r[0] is None, r[0]))
    if not counted:
        none = F.lit(None).cast("long")
        return df.select(*[F.col(f"`{c}`") for c in columns], none.alias("block"), none.cast("int").alias("phase"), none.alias("slot"), none.alias("position"))
    given = [r["count"] ** temperature if weights is None else float(weights.get(r[0], 0)) for r in counted]
    schedule = Schedule([-(-r["count"] // block_rows) for r in counted], given)
    slots = slot_table(spark, schedule, [-r["count"] % block_rows for r in counted])
    kind = df.select(source).schema.fields[0].dataType.simpleString()
    names = spark.createDataFrame(pa.table({"source": [r[0] for r in counted], "idx": pa.array(range(len(counted)), pa.int32())}))
    names = names.select(F.col("source").cast(kind).alias("__source"), F.col("idx").alias("__idx"))
    if len(counted) <= BROADCAST_ROWS:
        names = F.broadcast(names)
    if schedule.slots <= BROADCAST_ROWS:
        slots = F.broadcast(slots)
    rows = df.select(*[F.col(f"`{c}`") for c in columns], F.xxhash64(F.lit(seed), F.col(key)).alias("__h"))
    rows = ranked(rows, [F.col("__h"), F.col(key)], group=source, out="__r", total="__n", rows=sum(r["count"] for r in counted))
    rows = rows.withColumn("block", F.expr(f"__r div {block_rows}"))
    rows = rows.alias("r").join(names.alias("s"), F.col(f"r.`{source}`").eqNullSafe(F.col("s.__source")))
    rows = rows.join(slots.alias("t"), (F.col("s.__idx") == F.col("t.idx")) & (F.col("r.block") == F.col("t.block")))
    position = F.expr(f"t.slot * {block_rows} + __r % {block_rows} - t.missing")
    return rows.select(*[F.col(f"r.`{c}`") for c in columns], F.col("r.block").alias("block"), F.col("t.phase").alias("phase"), F.col("t.slot").alias("slot"), position.alias("position"))


def mixed(df: DataFrame, key: str, source: str, position: str | None = None, **options) -> DataFrame:
    """All rows and columns of ``df``, laid out in the order of :func:`mix`; ``position`` names a column for the place in it, which replaces one of that name.

    Places are found on the key and source alone; whole rows move twice, to
    meet their places and to their partitions.  Where rows share key and
    source, null included, whole rows are placed.
    """
    columns, place = [c for c in df.columns if c != position], position or "__position"
    twice = df.groupBy(key, source).count().where("count > 1")
    if twice.isEmpty():
        placed = mix(df.select(key, source), key, source, **options).alias("p")
        on = F.col(f"d.`{key}`").eqNullSafe(F.col(f"p.`{key}`")) & F.col(f"d.`{source}`").eqNullSafe(F.col(f"p.`{source}`"))
        rows = df.alias("d").join(placed, on).select(*[F.col(f"d.`{c}`") for c in columns], F.col("p.position").alias(place))
    else:
        inner = {c: f"__c{i}" for i, c in enumerate(columns)}  # names that mix() adds may be among them
        placed = mix(df.select(*[F.col(f"`{c}`").alias(x) for c, x in inner.items()]), inner[key], inner[source], **options)
        rows = placed.select(*[F.col(x).alias(c) for c, x in inner.items()], F.col("position").alias(place))
    rows = by_place(rows, place, df.count())
    return rows if position else rows.drop(place)


def by_place(df: DataFrame, position: str, rows: int) -> DataFrame:
    """``df`` in the order of ``position``, which runs from 0 to ``rows`` - 1: a place tells its partition, so nothing is sampled."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.expr(f"CAST(`{position}` * {parts} div {max(rows, 1)} AS INT)")
    return df.repartitionById(parts, at).sortWithinPartitions(F.col(f"`{position}`"))
