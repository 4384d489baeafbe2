"""Language identification by mixture inference.

A language is a distribution over hashed letter trigrams, counted over all
training documents.  A document is taken for a mixture: expectation-
maximisation finds the share of each language under which its trigrams are
likeliest, and the set of languages is the one with the best likelihood less
a penalty for each language (Bayesian information criterion).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
SMOOTHING = 0.05
#: Rounds of expectation-maximisation between tests of convergence.
ROUNDS = 8
#: What a log likelihood may lack of its maximum: so much, and so much for each trigram (single precision).
TOLERANCE, PER_TRIGRAM = 0.5, 1e-5
#: Times half the logarithm of the trigrams: trigrams of a text depend on each other, so more than 1.
PENALTY = 4.0
UNDETERMINED = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each trigram around a letter, and its text; what is no letter counts as a word's edge."""
    lowered = [(t or "").lower() for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 2
    points = np.frombuffer(("  ".join(["", *lowered]) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)[1:]
    points = np.where(_letters()[points], points, np.uint32(0))
    middle = np.flatnonzero(points[1:-1]) + 1
    if not len(middle):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    mixed = points[middle - 1] * np.uint32(0x9E3779B1) + points[middle] * np.uint32(0x85EBCA77) + points[middle + 1] * np.uint32(0xC2B2AE3D)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    owner = np.repeat(np.arange(len(sizes)), sizes)[middle - 1]
    return (mixed >> np.uint32(32 - BUCKET_BITS)).astype(np.int64), owner


@dataclass(frozen=True)
class Model:
    languages: list[str]
    likelihood: np.ndarray  # bucket by language


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from all rows with a language.  The driver gets languages x BUCKETS counts at most.

    Null texts, and texts without letters, add nothing but their language's
    name.  Without any row the model has no language.
    """
    bound_batches(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            bucket, owner = trigrams(texts)
            ends = np.searchsorted(owner, np.arange(len(texts) + 1))
            of: dict[str, list[int]] = {}
            for i, name in enumerate(langs):
                of.setdefault(name, []).append(i)
            for name, rows in of.items():
                own = np.concatenate([bucket[ends[i] : ends[i + 1]] for i in rows])
                totals.setdefault(name, np.zeros(BUCKETS, np.int64))
                totals[name] += np.bincount(own, minlength=BUCKETS)
        for name, total in totals.items():
            at = np.flatnonzero(total)
            at = at if len(at) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["lang", "bucket", "n"])

    rows = df.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(count, "lang string, bucket int, n long")
    summed = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(summed.column("lang").to_pylist()))
    counts = np.zeros((BUCKETS, len(names)))
    if names:
        place = {x: i for i, x in enumerate(names)}
        counts[summed.column("bucket").to_numpy(), [place[x] for x in summed.column("lang").to_pylist()]] = summed.column("n").to_numpy()
    return Model(names, ((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * BUCKETS)).astype(np.float32))


def infer(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By text: shares with all languages, shares in the chosen set, and the trigrams.

    The sets tried are the languages of the largest shares, from one up to as
    many as could still be better by the likelihood of all, less the penalty.
    Without letters, all shares are 0.
    """
    n, k = len(texts), len(model.languages)
    whole, chosen = np.zeros((n, k)), np.zeros((n, k))
    bucket, owner = trigrams(texts)
    sizes = np.bincount(owner, minlength=n)
    if not len(bucket) or not k:
        return whole, chosen, sizes
    key, times = np.unique(owner << BUCKET_BITS | bucket, return_counts=True)
    owner, p, times = key >> BUCKET_BITS, model.likelihood[key & (BUCKETS - 1)], times.astype(np.float32)
    docs = np.unique(owner)

    def em(owner, p, times, allowed):
        """Shares, log likelihoods and what these may lack, of the texts 0, 1 .. whose trigrams these are, with the languages ``allowed``.

        A text whose largest factor of a share in a round is g lacks at most
        its trigrams times log g of the maximum: each text goes on until that
        is within the tolerance.
        """
        starts = np.searchsorted(owner, np.arange(len(allowed)))
        shares = allowed / allowed.sum(1, keepdims=True)
        lack = np.full(len(allowed), np.inf)
        going, o, q, t = np.arange(len(allowed)), owner, p, times
        while len(going):
            at = np.searchsorted(o, np.arange(len(going)))
            total = np.add.reduceat(t, at, dtype=np.float64)
            s = shares[going]
            for _ in range(ROUNDS):
                before = s
                r = q * s[o]
                r *= (t / r.sum(1))[:, None]
                s = (np.add.reduceat(r, at, dtype=np.float64) / total[:, None]).astype(np.float32)
            grown = np.divide(s, before, out=np.ones_like(s), where=before > 0).max(1)
            shares[going], lack[going] = s, total * np.log(np.maximum(grown, 1))
            on = lack[going] > TOLERANCE + PER_TRIGRAM * total
            if not on.all():
                rows = on[o]
                o, q, t = (np.cumsum(on) - 1)[o[rows]], q[rows], t[rows]
                going = going[on]
        fits = np.add.reduceat(times * np.log((p * shares[owner]).sum(1)), starts, dtype=np.float64)
        return shares, fits, lack

    dense = np.searchsorted(docs, owner)
    shares, fits, lack = em(dense, p, times, np.ones((len(docs), k), np.float32))
    alone = np.add.reduceat(times[:, None] * np.log(p), np.searchsorted(dense, np.arange(len(docs))), dtype=np.float64)
    fine = PENALTY * 0.5 * np.log(np.maximum(sizes[docs], 2))
    best = alone.max(1)
    picked = np.zeros_like(shares)
    picked[np.arange(len(docs)), alone.argmax(1)] = 1
    order = np.argsort(-shares, axis=1, kind="stable")
    for m in range(2, k + 1):
        # no set of m languages or more is likelier than all of them at their best, and it is fined m - 1 times at least
        open_ = np.flatnonzero(fits + lack - (m - 1) * fine > best)
        if not len(open_):
            break
        allowed = np.zeros((len(open_), k), np.float32)
        np.put_along_axis(allowed, order[open_, :m], 1, 1)
        at = np.flatnonzero(np.isin(dense, open_))
        s, f, _ = em(np.searchsorted(open_, dense[at]), p[at], times[at], allowed)
        better = f - (m - 1) * fine[open_] > best[open_]
        picked[open_[better]], best[open_[better]] = s[better], (f - (m - 1) * fine[open_])[better]
    whole[docs], chosen[docs] = shares, picked
    return whole, chosen, sizes


def recognised(df: DataFrame, model: Model, share: float, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose chosen languages, one or more, have ``share`` together when all languages take part.

    Rows come as they are, with all their columns, whatever their names, and no
    other.  A null text, and one without a letter, has no language and goes.
    """
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, chosen, _ = infer(shared.value, batch.column(at).to_pylist())
            yield batch.filter(pa.array((chosen > 0).any(1) & (np.where(chosen > 0, whole, 0).sum(1) >= share), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def predict(df: DataFrame, model: Model, text: str = "text", keep: list[str | Column] | None = None) -> DataFrame:
    """Add ``lang_pred``, ``score``, ``languages`` and ``proportions`` to the columns ``keep`` (default: all).

    ``lang_pred`` is the language with the largest share in the chosen set
    (ties: the first by name), ``score`` its share when all languages take
    part, and the two arrays are the chosen set and its shares, largest first.
    A null text, one without a letter, or a model without languages gives
    ``und``, 0 and empty arrays.  Whole texts are read, in one pass without a
    shuffle; repeated rows get the same values; a column with one of these
    names is replaced.
    """
    spark = df.sparkSession
    bound_batches(spark)
    added = ["lang_pred", "score", "languages", "proportions"]
    keep = [F.col(f"`{c}`") if isinstance(c, str) else c for c in (df.columns if keep is None else keep)]
    source = df.select(*keep, F.col(text).alias("__text"))
    kept = [f for f in source.schema.fields[:-1] if f.name not in added]
    source = source.select(*[F.col(f"`{f.name}`") for f in kept], "__text")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang_pred string, score double, languages array<string>, proportions array<double>"])
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            whole, chosen, _ = infer(m, batch.column(len(kept)).to_pylist())
            names, scores, sets, shares = [], [], [], []
            for row, all_ in zip(chosen, whole):
                at = [int(i) for i in np.argsort(-row, kind="stable") if row[i] > 0]
                names.append(m.languages[at[0]] if at else UNDETERMINED)
                scores.append(min(1.0, float(all_[at[0]])) if at else 0.0)
                sets.append([m.languages[i] for i in at])
                shares.append([float(row[i]) for i in at])
            yield pa.RecordBatch.from_arrays(
                batch.columns[: len(kept)] + [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                names=[f.name for f in kept] + added,
            )

    return source.mapInArrow(run, schema)
