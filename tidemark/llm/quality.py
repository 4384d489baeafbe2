"""Quality rules: word and line rules, then compression bands.

A text's zstandard ratio (compressed to raw bytes) is taken over the whole
text and over fixed chunks of it.  Repetitive text compresses far below, and
noise far above, what prose of the same length does, so each length class has
its own band.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bound_batches, mix, text_buffer, word_hashes


@dataclass(frozen=True)
class Band:
    """For texts of ``at_least`` bytes: the ratios that are kept."""

    at_least: int
    low: float
    high: float


#: Short texts hardly compress, so the limits widen as texts get shorter.
BANDS = (Band(0, 0.0, 9.9), Band(128, 0.28, 1.02), Band(512, 0.25, 0.85), Band(2048, 0.20, 0.72), Band(16384, 0.15, 0.70))
CHUNK_BYTES = 4096
#: The share of chunks outside their band from which a text is rejected.
BAD_CHUNKS = 0.5
LEVEL = 3
MIN_WORDS = 20
WINDOW_WORDS = 8
MAX_REPEAT_PERCENT = 30

_IS_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, chunk_ratio_min double, chunk_ratio_max double, n_chunks long, n_bad_chunks long, rest_ratio double, rest_bad boolean, kept boolean"


def repeat_words(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """By text: words that stand in a window of WINDOW_WORDS words found twice or more in it, the first one included.

    Words are 64-bit hashes; windows of all texts are told apart in one go.
    """
    ends = np.cumsum(sizes)
    out = np.zeros(len(sizes), np.int64)
    if len(hashes) < WINDOW_WORDS:
        return out
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(np.arange(len(hashes)) + WINDOW_WORDS <= ends[owner])
    window = mix(owner[at].astype(np.uint64))
    for i in range(WINDOW_WORDS):
        window = mix(window * np.uint64(0xD6E8FEB86659FD93) + hashes[at + i])
    _, which, times = np.unique(window, return_inverse=True, return_counts=True)
    again = at[times[which] > 1]
    steps = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(steps, again, 1)
    np.add.at(steps, again + WINDOW_WORDS, -1)
    np.add.at(out, owner[np.cumsum(steps[:-1]) > 0], 1)
    return out


def dup_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = raw.split(b"\n")
    if len(lines) == len(set(lines)):
        return 0
    worded = [x for x in lines if x.strip(b" \t\n\v\f\r")]
    return len(worded) - len(set(worded))


def band(size: int, bands: tuple[Band, ...] = BANDS) -> Band:
    return max((b for b in bands if size >= b.at_least), key=lambda b: b.at_least)


def verdict(raw: bytes, squeeze, bands: tuple[Band, ...], chunk_bytes: int) -> tuple:
    """``ratio`` and what follows it in SCHEMA, for one whole text that passes the base rules."""
    ratio = len(squeeze(raw)) / len(raw) if raw else 1.0
    limits = band(len(raw), bands)
    kept = limits.low <= ratio <= limits.high
    ratios, bad, rest, rest_bad = [], 0, None, False
    starts = list(range(0, len(raw), chunk_bytes))
    if len(starts) > 1 and len(raw) - starts[-1] < min((b.at_least for b in bands if b.at_least), default=0):
        starts.pop()  # too short for a band of its own: part of the chunk before it
    for at, upto in zip(starts, [*starts[1:], len(raw)]):
        part = raw[at:upto]
        r = ratio if len(part) == len(raw) else len(squeeze(part)) / len(part)
        limits = band(len(part), bands)
        out = not limits.low <= r <= limits.high
        if len(part) < chunk_bytes and at:  # the rest of a longer text
            rest, rest_bad = r, out
        else:
            ratios.append(r)
            bad += out
    kept = kept and bad + rest_bad < max(1, BAD_CHUNKS * (len(ratios) + (rest is not None)))
    return ratio, min(ratios, default=None), max(ratios, default=None), len(ratios), bad, rest, rest_bad, kept


def measures(column: pa.Array, squeeze, bands: tuple[Band, ...] = BANDS, chunk_bytes: int = CHUNK_BYTES) -> list[tuple]:
    """The values of SCHEMA for whole texts; ``squeeze`` compresses bytes."""
    data, at = text_buffer(column)
    hashes, sizes = word_hashes(column, lower=False)
    by_text = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at])
    chars = by_text(~SPACE[data] & ((data & 0xC0) != 0x80))
    symbols = by_text(_IS_SYMBOL[data])
    repeated = repeat_words(hashes, sizes)
    failed = (sizes < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * sizes)
    out = []
    for i, row in enumerate(zip(sizes.tolist(), chars.tolist(), symbols.tolist())):
        raw = data[at[i] : at[i + 1]].tobytes()
        judged = verdict(raw, squeeze, bands, chunk_bytes)
        out.append((*row, dup_lines(raw), int(repeated[i]), bool(failed[i]), *judged[:-1], judged[-1] and not failed[i]))
    return out


def quality(df: DataFrame, text: str = "text", keep: list[str] | None = None, bands: tuple[Band, ...] = BANDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The columns ``keep`` (default: all of ``df``), then those of SCHEMA, for every row.

    Every whole text is read, in one pass and without a shuffle.  A null text
    counts as empty: no words, base_failed, not kept.  Texts under MIN_WORDS
    words, or with over MAX_REPEAT_PERCENT percent of their words in repeated
    windows, fail the base rules; the others are kept if the whole text's ratio
    is within the band of its length and fewer than BAD_CHUNKS of its chunks
    are outside theirs.  What is left of a text after its full chunks is a
    chunk too, under the band of its own length; its ratio has columns of its
    own, and the others are of full chunks (or of a text shorter than one).
    A rest that is too short for a band with limits (128 bytes) belongs to the
    chunk before it.  Repeated rows get the same values.  A column of
    ``df`` with the name of a measure is replaced.
    """
    bound_batches(df.sparkSession)
    own = [f.split()[0] for f in SCHEMA.split(", ")]
    keep = [c for c in (df.columns if keep is None else keep) if c not in own]
    carried = keep.index(text) if text in keep else len(keep)  # a text that is kept goes out once
    source = df.select(*[F.col(f"`{c}`") for c in keep], *([] if carried < len(keep) else [F.col(f"`{text}`").alias("__text")]))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)]] + [SCHEMA])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        types = [pa.int64()] * 5 + [pa.bool_()] + [pa.float64()] * 3 + [pa.int64()] * 2 + [pa.float64()] + [pa.bool_()] * 2
        for batch in batches:
            columns = list(zip(*measures(batch.column(carried), squeeze, bands, chunk_bytes))) or [[]] * len(own)
            yield pa.RecordBatch.from_arrays(batch.columns[: len(keep)] + [pa.array(c, t) for c, t in zip(columns, types)], names=keep + own)

    return source.mapInArrow(run, schema)


def passed(df: DataFrame, text: str = "text", bands: tuple[Band, ...] = BANDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of ``df`` that :func:`quality` keeps, as they are: all their columns, whatever their names, and no other."""
    bound_batches(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            yield batch.filter(pa.array([m[-1] for m in measures(batch.column(at), squeeze, bands, chunk_bytes)], pa.bool_()))

    return df.mapInArrow(run, df.schema)
