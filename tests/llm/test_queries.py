"""Each registered query over a whole small table, against its SQL or brute force."""

import math
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.test_native import brute_edf
from tests.llm.test_texts import brute_kept, brute_lm, brute_quality
from tests.llm.test_tokens import library, segmenter
from tidemark.llm import queries
from tidemark.llm.mixing import BLOCK_ROWS

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return {r.doc_id: r for r in QUERIES[name](spark, SF).collect()}


def test_names():
    assert sorted({n.split("_")[0] for n in QUERIES}) == sorted(f"op{n}" for n in range(1, 11)) and SQL.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got, want = QUERIES[name](spark, SF), con.sql(SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    at = [want.columns.index(c) for c in order]
    rows = sorted((tuple(r[c] for c in order) for r in got.collect()), key=repr)
    assert rows and rows == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_languages(spark, docs):
    got = run(spark, "op1_langid")
    assert got.keys() == docs.keys()
    learned = {r.lang for k, r in docs.items() if r.lang and zlib.crc32(str(k).encode()) % 4 != 2}
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.lang_pred in learned if any(c.isalpha() for c in docs[k].text or "") else r.lang_pred == "und"
    held = [(r.lang_pred, docs[k].lang) for k, r in got.items() if r.held_out and docs[k].lang]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) > 0


def test_counts_and_ids(spark, docs):
    counts, ids = run(spark, "op4_token_counts"), run(spark, "op6_sentencepiece")
    assert counts.keys() == ids.keys() == docs.keys()
    for k, d in docs.items():
        want = library().encode(d.text or "")
        assert list(ids[k].ids) == want and ids[k].n_tokens == counts[k].n_tokens == len(want) and ids[k].round_trip
        assert segmenter().decode(want) == (d.text or "")


def test_language_model(spark, docs):
    keys = sorted(docs)
    train = [docs[k].text for k in keys if zlib.crc32(str(k).encode()) % 7 != 2]
    want, _ = brute_lm(train, [docs[k].text for k in keys])
    got = run(spark, "op5_lm")
    for k, (tokens, known, n, base, score) in zip(keys, want):
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


def test_shards(spark, docs):
    got = run(spark, "op7_sharding")
    by, total = defaultdict(list), Counter(d.source for d in docs.values())
    for k, r in got.items():
        raw = (docs[k].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        by[r.shard].append(r)
    assert len(got) == len(docs) and sorted(by) == list(range(16))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert all(abs(sum(docs[r.doc_id].source == s for r in rows) - n / 16) <= 2 for s, n in total.items())


def test_quality(spark, docs):
    squeeze = zstandard.ZstdCompressor(level=3).compress
    got = run(spark, "op8_quality")
    assert got.keys() == docs.keys()
    for k, r in got.items():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(docs[k].text)
        assert r.kept == brute_kept(docs[k].text, squeeze)


def test_mixing(spark, docs):
    got = sorted(run(spark, "op9_mixing").values(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(docs)))
    counts = Counter(d.source for d in docs.values())
    names = sorted(counts, key=lambda x: (x is None, x))
    weights = [Fraction(math.sqrt(counts[n])) for n in names]
    scale = math.lcm(*(w.denominator for w in weights))
    whole = [int(w * scale) for w in weights]
    first = brute_edf(whole, sum(whole), 10**6, [-(-counts[n] // BLOCK_ROWS) for n in names])
    blocks = list(dict.fromkeys((r.slot, r.source, r.block) for r in got))
    assert [(names.index(s), b) for _, s, b in blocks[: len(first)]] == first


def test_neighbours(spark):
    rows = QUERIES["op10_ann"](spark, SF).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last")).collect()
    assert rows and all((r.n, r.last) == (20, 20) and r.query_id % 20 == 0 for r in rows)
