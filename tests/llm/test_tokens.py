"""Counts and ids against the SentencePiece library, which is told to run the same vocabulary."""

import random
from functools import cache

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from tests.conftest import SF
from tidemark.llm import sentencepiece_scan as scan
from tidemark.llm.queries import PIECES
from tidemark.llm.sentencepiece_scan import decode, encode
from tidemark.llm.tokencount import token_counts
from tidemark.llm.unigram import NONE, UNIT, Segmenter, Vocabulary


@cache
def vocabulary():
    return Vocabulary.read(PIECES)


@cache
def segmenter():
    return Segmenter(vocabulary())


@cache
def library():
    model = sentencepiece_model_pb2.ModelProto()
    with open(PIECES, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1  # unigram
    for i, s in enumerate(vocabulary().scores):
        if s is not None:
            model.pieces[i].score = s / UNIT
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def odd_texts():
    rng = random.Random(1)
    fixed = ["", "  a  b ", " x\n\n y", "日本語 テキスト ☃☃ a", "\n", "   ", "é́ zß", "a\tb", "word" * 3000, " " * 500, "☃" * 200, "á\x00b"]
    return fixed + ["".join(rng.choice("ab \néth日☃") for _ in range(rng.randint(1, 60))) for _ in range(200)]


def test_against_library(spark):
    texts = odd_texts() + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for t in texts:
        want = library().encode(t)
        assert segmenter().encode(t) == want, t[:80]
        assert segmenter().count(t)[0] == len(want)
        assert segmenter().decode(want) == t == library().decode(want)


def test_brute_force_ties():
    """The best score over all segmentations of short texts; of equal ones the last piece that starts first."""
    v = Vocabulary(["<unk>", "▁", "a", "b", "ab", "ba", "aba", "▁a"], [None, -16, -16, -16, -32, -32, -48, -32], [0] * 256)
    m = Segmenter(v)

    def best(t):
        if not t:
            return 0, []
        options = []
        for s in range(len(t)):
            if t[s:] in v.pieces[1:]:
                score, ids = best(t[:s])
                options.append((score + v.scores[v.pieces.index(t[s:])], -s, [*ids, v.pieces.index(t[s:])]))
        score, _, ids = max(options)
        return score, ids

    for n in range(1, 64):
        t = "".join("ab"[n >> i & 1] for i in range(n.bit_length()))
        score, ids = best("▁" + t)
        assert m.encode(t) == ids and m.count(t) == (len(ids), score)


def test_three_searches_agree():
    m = segmenter()
    for part in {p for t in odd_texts() for p in m.segment.findall(m.normalize(t))}:
        best, back = m.forward(part, len(part), {0: 0})
        ids = m.trace(part, back, len(part))[1]
        assert np.frombuffer(m.encode_segment(part), np.int32).tolist() == ids
        assert m.count_segment(part) == (len(ids) << 44) - best[-1]


def chunked(t, size):
    m = segmenter()
    normal, size = m.normalize(t), max(size, m.longest)
    parts = [(normal[a : a + size + m.longest - 1], min(size, len(normal) - a)) for a in range(0, len(normal), size)]
    entry, entries = np.full((1, m.longest), NONE, np.int64), []
    entry[0, 0] = 0
    for p, n in parts:
        entries.append(entry[0].tolist())
        entry = scan.times(entry, scan.transfer(m, p, n))
    state, exits = 0, []
    for (p, n), e in list(zip(parts, entries))[::-1]:
        exits.append(state)
        state = scan._backs(m, p, n, e)[state]
    return [i for (p, n), e, x in zip(parts, entries, exits[::-1]) for i in scan._ids(m, p, n, e, x)]


def test_chunks_give_the_same_ids():
    for t in odd_texts():
        for size in (1, 40):
            assert chunked(t, size) == segmenter().encode(t), t[:80]


def test_matrices_are_associative():
    m = segmenter()
    t = m.normalize("the quick brown fox jumps over the lazy dog and runs away from everything else")
    a, b, c = (scan.transfer(m, t[i : i + 20 + m.longest - 1], 20) for i in (0, 20, 40))
    assert (scan.times(scan.times(a, b), c) == scan.times(a, scan.times(b, c))).all()


def test_queries(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts()) if "\x00" not in t] + [(1000, None), (1001, "a▁b"), (1002, "long words here\n" * 9000), (1002, "long words here\n" * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(0)).repartition(3)
    counts = {r.doc_id: r.n_tokens for r in token_counts(df, vocabulary(), keep=["doc_id"]).collect()}
    got = encode(df, vocabulary(), keep=["doc_id"], giant=1000, chunk=100, verify=True).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        t = texts[r.doc_id] or ""
        assert list(r.ids) == segmenter().encode(t)
        assert counts[r.doc_id] == len(r.ids) and r.round_trip == ("▁" not in t)
    back = decode(spark.createDataFrame([(1, list(got[0].ids)), (2, None), (3, [])], "doc_id long, ids array<int>"), vocabulary()).collect()
    assert [r.decoded for r in back] == [texts[got[0].doc_id] or "", None, ""]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert encode(empty, vocabulary()).collect() == token_counts(empty, vocabulary()).collect() == []


@pytest.mark.parametrize("name", ["the", "▁the", "日"])
def test_pieces(name):
    assert vocabulary().scores[vocabulary().pieces.index(name)] is not None
