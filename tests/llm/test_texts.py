"""Rules, languages, near duplicates and the language model against plain Python."""

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.llm import langid, lm
from tidemark.llm.common import word_hashes
from tidemark.llm.components import components
from tidemark.llm.neardup import SMALL_LIST, block_links, near_duplicates, shingle_sets
from tidemark.llm.quality import CHUNK_BYTES, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = [None, "", " ", "\n\t", "a", "a b", "É é x", "x" * 300_000, "w " * 50_000, "ÀB\x0bcd\x0ce", "line\nline\n\nline\n \nother"]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sample(spark, n=120):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(n).select("doc_id", "text", "lang").collect()]
    return rows + [(10_000 + i, t, None) for i, t in enumerate(EDGES)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = sample(spark)
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)


def test_word_hashes():
    texts = ["Foo bar  foo", None, "", "x" * 200_000 + " y", "É É é", " \n", "a\x0bb"]
    hashes, sizes = word_hashes(pa.array(texts))
    words = [WORD.findall(lower(t or "")) for t in texts]
    assert sizes.tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len({(h, w) for h, w in zip(hashes.tolist(), flat)}) == len(set(flat)) == len(set(hashes.tolist()))
    part, _ = word_hashes(pa.array(texts).slice(3, 2))
    assert part.tolist() == hashes[3:8].tolist()


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dups = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dups += x in seen
            seen.add(x)
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    hit = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words)


def brute_kept(text, squeeze):
    """The verdict in plain steps: base rules, the whole text's band, the bands of its parts of 4,096 bytes."""
    raw = (text or "").encode()
    if brute_quality(text)[-1]:
        return False
    limits = {0: (0.0, 9.9), 128: (0.28, 1.02), 512: (0.25, 0.85), 2048: (0.20, 0.72), 16384: (0.15, 0.70)}

    def out(part):
        low, high = limits[max(n for n in limits if n <= len(part))]
        return not low <= len(squeeze(part)) / len(part) <= high

    parts = [raw[i : i + 4096] for i in range(0, len(raw), 4096)]
    if len(parts) > 1 and len(parts[-1]) < 128:
        parts[-2:] = [parts[-2] + parts[-1]]
    return not out(raw) and 2 * sum(map(out, parts)) < max(2, len(parts))


def test_quality(docs):
    rows, df = docs
    got = {r.doc_id: r for r in quality(df.withColumn("kept", F.lit("x")), keep=["doc_id", "kept"]).collect()}
    assert len(got) == len(rows)
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for key, text, _ in rows:
        r = got[key]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(text)
        assert r.kept == brute_kept(text, squeeze)
        raw = (text or "").encode()
        if raw:
            assert r.ratio == len(squeeze(raw)) / len(raw)
            assert r.n_chunks == max(1, len(raw) // CHUNK_BYTES)


def test_compression_bands(spark):
    rng = random.Random(1)
    prose = " ".join(rng.choice("the of and cat tree house river green walks under over many small words about nothing here".split()) + rng.choice(["", "s", "ed", "ing", "ly"]) + rng.choice(["", ",", "."]) for _ in range(900))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    noise = " ".join("".join(rng.choice(letters) for _ in range(60)) for _ in range(200))
    pairs = " ".join(f"{a} {a}" for a in range(100, 115) for _ in range(3)) * 1
    stutter = " ".join(x for w in ("alpha", "beta", "gamma", "delta", "kappa", "sigma", "omega") for x in [w] * 7) + " " + " ".join(x for w in ("uno", "dos", "tres", "cinco") for x in [w] * 7)
    rows = [(0, prose), (1, noise), (2, stutter), (3, pairs)]
    got = {r.doc_id: r for r in quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].kept and not got[1].kept and not got[1].base_failed
    assert not got[2].kept and not got[2].base_failed
    assert quality(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_junk_in_the_second_half(spark):
    """The rest of a text after its full chunks is judged like them."""
    rng = random.Random(5)
    words = "the of and cat tree house river green walks under over many small words about nothing here".split()
    prose = "".join(" " + rng.choice(words) + rng.choice(["", "s", "ed", "ing", "ly"]) + rng.choice(["", ",", "."]) for _ in range(3000))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    noise = " ".join("".join(rng.choice(letters) for _ in range(76)) for _ in range(60))[:3900]
    spam = " ".join(f"buy cheap pills now {i}" for i in range(300))[:3900]
    halves = [prose[:4096] + x for x in (noise, spam, prose[5000:8900])] + [prose[:12288] + noise, prose[:4097]]
    got = {r.doc_id: r for r in quality(spark.createDataFrame(list(enumerate(halves)), "doc_id long, text string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [got[i].kept for i in range(5)] == [False, False, True, True, True]
    assert [got[i].rest_bad for i in range(5)] == [True, True, False, True, False]
    assert [(got[i].n_chunks, got[i].n_bad_chunks) for i in range(5)] == [(1, 0), (1, 0), (1, 0), (3, 0), (1, 0)]


def test_more_languages_than_four():
    """Mixtures of up to seven of nine languages are found whole, as one text is in one language."""
    rng = np.random.default_rng(3)
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9))) for _ in range(150)] for _ in range(9)]
    prose = lambda i, n: " ".join(rng.choice(words[i], n))
    counts = np.stack([np.bincount(langid.trigrams([prose(i, 4000)])[0], minlength=langid.BUCKETS) for i in range(9)], 1)
    model = langid.Model([f"l{i}" for i in range(9)], ((counts + langid.SMOOTHING) / (counts.sum(0) + langid.SMOOTHING * langid.BUCKETS)).astype(np.float32))
    sets = [[2], [0, 8], [1, 4, 6], [0, 2, 3, 5, 7], [1, 2, 3, 4, 5, 6, 8]]
    whole, chosen, _ = langid.infer(model, [" ".join(prose(i, 250) for i in x) for x in sets])
    for row, x in zip(chosen, sets):
        assert np.flatnonzero(row).tolist() == x
        assert np.allclose(row[x], 1 / len(x), atol=0.05)


def test_languages(spark, docs):
    rows, df = docs
    df = df.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    model = langid.fit(df.where(~F.col("held_out")))
    assert model.languages == sorted({r[2] for r in rows if r[2]})
    got = {r.doc_id: r for r in langid.predict(df.withColumn("score", F.lit(7)), model, keep=["doc_id", "lang", "held_out"]).collect()}
    assert len(got) == len(rows)
    for key, text, lang in rows:
        r = got[key]
        assert r.held_out == (zlib.crc32(str(key).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        assert r.lang_pred == "und" or math.isclose(sum(r.proportions), 1, rel_tol=1e-5)
    held = [r for r in got.values() if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_mixture_by_brute_force(spark, docs):
    """Shares of a text of two languages, by plain EM over its trigrams."""
    rows, df = docs
    model = langid.fit(df)
    by = {lang: next(t for _, t, x in rows if x == lang and len(t) > 1500) for lang in model.languages}
    a, b = sorted(by)[:2]
    text = by[a][:900] + "\n" + by[b][:900]
    bucket, owner = langid.trigrams([text])
    assert set(owner) == {0}
    p = model.likelihood[bucket].astype(float)
    shares = np.full(len(model.languages), 1 / len(model.languages))
    for _ in range(langid.ROUNDS):
        r = p * shares
        shares = (r / r.sum(1, keepdims=True)).mean(0)
    whole, chosen, _ = langid.infer(model, [text, None, by[a]])
    assert np.allclose(whole[0], shares, atol=1e-3)
    assert {model.languages[i] for i in np.flatnonzero(chosen[0])} == {a, b}
    assert chosen[1].sum() == 0 and model.languages[chosen[2].argmax()] == a


def test_chosen_set_by_brute_force(spark, docs):
    """The set that a text gets is the best of all sets, by plain EM and the same penalty, and is in its own order of shares."""
    rows, df = docs
    model = langid.fit(df)
    k = len(model.languages)
    by = {lang: [t for _, t, x in rows if x == lang and len(t or "") > 600] for lang in model.languages}
    names = sorted(by)
    texts = [by[n][0] for n in names] + [by[a][0][:500] + "\n" + by[b][0][:500] for a, b in combinations(names, 2)] + ["\n".join(by[n][0][:400] for n in names[:3])]
    _, chosen, sizes = langid.infer(model, texts)
    for text, row, size in zip(texts, chosen, sizes):
        bucket, _ = langid.trigrams([text])
        p, best = model.likelihood[bucket].astype(float), []
        for m in range(1, k + 1):
            for some in combinations(range(k), m):
                q, shares = p[:, some], np.full(m, 1 / m)
                for _ in range(400):
                    r = q * shares
                    shares = (r / r.sum(1, keepdims=True)).mean(0)
                best.append((np.log(q @ shares).sum() - m * langid.PENALTY * 0.5 * math.log(size), some))
        assert tuple(np.flatnonzero(row)) == max(best)[1]


def test_repeated_rows_and_ties(spark):
    df = spark.createDataFrame([(1, "abc abc", "x"), (1, "abc abc", "x"), (2, "abc abc", "y"), (2, "abc abc", "y")], "doc_id long, text string, lang string")
    got = langid.predict(df, langid.fit(df)).collect()
    assert {(r.lang_pred, tuple(r.languages)) for r in got} == {("x", ("x",))}  # of equal ones, the first by name
    assert len({tuple(r)[1:] for r in quality(df, keep=["doc_id"]).collect()}) == 1


def test_no_language(spark):
    df = spark.createDataFrame([(1, "text"), (2, None)], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    model = langid.fit(df)
    assert model.languages == [] and {r.lang_pred for r in langid.predict(df, model).collect()} == {"und"}


def brute_sets(texts, n):
    out = []
    for t in texts:
        w = WORD.findall(lower(t or ""))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def brute_components(ids, sets, percent):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in combinations(zip(ids, sets), 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i in ids}


def near_rows(seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows, n = [(10_000 + i, t) for i, t in enumerate(EDGES)], 0

    def add(ws):
        nonlocal n
        rows.append((n, " ".join(ws)))
        n += 1

    base = [rng.choice(words) for _ in range(150)]
    for _ in range(SMALL_LIST + 60):  # one large group, some of it too far off
        copy = list(base)
        for _ in range(rng.choice((1, 3, 8, 12, 16, 20))):
            copy[rng.randrange(150)] = rng.choice(words)
        add(copy)
    for _ in range(15):
        text = [rng.choice(words) for _ in range(rng.choice((3, 30, 90, 250)))]
        add(text)
        add(text)
        for edits in (1, 2, 4, 9):
            copy = list(text)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            add(copy)
    shared = [rng.choice(words) for _ in range(60)]
    for _ in range(40):  # a passage that many share
        add(shared + [rng.choice(words) for _ in range(rng.choice((5, 20, 100)))])
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, n):
    rows = near_rows()
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)), words=n).collect()}
    ids, sets = [i for i, _ in rows], brute_sets([t for _, t in rows], n)
    want = brute_components(ids, sets, 80)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in zip(ids, sets)}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicate_edges(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(None, "a b c"), (None, "a b c"), (5, "a b c"), (4, "A b C"), (4, "A b C"), (9, None)]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect())
    assert got == [(-1, None, True), (-1, None, True), (4, 4, True), (4, 4, True), (5, 4, False), (9, 9, True)]


def test_blocks():
    texts = [t for _, t in near_rows(7)][:60]
    sets, plain = shingle_sets(pa.array(texts), 2), brute_sets(texts, 2)
    alike = lambda i, j: bool(plain[i] and plain[j]) and 100 * len(plain[i] & plain[j]) >= 80 * len(plain[i] | plain[j])
    live = [i for i in range(60) if plain[i]]
    sets = [sets[i] for i in live]
    assert sorted(block_links(sets, None, 80)) == [(a, b) for a, b in combinations(range(len(live)), 2) if alike(live[a], live[b])]
    assert sorted(block_links(sets[:20], sets[20:], 80)) == [(a, b - 20) for a in range(20) for b in range(20, len(live)) if alike(live[a], live[b])]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 150), (7, 7), (150, 100)] + [(500, i) for i in range(501, 600)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 150: 100, 200: 100} | {i: 500 for i in range(500, 600)}


def brute_lm(train, texts):
    """The model's formulas over dictionaries."""
    tokens = lambda t: [*WORD.findall(lower(t or "")), None]
    c, pairs = Counter(), Counter()
    for t in train:
        w = tokens(t)
        c.update(w)
        pairs.update(zip(["<s>", *w], w))
    n, v = sum(c.values()), len(c)
    before = Counter(w for _, w in pairs)
    after, kinds = Counter(), defaultdict(Counter)
    for (u, _), k in pairs.items():
        after[u] += k
        kinds[u][min(k, 3)] += 1
    of = lambda counts: lm.discounts(*[sum(x == i for x in counts.values()) for i in range(1, 5)])
    d2, d1 = of(pairs), of(before)
    spare = sum(d1[min(k, 3) - 1] for k in before.values()) / len(pairs) if pairs else 1
    out = []
    for t in texts:
        w = tokens(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for u, x in zip(["<s>", *w], w):
            low = (max(before[x] - d1[min(before[x], 3) - 1], 0) / len(pairs) if before[x] else 0) + spare / (v + 1)
            if after[u]:
                k = pairs[u, x]
                low = (k - d2[min(k, 3) - 1] if k else 0) / after[u] + sum(d2[i - 1] * m for i, m in kinds[u].items()) / after[u] * low
            score += math.log10(low)
        out.append((len(w), sum(c[x] > 0 for x in w), n, base, score))
    return out, (c, v)


def test_language_model(spark, docs):
    rows, df = docs
    df = df.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    train = [t for key, t, _ in rows if zlib.crc32(str(key).encode()) % 7 != 2]
    model = lm.fit(df.where(~F.col("held_out")), shard_bytes=100_000)
    assert model.shards > 4
    want, _ = brute_lm(train, [t for _, t, _ in rows])
    got = {r.doc_id: r for r in lm.score(df.withColumn("score", F.lit("x")), model, keep=["doc_id", "held_out", "score"]).collect()}
    for (key, _, _), (tokens, known, n, base, score) in zip(rows, want):
        r = got[key]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_model_sums_to_one(spark):
    df = spark.createDataFrame([("a b a c",), ("b a b d a",), ("c",), (None,)], "text string")
    model = lm.fit(df, shard_bytes=8)
    assert model.shards == 3
    arrays = lm.Arrays(model)
    words = ["a", "b", "c", "d", "zzz"]
    for context in (None, "a", "b", "zzz"):
        texts = [w if context is None else f"{context} {w}" for w in words] + ["" if context is None else context]
        chunk, sizes = lm.tokens(pa.array(texts))
        # the probability of one word after the context: the texts without their ends and contexts
        total = 0.0
        for t in texts:
            chunk, sizes = lm.tokens(pa.array([t]))
            whole = lm.log_scores(arrays, chunk, sizes)[2][0]
            last = t.split()[-1] if t.split() else None
            end = lm.log_scores(arrays, *lm.tokens(pa.array([t])))[2][0]
            assert whole == end
            total += 10 ** _next(arrays, context, last if t != (context or "") else None)
        assert total == pytest.approx(1, abs=1e-9)


def _next(arrays, context, word):
    """The log probability of one token (None: the end) after a context (None: the beginning)."""

    def score(words, end):
        h, _ = word_hashes(pa.array([" ".join(words)]))
        chunk = np.append(h, lm.END) if end else h
        return lm.log_scores(arrays, chunk, np.array([len(chunk)]))[2][0] if len(chunk) else 0.0

    before = [] if context is None else [context]
    return score(before + ([] if word is None else [word]), word is None) - score(before, False)


def test_model_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = lm.fit(empty)
    assert (model.v, model.n, model.bigrams) == (0, 0, 0)
    got = lm.score(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), model).collect()
    assert [(r.n_tokens, r.n_known, r.score) for r in got] == [(3, 0, 0.0), (1, 0, 0.0)]
    assert os.path.isdir(model.folder)


def test_a_missing_file_is_an_error(spark):
    """No worker takes a file that it does not see, or sees in part, for an empty one."""
    df = spark.createDataFrame([(1, "a b a c"), (1, "a b a c"), (2, "a b"), (3, None)], "doc_id long, text string")
    for name in ("word-0", "times-0", "stats-0"):
        for spoil in (os.remove, lambda path: os.truncate(path, 4 if name == "times-0" else 8)):
            model = lm.fit(df)
            spoil(f"{model.folder}/{name}")
            with pytest.raises((OSError, ValueError)):
                lm.log_scores(lm.Arrays(model), *lm.tokens(pa.array(["a b a"])))


def test_wide_counts(tmp_path):
    for n in (np.array([1, 2, 3], np.uint32), np.array([1, 1 << 40, 3], np.uint64)):
        lm._write(f"{tmp_path}/times-0", n)
        assert lm._map(f"{tmp_path}/times-0", None, 3).tolist() == n.tolist()


def test_merging_as_blobs_come(monkeypatch):
    monkeypatch.setattr(lm, "HELD", 100)
    rng = np.random.default_rng(1)
    held, want = lm.Merged(1), Counter()
    for _ in range(30):
        keys = np.unique(rng.integers(0, 500, 60).astype(np.uint64))
        held.add(lm.pack(keys, keys + np.uint64(1)))
        want.update(dict(zip(keys.tolist(), (keys + np.uint64(1)).tolist())))
    assert dict(zip(*(x.tolist() for x in held.get()))) == dict(want)
