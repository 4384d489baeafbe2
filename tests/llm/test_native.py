"""Sharding, mixing and licenses: the operators of DataFrame functions alone."""

import math
import re
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.llm import licenses, mixing
from tidemark.llm.mixing import Schedule, mix, mixed, slot_table
from tidemark.llm.queries import LICENSE_TEXTS
from tidemark.llm.ranking import ranked
from tidemark.llm.sharding import stratified_shards

ROWS = [(i, None if i % 50 == 7 else f"s{0 if i % 3 == 0 else i % 5}", f"text {i % 20}") for i in range(997)]
SCHEMA = "doc_id long, source string, text string"


def test_ranks(spark):
    df = spark.createDataFrame([(i % 7, i % 3 or None) for i in range(500)], "x long, g long").repartition(5)
    got = defaultdict(list)
    for r in ranked(df, [F.col("x")], group="g").collect():
        got[r.g].append((r["rank"], r.x, r.total))
    assert set(got) == {None, 1, 2}
    for rows in got.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(len(rows))) and all(r[2] == len(rows) for r in rows)
        assert [r[1] for r in rows] == sorted(r[1] for r in rows)


@pytest.mark.parametrize("n", [1, 16])
def test_shards(spark, n):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("shard", F.lit("old"))
    got = stratified_shards(df, "doc_id", "source", n).collect()
    assert sorted(r.doc_id for r in got) == list(range(997))
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    sizes = [len(x) for x in by.values()]
    assert len(by) == n and max(sizes) - min(sizes) <= 1
    total = Counter(r.source for r in got)
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        for source, count in total.items():
            assert abs(sum(r.source == source for r in rows) - count / n) <= 2
    again = stratified_shards(df.repartition(7), "doc_id", "source", n).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in got}


def test_shards_by_brute_force(spark):
    """Fractional ranks in plain Python, from the same seeded hashes."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    hashed = df.select("doc_id", "source", F.xxhash64(F.lit(17), "doc_id").alias("h")).collect()
    groups = defaultdict(list)
    for r in hashed:
        groups[r.source].append((r.h, r.doc_id))
    order = sorted(((2 * i + 1) / (2 * len(g)), *row) for g in groups.values() for i, row in enumerate(sorted(g)))
    want = {doc: (p * 16 // 997) for p, (_, _, doc) in enumerate(order)}
    assert {r.doc_id: r.shard for r in stratified_shards(df, "doc_id", "source", 16).collect()} == want


def test_shard_edges(spark):
    assert stratified_shards(spark.createDataFrame([], SCHEMA), "doc_id", "source", 4).collect() == []
    same = spark.createDataFrame([(1, "a", "x")] * 10 + [(None, None, None)], SCHEMA)
    assert Counter(r.shard for r in stratified_shards(same, "doc_id", "source", 4).collect()) == {0: 3, 1: 3, 2: 3, 3: 2}
    with pytest.raises(ValueError):
        stratified_shards(same, "doc_id", "source", 0)


def walk(schedule):
    state = schedule.begin()
    return list(schedule.run(state, schedule.slots))


def test_schedule_places_all_blocks_once():
    blocks, weights = [100, 3, 7, 0, 50, 9], [1, 1, 2, 5, 0.5, 0]
    got = walk(Schedule(blocks, weights))
    assert sorted((i, b) for i, b, _, _ in got) == [(i, b) for i, n in enumerate(blocks) for b in range(n)]
    assert [p for _, _, p, _ in got] == sorted(p for _, _, p, _ in got)
    assert {i for i, _, p, _ in got if i == 5} == {5} and all(i != 5 for i, _, _, _ in got[:160])  # without a weight: last


def test_schedule_starts_anywhere():
    schedule = Schedule([40, 300, 7, 12, 90], [0.1, 2.5, 1 / 3, 1, 0.7])
    state, parts = schedule.begin(), []
    while state.slot < schedule.slots:
        parts += schedule.run(mixing.deepcopy(state), state.slot + 17)
        for _ in schedule.run(state, state.slot + 17):
            pass
    assert parts == walk(schedule)


def test_given_weights_on_long_schedules():
    """Less than one block from the given weights, at any time."""
    for weights, blocks in (
        ([1.0] * 3, [14_000] * 3),
        ([0.5, 0.3, 0.2], [21_000, 13_000, 9_000]),
        ([n**0.5 for n in (9e5, 5e5, 3e5, 2e5, 7e4, 1e4)], [20_000] * 6),
        ([1e-5, 0.5, 0.49999], [10, 15_000, 15_000]),
        ([1000.0] + [1.0] * 1000, [5000] + [6] * 1000),
        ([1.0] * 20, [50_000] * 20),
        ([0.7, 1 / 3, 0.123456789], [600_000, 290_000, 110_000]),
    ):
        schedule = Schedule(blocks, weights)
        live, a, q = schedule.shares([0] * len(blocks))
        assert [Fraction(x, q) for x in a] == [Fraction(w) / sum(map(Fraction, weights)) for w in weights]
        last = {}
        for t, (i, j, phase, _) in enumerate(schedule.run(schedule.begin(), schedule.slots)):
            if phase:
                break
            # before and after its slot, and so at any time between two of its slots
            assert abs(j * q - t * a[i]) < q and abs((j + 1) * q - (t + 1) * a[i]) < q
            last[i] = j
        assert t >= 5000


def test_windows_of_a_schedule(spark, monkeypatch):
    """Windows that tasks walk through give what the driver's walk does."""
    schedule = Schedule([400, 30, 70, 1, 250], [1.0, 0.2, 3.0, 0, 0.5])
    short = [3, 0, 7, 1, 2]
    whole = sorted(map(tuple, slot_table(spark, schedule, short).collect()))
    monkeypatch.setattr(mixing, "WINDOW_SLOTS", 100)
    assert sorted(map(tuple, slot_table(spark, schedule, short).collect())) == whole
    assert [r[3] for r in sorted(whole, key=lambda r: r[3])] == list(range(751))


def brute_edf(share, quantum, slots, left):
    """Earliest deadline first, slot by slot."""
    had, out = [0] * len(share), []
    for t in range(slots):
        ready = [(-(-(had[i] + 1) * quantum // a), i) for i, a in enumerate(share) if had[i] * quantum // a <= t]
        i = min(ready)[1]
        out.append((i, had[i]))
        had[i] += 1
        if had[i] == left[i]:
            break
    return out


def test_mix_against_slot_by_slot(spark):
    weights = {"s0": 5, "s1": 1, "s2": 1, "s3": 1, "s4": 2, None: 0.5}
    got = mix(spark.createDataFrame(ROWS, SCHEMA).withColumn("slot", F.lit(0)), "doc_id", "source", weights, block_rows=8).collect()
    assert sorted(r.doc_id for r in got) == list(range(997))
    got.sort(key=lambda r: r.position)
    assert [r.position for r in got] == list(range(997))
    assert [r.slot for r in got] == sorted(r.slot for r in got)
    names = sorted(weights, key=lambda x: (x is None, x))
    counts = Counter(r.source for r in got)
    left = [-(-counts[x] // 8) for x in names]
    a = [int(2 * weights[x]) for x in names]
    first = brute_edf(a, sum(a), 10_000, left)
    blocks = list(dict.fromkeys((r.slot, r.source, r.block) for r in got))
    assert [(names.index(s), b) for _, s, b in blocks[: len(first)]] == first
    for t in range(len(first) + 1):  # less than one block from the target, at any time
        had = Counter(i for i, _ in first[:t])
        assert all(abs(had[i] - t * x / sum(a)) < 1 for i, x in enumerate(a))
    assert max(r.phase for r in got) >= 1


def test_mix_edges(spark):
    assert mix(spark.createDataFrame([], SCHEMA), "doc_id", "source").collect() == []
    same = spark.createDataFrame([(1, "a", "x")] * 5 + [(None, None, None)], SCHEMA)
    assert sorted(r.position for r in mix(same, "doc_id", "source", block_rows=2).collect()) == list(range(6))
    laid = mixed(same, "doc_id", "source", block_rows=2)
    assert laid.columns == same.columns and Counter(map(tuple, laid.collect())) == Counter(map(tuple, same.collect()))
    some = mix(spark.createDataFrame(ROWS, SCHEMA), "doc_id", "source", {"s1": 1.0}, block_rows=16).collect()
    assert sorted(r.position for r in some) == list(range(997))
    assert {r.source for r in some if r.phase == 0} == {"s1"}
    apart = spark.createDataFrame(ROWS, SCHEMA).dropDuplicates(["doc_id"]).withColumn("position", F.lit(-1))
    for rows in (apart, apart.union(apart.limit(5))):  # whole rows are placed where some are there twice
        laid = mixed(rows, "doc_id", "source", position="position", block_rows=8).collect()
        assert [r.position for r in sorted(laid, key=lambda r: r.position)] == list(range(rows.count()))
        assert Counter((r.doc_id, r.text) for r in laid) == Counter((r.doc_id, r.text) for r in rows.collect())


FILES = [
    (1, "a/LICENSE", "Released under the MIT License.\nPermission is hereby granted, free of charge, to any person"),
    (2, "a/b/x.txt", "some prose\nabout nothing"),
    (3, "a/b/c/y.txt", "prose that says nothing\nLicensed under the Apache License, Version 2.0."),
    (4, "a/b/c/z.txt", None),
    (5, "other/z.txt", ""),
    (6, "z.txt", "no notice, though a permission was asked for"),
    (7, None, "Licensed under CC BY-NC 4.0."),
    (8, "a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    (9, "ab/x.txt", "plain"),
    (10, "d/notes.txt", "Licensed under CC BY 4.0."),
    (10, "d/notes.txt", "Licensed under CC BY 4.0."),
    (11, "d/e/f.txt", "words " * 3000 + "\nReleased under the MIT License.\n" + "words " * 3000),
]


def test_licenses(spark):
    df = spark.createDataFrame(FILES, "doc_id long, path string, text string").withColumn("license", F.lit("?"))
    got = {r.doc_id: (r.license, r.via, r.from_dir) for r in licenses.license_scan(df, "doc_id", "path", "text").collect()}
    assert got == {
        1: ("MIT", "file", None),
        2: ("MIT", "inherited", "a"),
        3: ("Apache-2.0", "header", None),
        4: ("GPL-3.0", "inherited", "a/b/c"),
        5: (None, None, None),
        6: (None, None, None),
        7: ("CC-BY-NC-4.0", "file", None),
        8: ("GPL-3.0", "file", None),
        9: (None, None, None),
        10: ("CC-BY-4.0", "file", None),
        11: ("MIT", "header", None),
    }
    assert licenses.license_scan(df.limit(0), "doc_id", "path", "text").collect() == []


def brute_notices(texts, templates):
    """Cosines by hand, of whole texts and of runs of words from the beginning of any line or sentence, without anchors."""
    terms = lambda t: re.findall(licenses.TERM, t.lower())
    parsed = licenses.template_terms(templates)
    vocabulary = {t for _, _, c in parsed for t in c}
    idf = {t: math.log((1 + len(texts)) / (1 + sum(t in set(terms(x or "")) for x in texts.values()))) + 1 for t in vocabulary}
    vector = lambda c: {t: (1 + math.log(n)) * idf.get(t, math.log(1 + len(texts)) + 1) for t, n in c.items()}
    known = [(name, sum(c.values()), vector(c)) for name, _, c in parsed]
    found = {}
    for key, text in texts.items():
        lines = [terms(x) for x in re.sub(licenses.SENTENCE, "\\1\n", text or "").split("\n")]
        parts = [(True, 0, terms(text or ""))]
        parts += [(False, n, [t for x in lines[i : i + 2 * n] for t in x][:n]) for i in range(len(lines)) for n in {n for _, n, _ in known if n <= 400}]
        best = []
        for whole, size, words in parts:
            if len(words) <= 64 and re.search(licenses.NEGATED, " ".join(words)):
                continue
            x = vector(Counter(words))
            norm = math.sqrt(sum(w * w for w in x.values()))
            for name, n, y in known:
                if words and (whole or n == size):
                    cos = sum(w * y.get(t, 0) for t, w in x.items()) / norm / math.sqrt(sum(w * w for w in y.values()))
                    if round(min(1, cos), 6) >= licenses.THRESHOLD:
                        best.append((not whole, -round(min(1, cos), 6), name))
        if best:
            header, score, name = min(best)
            found[key] = name, -score, not header
    return found


def test_license_scores(spark):
    negated = "This work is not licensed under the GNU General Public License, version 3."
    texts = {k: t for k, _, t in FILES} | {20: negated, 21: "Prose first. " + negated, 22: "Prose first. Licensed under the Apache License, Version 2.0. More prose"}
    texts[23] = "/*\n * Copyright 2020 Somebody\n *\n * " + licenses.TEMPLATES["Apache-2.0"][2].replace(" you ", "\n * you ") + "\n */\nint main() { return 0; }"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_notices(texts, licenses.TEMPLATES)
    got = {r.doc_id: (r.license, r.score, r.whole) for r in licenses.notices(df, "doc_id", "text", licenses.TEMPLATES).collect()}
    assert got.keys() == want.keys() and not got.keys() & {20, 21} and got[22][0] == got[23][0] == "Apache-2.0"
    for key, (name, score, whole) in got.items():
        assert (name, whole) == (want[key][0], want[key][2]) and score == pytest.approx(want[key][1], abs=2e-6)


@pytest.mark.skipif(not Path(LICENSE_TEXTS).is_dir(), reason="no licence texts on this system")
def test_full_texts(spark):
    """Whole licences, with a copyright line before them, are told apart, and their directories inherit them."""
    known = licenses.templates(LICENSE_TEXTS)
    rows = [(i, f"d{i}/TEXT", f"Copyright 2021 Some Body\n\n{known[name][-1]}", name) for i, name in enumerate(sorted(known)) if len(known[name][-1]) > 500]
    rows += [(100 + i, f"d{i}/x.c", "int main;", None) for i, *_ in rows]
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.via) for r in licenses.license_scan(df, "doc_id", "path", "text", known).collect()}
    names = {i: name for i, _, _, name in rows if name}
    assert {"Apache-2.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "CC0-1.0", "MIT", "BSD-2-Clause"} <= set(names.values())
    for i, name in names.items():
        assert got[i] == (name, "file") and got[100 + i] == (name, "inherited")
