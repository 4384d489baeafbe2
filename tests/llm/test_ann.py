import numpy as np

from tidemark.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def dot(x, y):
    total = 0.0  # sum() would compensate
    for a, b in zip(x, y):
        total += float(a) * float(b)
    return total


def brute(rows, asked, k):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    dim = max({len(v) for _, v in ok}, key=lambda d: (sum(len(v) == d for _, v in ok), -d)) if ok else 0
    ok = [(i, v) for i, v in ok if len(v) == dim]
    out = {}
    for q, x in ok:
        if q in asked:
            scored = sorted((-dot(v, x), i) for i, v in ok if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def vectors(n, dim, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    x = (centres[rng.integers(0, 8, n)] + rng.normal(size=(n, dim))).astype(np.float32)
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_recall_and_scores(spark):
    rows = vectors(3000, 33)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = found(ann.search(ann.build(df, "vec_id", "embedding"), df.where("vec_id % 100 = 0"), "vec_id", "embedding", 20))
    want = brute(rows, range(0, 3000, 100), 20)
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q, mine in got.items():
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        exact = dict(brute(rows, [q], 3000)[q])
        assert all(s == exact[i] for _, i, s in mine)


def test_edges(spark):
    odd = [(100, None), (101, []), (102, [0.0] * 8), (103, [float("nan")] + [1.0] * 7), (104, [None] + [1.0] * 7), (105, [float("inf")] * 8), (106, [1.0, 2.0]), (None, [1.0] * 8)]
    rows = vectors(30, 8) + odd + [(i, [9.0] * 8) for i in range(200, 320)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    index = ann.build(df, "vec_id", "embedding")
    for k in (3, 20, 400):
        got = found(ann.search(index, df, "vec_id", "embedding", k))
        want = brute(rows, {i for i, _ in rows if i is not None}, k)
        assert {q: [(i, s) for _, i, s in x] for q, x in got.items()} == want
    none = spark.createDataFrame([], SCHEMA)
    assert ann.search(ann.build(none, "vec_id", "embedding"), df, "vec_id", "embedding").collect() == []
    assert ann.search(index, none, "vec_id", "embedding").collect() == []


def test_parallel_residuals_shrink():
    """What the loss is for: a smaller part of the residual along the vector than nearest centres leave."""
    x = np.array([v for _, v in vectors(2000, 32)])
    books = ann.fit(x)
    v = books.pairs(x.astype(np.float32))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)

    def along(codes):
        decoded = np.stack([books.centres[j][codes[:, j]] for j in range(v.shape[1])], 1).reshape(len(x), -1)
        return (((x - decoded) * unit).sum(1) ** 2).mean()

    nearest = np.stack([((v[:, j, None] - books.centres[j]) ** 2).sum(2).argmin(1) for j in range(v.shape[1])], 1)
    assert along(books.encode(x)) < along(nearest)


def test_full_block_with_thousands_of_near_copies():
    """Near copies share their codes, so rough scores cannot tell them apart."""
    n, dim, k = ann.BLOCK_BYTES // (64 * 8), 64, 20
    for copies, noise in ((n // 3, 0.001), (n // 3, 0.02), (1000, 0.01), (0, 0.0)):
        rng = np.random.default_rng(copies)
        x = rng.normal(size=(n, dim)).astype(np.float32)
        x[:copies] = x[0] * (1 + noise * rng.normal(size=(copies, dim)))
        x, ids = x[rng.permutation(n)].astype(np.float64), np.arange(n)
        books = ann.fit(x)
        codes = books.encode(x)
        packed = codes[:, 0::2] | codes[:, 1::2] << 4
        asked = rng.permutation(n)[:60]
        place, got, score = ann.scan(books, ids, packed, x, asked, x[asked], k)
        for i, query in enumerate(asked):
            exact = ann.exact(x, x[query][None], ids[None])[0]
            want = [j for j in np.lexsort((ids, -exact)) if j != query][:k]
            assert got[place == i].tolist() == want
            assert score[place == i].tolist() == exact[want].tolist()
