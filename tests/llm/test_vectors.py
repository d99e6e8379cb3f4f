import numpy as np

from veracity.llm import pivot_index as V
from veracity.llm import topk_columns as K


def brute_links(rows, cosine=0.93):
    ids = [i for i, _, _ in rows]
    root, n = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            (i, x, k), (j, y, m) = rows[a], rows[b]
            if k is None or k != m or x is None or y is None or len(x) != len(y):
                continue
            x, y = np.array(x, float), np.array(y, float)
            if not (np.isfinite(x).all() and np.isfinite(y).all()) or not x.any() or not y.any():
                continue
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                n[i] += 1
                n[j] += 1
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (n[i], find(i)) for i in ids}


def vectors(seed=0, n=600, dim=32):
    """Lone vectors, families of all closeness around the threshold, many copies of one, scaled copies."""
    r = np.random.default_rng(seed)
    rows = [r.normal(size=dim) for _ in range(n // 3)]
    while len(rows) < n:
        base = r.normal(size=dim)
        for _ in range(r.integers(1, 20)):
            rows.append(base + r.normal(size=dim) * r.uniform(0, 0.4))
    rows += [rows[5]] * 60 + [rows[6] * 3.0] * 2
    rows = [np.float32(x) for x in rows]
    order = r.permutation(len(rows))
    return [(int(i), [float(v) for v in rows[k]], int(r.integers(0, 3))) for i, k in enumerate(order)]


def test_links_and_recall(spark):
    rows = vectors()
    got = {r.vec_id: r for r in V.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    want = brute_links(rows)
    assert len(got) == len(rows)
    assert all(got[i].n_links <= n for i, (n, _) in want.items())  # none below the threshold
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert np.mean([got[i].component_id == c for i, (_, c) in want.items()]) > 0.97


def test_small_blocks_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame(vectors(1, 300), "vec_id long, embedding array<float>, label int")
    want = sorted(V.near_duplicates(df).collect())
    monkeypatch.setattr(V, "BLOCK", 7)
    assert sorted(V.near_duplicates(df).collect()) == want


def test_recall_in_a_dense_third_of_a_large_table():
    """All pairs that a link can join meet in the list of the later home."""
    r = np.random.default_rng(3)
    n, dim = 54_000, 64
    x = r.normal(size=(n, dim))
    dense = np.arange(0, n, 3)
    x[dense] = r.normal(size=dim) + r.normal(size=(len(dense), dim)) * 0.23  # mean cosine 0.95
    x = V._unit(x.ravel(), n)
    count, p, angle = V.prefixes(x, x[r.choice(n, 106, replace=False)], 0.93)
    at = np.cumsum(count) - count
    home = p[at]
    inside = np.zeros((n, 106), bool)
    inside[np.repeat(np.arange(n), count), p] = True
    assert count.mean() < 106
    some = r.choice(dense, 300, replace=False)
    i, j = V.linked(x[some], x[dense], 0.93)
    i, j = some[i], dense[j]
    assert len(i) > 300 * len(dense) / 2
    first, second = np.where(home[i] <= home[j], i, j), np.where(home[i] <= home[j], j, i)
    assert inside[first, home[second]].all()


def test_dense_third_of_a_table_of_many_cells(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 16)
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=(400, 64)), r.normal(size=64) + r.normal(size=(200, 64)) * 0.27])
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in V.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == brute_links(rows) and sum(n for n, _ in got.values()) > 1000


def test_dense_third_of_a_large_table(spark):
    r = np.random.default_rng(7)
    n = 10_000
    x = r.normal(size=(n, 64))
    x[::3] = r.normal(size=64) + r.normal(size=(len(x[::3]), 64)) * 0.23  # mean cosine 0.95
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    x = V._unit(x.ravel(), n)
    want = (x @ x.T >= 0.93).sum(axis=1) - 1
    got = {v.vec_id: v.n_links for v in V.near_duplicates(df).collect()}
    assert sum(got.values()) == want.sum() and all(got[i] == k for i, k in enumerate(want))


def test_rare_lengths_have_links(spark):
    r = np.random.default_rng(6)
    rows = [(i, [float(c) for c in r.normal(size=16)], 1) for i in range(600)]
    for d in (5, 6, 7, 8, 9, 10):  # a family of each rare length
        base = r.normal(size=d)
        rows += [(len(rows) + k, [float(c) for c in base + r.normal(size=d) * 0.05], 1) for k in range(6)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in V.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == brute_links(rows) and all(got[i][0] == 5 for i in range(600, 636))


ODD = [(1, [1.0, 0.0], 1, "a"), (2, [2.0, 0.0], 1, "a"), (3, [1.0, 0.0], None, "b"), (4, None, 1, "c"), (5, [0.0, 0.0], 1, "d"), (6, [1.0, None], 1, "e"),
       (7, [float("nan"), 1.0], 1, "f"), (8, [float("inf"), 1.0], 1, "g"), (9, [], 1, "h"), (10, [1.0, 0.0, 0.0], 1, "i"), (None, [1.0, 0.0], 1, "j"),
       (11, [1.0, 0.0], 2, "k"), (12, [1.0, 0.0], 1, "l"), (12, [1.0, 0.0], 1, "l"), (13, [1e-30, 0.0], 1, "m"), (50, [3.0, 4.0], 1, "n"), (100, [3.0, 4.0], 1, "n")]
SCHEMA = "vec_id long, embedding array<float>, label int, x string"


def odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    for name in ("rep", "p", "v", "size", "dim", "rank", "n", "own"):
        df = df.withColumn(name, df["x"])
    return df


def test_odd_vectors(spark):
    rows = V.near_duplicates(odd(spark)).collect()
    assert len(rows) == len(ODD)
    got = {r.vec_id: (r.n_links, r.component_id) for r in rows}
    assert got[1] == (4, 1) and got[2] == (4, 1) and got[12] == (4, 1) and got[13] == (4, 1)
    assert all(got[i] == (0, i) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)) and got[None] == (0, None)
    assert got[50] == (1, 50) and got[100] == (1, 50)
    assert V.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def brute_top(rows, k=5, every=50):
    ok = {(i, tuple(np.floor(256 * np.array(v, float)).astype(object))) for i, v, *_ in rows
          if i is not None and v and all(c is not None and np.isfinite(c) for c in v)}
    out = []
    for i, q in ok:
        if i % every == 0:
            best = sorted((-sum(int(a) * int(b) for a, b in zip(q, c)), j) for j, c in ok if j != i and len(c) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k_equals_brute_force(spark, monkeypatch):
    rows = [(i, v) for i, v, _ in vectors(2, 700, 70)]
    monkeypatch.setattr(K, "CANDIDATE_BLOCK", 100)
    monkeypatch.setattr(K, "QUERY_BLOCK", 4)
    got = K.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(map(tuple, got)) == brute_top(rows)


def test_top_k_odd_vectors(spark):
    got = K.top_k(odd(spark)).collect()
    assert sorted(map(tuple, got)) == brute_top(ODD) and {r.query_id for r in got} == {50, 100}
    assert K.top_k(spark.createDataFrame([], SCHEMA)).collect() == []


def test_top_k_of_large_numbers(spark):
    rows = [(0, [3e6, -1.0, 7.0]), (1, [3e6, 2.0, 1.0]), (2, [3e6, 3.0, 1.0]), (3, [1e30, 0.0, 0.0])]
    got = K.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 3), (2, 1), (3, 2)]
    assert max(r.score for r in got) == 2**63 - 1


def test_bound_drops_nothing_it_needs():
    r = np.random.default_rng(3)
    for _ in range(50):
        c, q = np.floor(r.normal(size=(300, 64)) * 40), np.floor(r.normal(size=64) * 40)
        ids = r.permutation(300)
        want = sorted(((int(-(q @ x)), int(i)) for x, i in zip(c, ids) if i != 7))[:5]
        got = K.best(q, np.ascontiguousarray(c.T), K._remaining(c), K._remaining(q[None])[:, 0], ids, 7, 5)
        assert [(-s, i) for s, i in got] == want
