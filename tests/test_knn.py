"""Nearest-title joins against numpy brute force."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from veracity.operators import knn
from veracity.operators.index import assign_cells, cell_centroids


def frames(spark, Q, V, cells=None):
    q = spark.createDataFrame([(f"e{i}", [float(x) for x in r]) for i, r in enumerate(Q)],
                              "entity string, embedding array<float>")
    cells = cells if cells is not None else [0] * len(V)
    v = spark.createDataFrame([(i, int(c), [float(x) for x in r]) for i, (r, c) in enumerate(zip(V, cells))],
                              "title_id bigint, cell int, embedding array<float>")
    return q, v


def brute(Q, V, k):
    Q32, V32 = np.asarray(Q, np.float32).astype(np.float64), np.asarray(V, np.float32).astype(np.float64)
    out = {}
    for i, q in enumerate(Q32):
        d = ((V32 - q) ** 2).sum(1)
        order = sorted(range(len(V)), key=lambda j: (d[j], j))[:k]
        out[f"e{i}"] = order
    return out


def as_lists(df):
    res = {}
    for r in df.collect():
        res.setdefault(r.entity, []).append((r.rk, r.title_id))
    return {k: [t for _, t in sorted(v)] for k, v in res.items()}


def test_exact_with_small_blocks(spark):
    rng = np.random.default_rng(1)
    Q, V = rng.normal(size=(23, 5)), rng.normal(size=(61, 5))
    q, v = frames(spark, Q, V)
    got = as_lists(knn.knn_join(q, v, 3, query_block=4, target_block=7))
    assert got == brute(Q, V, 3)


def test_k_larger_than_titles(spark):
    rng = np.random.default_rng(2)
    Q, V = rng.normal(size=(3, 4)), rng.normal(size=(2, 4))
    q, v = frames(spark, Q, V)
    got = as_lists(knn.knn_join(q, v, 5))
    assert all(len(x) == 2 for x in got.values())
    assert got == brute(Q, V, 5)


def test_equal_distances_break_by_id(spark):
    Q = [[0.0, 0.0]]
    V = [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.0, -1.0], [2.0, 2.0]]
    q, v = frames(spark, Q, V)
    assert as_lists(knn.knn_join(q, v, 3, target_block=2)) == {"e0": [0, 1, 2]}


def test_ivf_all_cells_equals_exact(spark):
    rng = np.random.default_rng(3)
    Q, V = rng.normal(size=(17, 6)), rng.normal(size=(80, 6))
    cells = rng.integers(0, 5, size=80)
    q, v = frames(spark, Q, V, cells)
    cents = cell_centroids(v)
    ivf = as_lists(knn.ivf_knn_join(q, v, cents, k=4, nprobe=5, target_block=9))
    assert ivf == brute(Q, V, 4)


def test_hot_cell_is_split(spark):
    # one cell holds most vectors; blocks keep each task bounded and results exact
    rng = np.random.default_rng(4)
    Q, V = rng.normal(size=(9, 3)), rng.normal(size=(120, 3))
    cells = [0] * 100 + [1] * 20
    q, v = frames(spark, Q, V, cells)
    cents = cell_centroids(v)
    got = as_lists(knn.ivf_knn_join(q, v, cents, k=2, nprobe=2, target_block=10))
    assert got == brute(Q, V, 2)


def test_assign_cells_nearest_centroid(spark):
    rng = np.random.default_rng(5)
    V = rng.normal(size=(30, 3))
    _, v = frames(spark, [[0, 0, 0]], V, rng.integers(0, 3, size=30))
    cents = cell_centroids(v)
    C = {r.cell: np.array(r.centroid) for r in cents.collect()}
    got = {r.title_id: r.cell for r in assign_cells(v, cents).collect()}
    V32 = np.asarray(V, np.float32).astype(np.float64)
    for i, x in enumerate(V32):
        best = min(C, key=lambda c: (((x - C[c]) ** 2).sum(), c))
        assert got[i] == best


@settings(max_examples=8, deadline=None)
@given(st.integers(1, 12), st.integers(1, 30), st.integers(1, 4), st.integers(1, 9))
def test_property_blocked_equals_brute(spark, nq, nv, k, block):
    rng = np.random.default_rng(nq * 100 + nv)
    Q, V = rng.integers(-2, 3, size=(nq, 3)).astype(float), rng.integers(-2, 3, size=(nv, 3)).astype(float)
    q, v = frames(spark, Q, V)
    assert as_lists(knn.knn_join(q, v, k, query_block=block, target_block=block)) == brute(Q, V, k)


def test_ivf_prunes_unprobed_cells(spark, tmp_path):
    import io, contextlib
    from veracity.operators.index import read_index, write_index
    rng = np.random.default_rng(6)
    Q, V = rng.normal(size=(4, 3)), rng.normal(size=(60, 3))
    q, v = frames(spark, Q, V, rng.integers(0, 6, size=60))
    write_index(v, str(tmp_path / "idx"))
    idx = read_index(spark, str(tmp_path / "idx"))
    cents = cell_centroids(idx)
    df = knn.ivf_knn_join(q, idx, cents, k=2, nprobe=1)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    assert "dynamicpruning" in buf.getvalue().lower()
    assert len(as_lists(df)) == 4


def test_squared_l2_expression(spark):
    from pyspark.sql import functions as F
    from veracity.functions.vectors import squared_l2
    df = spark.createDataFrame([([1.0, 2.0, 3.5], [0.5, -1.0, 3.0])], "a array<float>, b array<float>")
    assert df.select(squared_l2(F.col("a"), F.col("b"))).first()[0] == 0.25 + 9.0 + 0.25


def test_equal_vectors_take_bounded_memory():
    """A block of one vector many times over: no more than k of them are looked at per query."""
    import tracemalloc
    t, q = np.ones((16384, 64)), np.zeros((256, 64))
    ids = np.random.default_rng(0).permutation(16384)
    tracemalloc.start()
    rows, got, d2 = knn.nearest(q, t, ids, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got.reshape(-1, 2) == [0, 1]).all() and (d2 == 64).all() and len(rows) == 512
    assert peak < 64 << 20


def test_nearly_equal_vectors_are_measured_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    t = 1 + rng.integers(0, 3, size=(400, 6)) * 1e-12
    q = rng.normal(size=(20, 6))
    want = brute64(q, t, 3)
    for values in (8, 100, 1 << 20):
        monkeypatch.setattr(knn, "_VALUES", values)
        _, got, _ = knn.nearest(q, t, np.arange(400), 3)
        assert got.reshape(-1, 3).tolist() == want


def brute64(q, t, k):
    out = []
    for x in q:
        d = np.square(x - t).sum(axis=1)
        out.append(sorted(range(len(t)), key=lambda j: (d[j], j))[:k])
    return out


def test_no_forced_broadcast(spark):
    q, v = frames(spark, np.ones((3, 2)), np.ones((5, 2)), [0, 0, 1, 1, 1])
    plan = knn.ivf_knn_join(q, v, cell_centroids(v), k=2, nprobe=2)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" not in plan.lower()


def clustered(rng, n_cells, each, dims, spread=0.05):
    centres = rng.normal(size=(n_cells, dims)) * 4
    V = np.concatenate([c + rng.normal(size=(each, dims)) * spread for c in centres])
    return centres, V, np.repeat(np.arange(n_cells), each)


def test_bounded_search_is_exact_and_meets_few_shells(spark):
    from pyspark.sql import functions as F
    from veracity.session import Store
    rng = np.random.default_rng(8)
    centres, V, cells = clustered(rng, 12, 40, 4)
    Q = np.concatenate([centres[:5] + rng.normal(size=(5, 4)) * 0.05, V[::37], rng.normal(size=(4, 4)) * 4])
    q, v = frames(spark, Q, V, cells)
    store = Store(spark)
    got = knn.bounded_knn_join(q, v, cell_centroids(v), 3, store=store, target_block=10, query_block=4)
    assert as_lists(got) == brute(Q, V, 3)
    shells = store.read("shells").select("cell", "shell").distinct().count()
    met = store.read("shells_in_reach").groupBy("entity").agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n")).first()[0]
    assert shells >= 30 and met < shells / 4
    store.delete()


def test_bounded_search_of_small_cells_ties_and_equal_vectors(spark):
    V = [[0.0, 0.0]] * 6 + [[1.0, 0.0], [0.0, 1.0], [5.0, 5.0], [5.0, 6.0], [-3.0, 0.0]]
    cells = [0] * 6 + [1, 1, 2, 2, 3]
    Q = [[0.0, 0.0], [0.5, 0.5], [-3.0, 0.1], [9.0, 9.0]]
    q, v = frames(spark, Q, V, cells)
    for k in (1, 2, 4, 20):
        assert as_lists(knn.bounded_knn_join(q, v, cell_centroids(v), k, target_block=2)) == brute(Q, V, k)


@settings(max_examples=3, deadline=None)
@given(st.integers(1, 9), st.integers(1, 40), st.integers(1, 4), st.integers(1, 6))
def test_property_bounded_equals_brute(spark, nq, nv, k, n_cells):
    rng = np.random.default_rng(nq * 1000 + nv)
    Q, V = rng.integers(-2, 3, size=(nq, 3)).astype(float), rng.integers(-2, 3, size=(nv, 3)).astype(float)
    q, v = frames(spark, Q, V, rng.integers(0, n_cells, size=nv))
    assert as_lists(knn.bounded_knn_join(q, v, cell_centroids(v), k, target_block=5, query_block=3)) == brute(Q, V, k)


def test_trained_cells_find_clusters(spark):
    from veracity.operators.index import lloyd_step, seed_cells, train_cells
    rng = np.random.default_rng(9)
    centres, V, cells = clustered(rng, 6, 30, 3)
    _, v = frames(spark, [[0.0] * 3], V, cells)
    seeds = seed_cells(v, 6, seed=3)
    assert seeds.count() == 6 and len({tuple(r.centroid) for r in seeds.collect()}) == 6
    got = np.array([r.centroid for r in train_cells(v, 6, seed=3).collect()])
    V32 = np.asarray(V, np.float32).astype(float)
    cost = lambda C: np.square(V32[:, None] - C[None]).sum(2).min(1).sum()
    means = np.array([V32[cells == c].mean(0) for c in range(6)])
    assert cost(got) < 40 * cost(means)  # near the true clusters: one cell for all would cost thousands of times as much
    # a step never raises the cost; an empty cell stays where it is
    away = spark.createDataFrame([(0, [0.0] * 3), (1, [999.0] * 3)], "cell int, centroid array<double>")
    step = {r.cell: r.centroid for r in lloyd_step(v, away).collect()}
    assert step[1] == [999.0] * 3 and np.allclose(step[0], V32.mean(0))
    # fewer distinct vectors than cells
    _, few = frames(spark, [[0.0]], [[1.0], [1.0], [2.0]])
    assert sorted(r.centroid[0] for r in train_cells(few, 5).collect()) == [1.0, 2.0]


def test_bounded_search_moves_a_query_once_for_a_run_of_shells(spark):
    """Directions that the bounds can't tell apart reach every shell: a query's vector still goes out once for each cell, not for each shell."""
    from veracity.session import Store
    rng = np.random.default_rng(13)
    V, Q = rng.normal(size=(400, 24)), rng.normal(size=(9, 24))
    V, Q = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (V, Q))
    q, v = frames(spark, Q, V, rng.integers(0, 2, size=400))
    store = Store(spark)
    got = knn.bounded_knn_join(q, v, cell_centroids(v), 3, store=store, target_block=2, query_block=4)
    assert as_lists(got) == brute(Q, V, 3)
    met = store.read("shells_in_reach")
    assert store.read("shells").select("cell", "shell").distinct().count() > 10 and met.count() <= 9 * 2
    assert met.selectExpr("max(_last - _first)").first()[0] > 3
    store.delete()
