import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veracity.llm import whitening as W
from veracity.llm.queries import op11_whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(e):
    return e is not None and len(e) > 0 and all(v is not None and math.isfinite(v) for v in e)


def plain(rows, weights="one", k=4):
    """{(vec_id, vector): (n, deviation, whitened, explained)} up to the components' signs."""
    x = {tuple(math.floor(256 * float(np.float32(v))) for v in e) for _, e in rows if usable(e)}
    out = {}
    for d in {len(v) for v in x}:
        own = np.array(sorted(v for v in x if len(v) == d))
        count = np.ones(len(own), int)
        if weights == "count":
            all_rows = [tuple(math.floor(256 * float(np.float32(v))) for v in e) for _, e in rows if usable(e)]
            count = np.array([all_rows.count(tuple(v)) for v in own])
        n, s = count.sum(), (own * count[:, None]).sum(axis=0)
        c = own - s / n
        cov = (c * count[:, None]).T @ c / n
        e, u = np.linalg.eigh(cov)
        e, u = e[::-1][:k], u[:, ::-1][:, :k]
        for v, z in zip(own.tolist(), c @ u, strict=True):
            out[tuple(v)] = (int(n), sum((int(n) * a - int(b)) ** 2 for a, b in zip(v, s.tolist(), strict=True)), z, e, e / max(np.trace(cov), 1e-300))
    return out


def hold(df, rows, weights="one"):
    want = plain(rows, weights)
    got = df.collect()
    assert len(got) == sum(usable(e) for _, e in rows)
    by_id = {i: tuple(math.floor(256 * float(np.float32(v))) for v in e) for i, e in rows if usable(e)}
    sign = {}
    for r in got:
        n, deviation, z, e, share = want[by_id[r["vec_id"]]]
        assert (r["n"], int(r["deviation"])) == (n, deviation)
        assert len(r["whitened"]) == len(e) == min(4, r["d"])
        for j, w in enumerate(r["whitened"]):
            if share[j] < 1e-12:
                assert w is None
                continue
            assert abs(r["explained"][j] / share[j] - 1) < 1e-8
            true = z[j] / math.sqrt(e[j])
            if abs(true) > 1e-6:
                assert sign.setdefault((r["d"], j), np.sign(w * true)) == np.sign(w * true)
            assert abs(abs(w) - abs(true)) < 1e-6
        assert r["identity_error"] is None or r["identity_error"] < 1e-9


def table(n=300, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(v) for v in np.float32(rng.normal(size=6) * [9, 5, 3, 2, 1, 0.5])]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(n // 2)]  # a third of the rows have one vector
    return rows


@pytest.mark.parametrize("weights", ["one", "count"])
def test_against_numpy(spark, weights):
    rows = table()
    hold(W.whiten(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA), weights=weights), rows, weights)


def test_weights_are_checked(spark):
    with pytest.raises(ValueError):
        W.whiten(spark.createDataFrame([], SCHEMA), weights="two")


def test_odd_rows(spark):
    rows = table(40) + [(900, None), (901, []), (902, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (903, [float("nan")] * 6), (904, [float("inf")] + [0.0] * 5),
                        (905, [1e30] * 6), (906, [1.0, 2.0]), (907, [3.0, -1.0]), (908, [-0.0, 0.0]), (909, [0.5])]
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    for c in ("x", "h1", "d", "n", "copies", "whitened"):
        df = df.withColumn(c, F.lit("clash"))
    found = W.whiten(df)
    hold(found, [(i, e) for i, e in rows if i != 905])
    alone = found.where("vec_id = 909").first()
    assert alone["whitened"] == [None] and alone["identity_error"] is None and alone["deviation"] == 0
    twice = W.whiten(df.where("vec_id < 40").union(df.where("vec_id < 40")))
    assert twice.count() == 80
    unnamed = W.whiten(df.where("vec_id < 40").withColumn("vec_id", F.lit(None).cast("long")))
    assert unnamed.where("vec_id is null").count() == 40
    assert W.whiten(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sums_beyond_a_long():
    x = np.array([[2**61, 3], [2**61, -3], [2**61, 1]])
    assert W._weighted_sum(x, np.array([1, 5, 1])) == [7 * 2**61, 3 - 15 + 1]
    assert W._deviations(np.array([[2**40, 0]]), 2**30, [5, 5])[0] == (2**70 - 5) ** 2 if (2**70 - 5) ** 2 + 25 < 10**38 else W._deviations(np.array([[2**40, 0]]), 2**30, [5, 5])[0] is None
    assert int(W._deviations(np.array([[2**33, 1]]), 2**20, [5, 5])[0]) == (2**53 - 5) ** 2 + (2**20 - 5) ** 2


def test_hot_vector(spark, monkeypatch):
    """A vector of a third of the rows is joined back over several salts."""
    from veracity.operators import skew
    monkeypatch.setattr(skew.salted_join, "__defaults__", (10,))
    rows = table(120)
    hold(W.whiten(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)), rows)


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = plain(rows)
    got = op11_whitening(spark, sf).toPandas()
    assert len(got) == 4 * len(rows) and set(got["component"]) == {1, 2, 3, 4}
    by_id = {i: want[tuple(math.floor(256 * float(np.float32(v))) for v in e)] for i, e in rows}
    assert all(by_id[i][0] == n and by_id[i][1] == d for i, n, d in zip(got["vec_id"], got["n"], got["deviation"], strict=True))
    for c in range(1, 5):
        own = got[got["component"] == c]
        true = np.array([by_id[i][2][c - 1] / math.sqrt(by_id[i][3][c - 1]) for i in own["vec_id"]])
        w = own["whitened"].to_numpy()
        assert min(np.abs(w - true).max(), np.abs(w + true).max()) < 1e-9
