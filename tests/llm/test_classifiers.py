import random
import zlib

import numpy as np
import pytest

from veracity.llm import language_id as L
from veracity.llm import queries as Q
from veracity.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_rows(spark):
    got = {r.doc_id: r for r in Q.op10_language_ftrl(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 5 == 0]
    assert all(got[d.doc_id].held_out for d in held) and sum(r.held_out for r in got.values()) == len(held)
    assert np.mean([got[d.doc_id].lang_pred == d.lang for d in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_inputs_are_text_alone(spark):
    """Languages of held-out rows and the other columns don't change a prediction."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    from pyspark.sql import functions as F

    from veracity.llm.common import held_out
    wrong = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("z"))
    a, b = L.fit(docs), L.fit(wrong)
    assert a.langs == b.langs and (a.weights == b.weights).all() and a.temperature == b.temperature


def test_language_odd_rows(spark, odd_docs, no_docs):
    model = L.fit(odd_docs)
    assert model.langs == ["de", "en"]
    out = L.predict(odd_docs, model)
    assert out.columns == [c for c in odd_docs.columns if c != "score"] + ["lang_pred", "score"]
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 7)] == ["und"] * 4 and got[1].score == 0
    assert got[8].lang_pred in model.langs and got[8].text.startswith("der die")
    assert L.predict(no_docs, model).collect() == []
    none = L.fit(no_docs)
    assert {r.lang_pred for r in L.predict(odd_docs, none).collect()} == {"und"}


def test_ngram_counts_of_long_texts(monkeypatch):
    r = random.Random(0)
    text = "".join(r.choice("abcäö ß") for _ in range(5000))
    want = L.counts(text)
    monkeypatch.setattr(L, "_PIECE", 64)
    got = L.counts(text)
    assert (want[0] == got[0]).all() and (want[1] == got[1]).all() and want[1].sum() == 3 * 5000 - 3
    mask = np.ones(T.BUCKETS, bool)
    want = T._chosen(text, mask)
    monkeypatch.setattr(T, "_PIECE", 64)
    assert (want == T._chosen(text, mask)).all()
    assert len(want) == len({text[i:i + n] for n in T.ORDERS for i in range(len(text) - n + 1)})


def toxic_corpus(n=1500, seed=5):
    r = random.Random(seed)
    vocab = ["".join(r.choice("aeioumnrst") for _ in range(r.randint(2, 8))) for _ in range(800)]
    rows = []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(5, 150))]
        bad = r.random() < 0.2
        if bad:
            w[r.randrange(len(w))] = r.choice(["zkillvex", "qwrothly", "vilgrubx"])
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in T.score(docs, T.fit(docs, labels)).collect()}
    held = [(i, b) for i, _, b in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == bool(b) for i, b in held]) > 0.99


def test_toxicity_never_learns_from_held_out_labels(spark):
    rows = toxic_corpus(400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = [(i, 1 - b if zlib.crc32(str(i).encode()) % 5 == 0 else b) for i, _, b in rows]
    a = T.fit(docs, spark.createDataFrame([(i, b) for i, _, b in rows], "doc_id long, toxic int"))
    b = T.fit(docs, spark.createDataFrame(flip, "doc_id long, toxic int"))
    assert a.bias == b.bias and (a.weights == b.weights).all() and (a.codes == b.codes).all()


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "x"), (4, 0, "x"), (8, None, "x"), (None, 1, "x"), (9, 1, "x"), (9, 0, "y"), (77, 1, "x")],
                                   "doc_id long, toxic int, text string")
    model = T.fit(odd_docs, labels)
    out = T.score(odd_docs, model)
    assert out.columns == [c for c in odd_docs.columns if c != "score"] + ["score"]
    got = out.collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert T.score(no_docs, model).collect() == []
    assert [r.score for r in T.score(odd_docs, T.fit(no_docs, labels)).collect()] and T.fit(odd_docs, labels.limit(0)).score("x") < 1e-9


def test_logistic_is_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4))
    y = (x @ [1, -2, 0, 0.5] + rng.normal(size=200) > 0.3).astype(float)
    row, col = np.indices(x.shape)
    w, b = T._logistic(row.ravel(), col.ravel(), x.ravel(), y, 4)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) + T.PENALTY * w).max() < 0.2 and abs((p - y).sum()) < 0.2


@pytest.mark.parametrize("loss_at", [0.5, 2.0])
def test_temperature(loss_at):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(4000, 3)) * 2
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert L._temperature(z * loss_at, y) == pytest.approx(loss_at, rel=0.15)
