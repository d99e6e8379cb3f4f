import random

import pytest

import __spark_entry__ as E
import corpus_pipeline as C
from veracity.llm import language_id, mixing, toxicity
from veracity.llm.queries import MIX_WEIGHTS

from .test_minhash_forest import brute
from .test_mix_scan_archive import brute_mix
from .test_tokens_packing import check_pack, plain  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_registered():
    names = list(E.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [n for n, _ in C.STAGES] == ["language", "toxicity", "near_dedup", "mixing", "packing"]


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in C.STAGES:
        out.append(C.stage(f(spark, out[-1], SF), name))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_classifier_stages_keep_what_their_models_accept(spark, steps):
    docs, spoken, clean = steps[:3]
    model = language_id.fit(docs)
    want = {r.doc_id for r in docs.collect() if (p := model.predict(r.text))[0] != "und" and p[1] >= C.MIN_LANGUAGE}
    assert rows(spoken).keys() == want and spoken.columns == docs.columns
    tox = toxicity.fit(spoken, spark.read.parquet(f"{SF}/labels.parquet"))
    assert rows(clean).keys() == {r.doc_id for r in spoken.collect() if tox.score(r.text) < 0.5} and clean.columns == docs.columns


def test_dedup_stage_equals_brute_force(steps):
    clean, kept = steps[2:4]
    want = brute([(r.doc_id, r.text) for r in clean.collect()])
    assert rows(kept).keys() == {i for i, (_, c) in want.items() if i == c} and kept.columns == clean.columns


def test_mixing_and_packing_stages_equal_brute_force(steps, plain):  # noqa: F811
    kept, mixed, packed = steps[3:]
    docs = kept.collect()
    data = [(r.doc_id, r.text, f"d{int(r.source[3:]) % 4}", r.lang, r.source) for r in docs]
    want = brute_mix(data, MIX_WEIGHTS, 1.0, C.MIX_SHARE, 1, 1)
    assert rows(mixed).keys() == {data[i][0] for i, n in want.items() if n} and mixed.columns == kept.columns
    check_pack([(r.doc_id, r.text) for r in mixed.collect()], packed.collect(), plain)


def test_run_is_the_stages(spark, steps):
    assert sorted(map(tuple, C.run(spark, SF).collect())) == sorted(map(tuple, steps[-1].collect()))


def test_odd_documents(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(4, 1), (8, 0), (9, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd_docs, no_docs):
        for name, f in C.STAGES:
            out = C.stage(f(spark, docs, str(tmp_path)), name)
            assert name == "packing" or set(out.columns) >= set(no_docs.columns)
            docs = out


def test_planted_rows(spark, tmp_path):
    """Copies and toxic texts go, clean ones of a plain mix stay until the mix."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("aeioumnrst") for _ in range(r.randint(2, 8)))
    vocab = [word() for _ in range(900)]
    texts = [[r.choice(vocab) for _ in range(r.randint(20, 90))] for _ in range(900)]
    bad = {i for i in range(900) if i % 9 == 0}
    for i in bad:
        texts[i][r.randrange(20)] = r.choice(["zkillvex", "qwrothly"])
    texts += [list(t) for t in texts[1:40]]
    docs = spark.createDataFrame([(i, " ".join(t), "en", f"src{i % 3}", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, int(i in bad)) for i in range(900)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    copies = {900 + i - 1 for i in range(1, 40)}
    toxic = bad | {c for c in copies if c - 899 in bad}
    for name, f in C.STAGES[:3]:
        docs = C.stage(f(spark, docs, str(tmp_path)), name)
    left = {r.doc_id for r in docs.collect()}
    assert not left & copies and len(left & toxic) <= 2 and len(set(range(900)) - bad - left) <= 2
    assert mixing.LEVELS == ("domain", "lang", "source")
