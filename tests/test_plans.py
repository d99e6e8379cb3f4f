"""End-to-end plan checks on the sf0.001 tables, prompt and payload formats."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from veracity.functions import answers as A
from veracity.functions import prompts as P
from veracity.operators import retrieval
from veracity.operators.index import cell_centroids
from veracity.plans import queries
from veracity.plans.scorer import score
from veracity.session import Store, checkpoint_dir
from veracity.sources import fixtures
from veracity.sources.readers import KnowledgeSource


def _scores(df):
    return {r.gen_id: (r.status, r.score) for r in df.collect()}


def _inputs(spark):
    know, vecs = fixtures.knowledge(spark, SF001), fixtures.title_vectors(spark, SF001)
    return fixtures.generations(spark, SF001), know, vecs, fixtures.gazetteer(know)


def test_score_is_the_registered_query(spark):
    gens, know, vecs, gaz = _inputs(spark)
    res = score(gens, KnowledgeSource(know, vecs, cell_centroids(vecs)), gazetteer=gaz)
    got = {g: sc for g, (st, sc) in _scores(res.scores).items() if st == "ok"}
    assert got == {r.gen_id: r.score for r in queries.factual_precision(spark, SF001).collect()}
    # every generation is reported, failed ones included
    assert res.scores.count() == gens.count()


def test_ivf_with_all_cells_equals_exact(spark):
    gens, know, vecs, gaz = _inputs(spark)
    cents = cell_centroids(vecs)
    ivf = score(gens, KnowledgeSource(know, vecs, cents, nprobe=cents.count()), gazetteer=gaz)
    exact = score(gens, KnowledgeSource(know, vecs), gazetteer=gaz)
    assert _scores(ivf.scores) == _scores(exact.scores)


def test_shuffled_input_changes_nothing(spark):
    gens, know, vecs, gaz = _inputs(spark)
    src = KnowledgeSource(know, vecs)
    a = score(gens, src, gazetteer=gaz)
    b = score(gens.orderBy(F.rand(7)).repartition(5), src, gazetteer=gaz)
    assert _scores(a.scores) == _scores(b.scores)
    scores = [sc for st, sc in _scores(a.scores).values() if sc is not None]
    assert all(0.0 <= x <= 1.0 for x in scores)


def test_stages_are_written_once_and_nothing_else_runs(spark, monkeypatch):
    """Building a run's results writes each named stage once; asking for the results again writes nothing."""
    gens, know, vecs, gaz = _inputs(spark)
    written = []
    keep = Store.keep
    monkeypatch.setattr(Store, "keep", lambda self, name, df: written.append(name) or keep(self, name, df))
    res = score(gens, KnowledgeSource(know, vecs, cell_centroids(vecs)), gazetteer=gaz)
    assert sorted(written) == sorted(["facts", "names", "tagged", "entity_vectors", "centroids", "probes", "neighbours", "text_ids", "sentences", "hits",
                                      "postings", "bm25_query", "bm25_nonzero", "top", "decided", "scores"])
    res.scores.collect(), res.decisions.collect()
    assert len(written) == 16
    plan = res.decisions._jdf.queryExecution().executedPlan().toString() + res.scores._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Generate" not in plan  # they read stage tables, no stage runs again
    res.store.delete()


def test_changed_files_start_a_new_run(spark, tmp_path):
    sf = str(tmp_path / "sf")
    for t in queries._TABLES:  # written anew: the given files may be read-only
        spark.read.parquet(f"{SF001}/{t}.parquet").write.parquet(f"{sf}/{t}.parquet")
    before = queries.dedupe_facts(spark, sf).count()
    conv = spark.read.parquet(f"{SF001}/conversations.parquet")
    conv.where("conv_id < 3").write.mode("overwrite").parquet(f"{sf}/conversations.parquet")
    assert 0 < queries.dedupe_facts(spark, sf).count() < before


def test_no_shared_folder_is_an_error(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError):
        checkpoint_dir(Session())


def test_sentence_markers_in_the_text(spark):
    from veracity.functions import text as T
    rows = ["a\x02b\x01c", "Mr\x02 One. Two\x03. Three\x01! \x03\x04 Four.", "\x03\x05\x06 A. B", "plain. Text", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", T.sentences(F.col("t")).alias("s")).collect()}
    assert got[0] == ["a\x02b\x01c"] and got[4] is None and got[5] == []
    assert all("".join(got[i]) == rows[i] for i in range(4))
    assert got[1] == ["Mr\x02 One. ", "Two\x03. ", "Three\x01! \x03\x04 Four."]


def test_dedupe_titles_option(spark):
    know = spark.createDataFrame([(1, "Alice", "One. Two."), (2, "Bob", "Three.")],
                                 "title_id bigint, title string, text string")
    ents = spark.createDataFrame([(9, "alice"), (9, "bob")], "gen_id bigint, entity string")
    nn = spark.createDataFrame([("alice", 1, 1), ("bob", 1, 1), ("bob", 2, 2)],
                               "entity string, title_id bigint, rk int")
    kept = retrieval.passages(ents, nn, know).orderBy("pos").collect()
    assert [(r.pos, r.text) for r in kept] == [(0, "One. "), (1, "Two."), (2, "One. "), (3, "Two."), (4, "Three.")]
    once = retrieval.passages(ents, nn, know, dedupe_titles=True).orderBy("pos").collect()
    assert [(r.pos, r.text) for r in once] == [(0, "One. "), (1, "Two."), (2, "Three.")]


def test_verification_prompt_format(spark):
    df = spark.createDataFrame([(" Alice likes tea. ", [(2, "second"), (1, "first")])],
                               "fact string, ranked array<struct<rk:int,text:string>>")
    got = df.select(P.verification_prompt(F.col("fact"), F.col("ranked"))).first()[0]
    line = P.VERIFY_LINE
    assert got == (P.VERIFY_HEADER + line[0] + "first" + line[1] + line[0] + "second" + line[1]
                   + P.VERIFY_QUESTION[0] + "Alice likes tea." + P.VERIFY_QUESTION[1])


def test_payloads_and_responses(spark):
    df = spark.createDataFrame([("hi",)], "p string")
    row = df.select(A.completion_payload(F.col("p"), "m", 0.0).alias("c"),
                    A.embedding_payload(F.col("p"), "e", 768).alias("e")).first()
    assert json.loads(row.c) == {"model": "m", "messages": [{"role": "user", "content": "hi"}], "temperature": 0.0}
    assert json.loads(row.e) == {"prompt": "hi", "model": "e", "dimensionality": 768}
    bodies = spark.createDataFrame([
        ('{"choices":[{"message":{"content":"True"}}],"usage":{"estimated_cost":0.5}}', None),
        ('{"choices":[]}', None),
        ('{"embedding":[0.5,1.5]}', None),
        (None, "timeout"),
    ], "body string, error string")
    c = bodies.select(A.parse_response(F.col("body"), A.COMPLETION).alias("r"), "error")
    rows = c.select("r.content", "r.cost", A.call_status(F.col("error"), F.col("r.content")).alias("s")).collect()
    assert [(r.content, r.cost, r.s) for r in rows] == [
        ("True", 0.5, "ok"), (None, None, "failed"), (None, None, "failed"), (None, None, "failed")]
    e = bodies.select(A.parse_response(F.col("body"), A.EMBEDDING).alias("r")).collect()
    assert e[2].r.embedding == [0.5, 1.5] and e[0].r.embedding is None
