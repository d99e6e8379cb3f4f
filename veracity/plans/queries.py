"""Registered queries: one per operator row of the survey, over whole tables.

Each callable takes (spark, sf_dir) and returns a DataFrame with flat columns,
integers as bigint and doubles rounded, so that ``veracity.plans.oracle``
can check it value for value.  Queries of one session over the same input
files ask the same ``ScoringRun`` for its stages; a changed file starts a new one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.functions import answers as A
from veracity.functions import prompts as P
from veracity.functions import segment as SG
from veracity.functions import text as T
from veracity.operators import bm25 as BM
from veracity.operators import entities as EN
from veracity.operators import facts as FX
from veracity.operators import index as IX
from veracity.operators import inference as IN
from veracity.operators import knn as KN
from veracity.operators import retrieval as RT
from veracity.operators import scoring as SC
from veracity.plans import scorer as SR
from veracity.session import Store, files_of
from veracity.sources import fixtures as FXT
from veracity.sources import readers as RD

IVF_NPROBE = 2
SHARD_CAPACITY_TEST = 100
SHELL_TEST = 64
_ONCE = {"max_attempts": 1, "retry_delay": 0.0}
_TABLES = ("conversations", "documents", "embeddings", "events")
_RUNS: dict[tuple, SR.ScoringRun] = {}


def _run(spark: SparkSession, sf_dir: str, kind: str = "offline") -> SR.ScoringRun:
    """This session's run over the input files as they are now."""
    files = files_of(spark, *[f"{sf_dir}/{t}.parquet" for t in _TABLES])
    key = (spark.sparkContext.applicationId, kind, files)
    if key not in _RUNS:
        know, vectors = FXT.knowledge(spark, sf_dir), FXT.title_vectors(spark, sf_dir)
        source = RD.KnowledgeSource(know, vectors, IX.cell_centroids(vectors))
        run = SR.ScoringRun(FXT.generations(spark, sf_dir), source, gazetteer=FXT.gazetteer(know))
        if kind == "replayed":
            log = FXT.call_log(spark, sf_dir)
            texts = FX.sentence_extractor(run.generations).withColumnRenamed("response", "content")
            run = replace(run, extract=FXT.Replay(log, texts), verify=FXT.Replay(log))
        _RUNS[key] = run
    return _RUNS[key]


def reset_runs() -> None:
    """Forget the session's runs and delete their stage tables."""
    for run in _RUNS.values():
        run.store.delete()
    _RUNS.clear()


def read_generations(spark, sf_dir):
    """The assistant turns written as JSON lines and read with the strict reader."""
    path = f"{Store(spark).path}/generations"
    FXT.generations(spark, sf_dir).select(F.to_json(F.struct(F.col("text").alias("output"), "model")).alias("value")).write.text(path)
    return RD.read_generations(spark, path).select("text")


def generation_lines(spark, sf_dir):
    """The assistant turns in order, written to several files of JSON lines, with the places that the reader gives them."""
    path = f"{Store(spark).path}/generations"
    rows = FXT.generations(spark, sf_dir).repartitionByRange(5, "gen_id").sortWithinPartitions("gen_id")
    rows.select(F.to_json(F.struct(F.col("text").alias("output"), F.col("gen_id").alias("turn"))).alias("value")).write.text(path)
    return RD.read_generations(spark, path).select(F.col("gen_id").alias("place"), "text")


def read_knowledge(spark, sf_dir):
    """Titles and texts written without ids and read with the table reader."""
    path = f"{Store(spark).path}/knowledge"
    FXT.knowledge(spark, sf_dir).select("title", "text").write.parquet(path)
    return RD.read_knowledge(spark, path).select("title", "text")


def knowledge_source(spark, sf_dir):
    """The checked source, a row for each title with or without a vector."""
    source = _run(spark, sf_dir).source.validate()
    return source.docs.select("title_id", "title").join(
        source.vectors.select("title_id", F.col("cell").cast("long").alias("cell")), "title_id", "left")


def knowledge_titles(spark, sf_dir):
    return RT.knowledge_titles(_run(spark, sf_dir).source.docs)


def paragraphs(spark, sf_dir):
    return FX.paragraph_rows(FXT.generations(spark, sf_dir)).select(
        "gen_id", F.col("para_id").cast("long"), "paragraph")


def sentence_split(spark, sf_dir):
    return FX.sentence_rows(FXT.generations(spark, sf_dir)).select(
        "gen_id", F.col("sent_id").cast("long"), "sentence")


def sentence_segments(spark, sf_dir):
    """P5 by the rule cascade."""
    return FXT.generations(spark, sf_dir).select("gen_id", F.posexplode(SG.segments(F.col("text"))).alias("sent_id", "sentence")).select(
        "gen_id", F.col("sent_id").cast("long"), "sentence")


def paragraph_breaks(spark, sf_dir):
    return FX.paragraph_breaks(FXT.generations(spark, sf_dir)).select(
        "gen_id", F.col("para_id").cast("long"), F.col("break_at").cast("long"))


def parse_facts(spark, sf_dir):
    return _run(spark, sf_dir).raw_facts.select("gen_id", F.col("fact_id").cast("long"), "fact")


def dedupe_facts(spark, sf_dir):
    return _run(spark, sf_dir).facts.select("gen_id", F.col("fact_id").cast("long"), "fact")


def extraction_prompts(spark, sf_dir):
    return FXT.generations(spark, sf_dir).select("gen_id", P.extraction_prompt(F.col("text")).alias("prompt"))


def sentence_prompts(spark, sf_dir):
    sents = FX.paragraph_sentences(FXT.generations(spark, sf_dir))
    return sents.select("gen_id", F.col("sent_id").cast("long"), P.sentence_prompt(F.col("sentence")).alias("prompt"))


def sentence_facts(spark, sf_dir):
    res = SR.sentence_facts(FXT.generations(spark, sf_dir), SR.offline_sentence_backend)
    return res.facts.select("gen_id", F.col("sent_id").cast("long"), F.col("fact_id").cast("long"), "fact")


def fact_entities(spark, sf_dir):
    r = _run(spark, sf_dir)
    return EN.fact_entities(r.facts, r.tagged).select("gen_id", F.col("fact_id").cast("long"), "entity")


def distinct_entities(spark, sf_dir):
    return _run(spark, sf_dir).gen_entities


def _knn_out(df):
    return df.select("entity", "title_id", F.col("rk").cast("long"), F.round("d2", 6).alias("d2"))


def knn_exact(spark, sf_dir):
    r = _run(spark, sf_dir)
    return _knn_out(KN.knn_join(r.entity_vectors, r.source.vectors, r.k))


def knn_bounded(spark, sf_dir):
    """J1 by bounds, over the cells by label in small shells."""
    r = _run(spark, sf_dir)
    return _knn_out(KN.bounded_knn_join(r.entity_vectors, r.source.vectors, r.centroids, r.k, target_block=SHELL_TEST))


def lloyd_cells(spark, sf_dir):
    """Two Lloyd steps from the first vector of each label, a row for each number of the centroids."""
    r, store = _run(spark, sf_dir), Store(spark)
    start = r.source.vectors.groupBy("cell").agg(F.min_by(F.transform("embedding", lambda x: x.cast("double")), "title_id").alias("centroid"))
    cells = store.keep("start", start)
    for i in range(2):
        cells = store.keep(f"cells_{i}", IX.lloyd_step(r.source.vectors, cells))
    return cells.select(F.col("cell").cast("long").alias("cell"), F.posexplode("centroid").alias("dim", "x")).select(
        "cell", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


def knn_ivf(spark, sf_dir):
    r = _run(spark, sf_dir)
    return _knn_out(KN.ivf_knn_join(r.entity_vectors, r.source.vectors, r.centroids, r.k, IVF_NPROBE))


def neighbours(spark, sf_dir):
    """J2 as the scoring run uses it: the source's own number of probed cells."""
    return _knn_out(_run(spark, sf_dir).neighbours)


def ivf_assign(spark, sf_dir):
    r = _run(spark, sf_dir)
    return IX.assign_cells(r.source.vectors, r.centroids).select("title_id", F.col("cell").cast("long"))


def vector_index(spark, sf_dir):
    """Vectors with their cells written as two shards, one of them twice, and read back."""
    r, path = _run(spark, sf_dir), f"{Store(spark).path}/index"
    assigned = IX.assign_cells(r.source.vectors, r.centroids)
    for shard in (0, 1, 1):
        IX.write_index(assigned.where(F.col("title_id") % 2 == shard), path, shard, cell_rows=SHARD_CAPACITY_TEST)
    return IX.read_index(spark, path).select("title_id", F.col("cell").cast("long").alias("cell"), F.size("embedding").cast("long").alias("n_dims"))


def index_snapshots(spark, sf_dir):
    """An index built in one job, then its shard 1 written again without its odd cells; both snapshots as they read."""
    r, path = _run(spark, sf_dir), f"{Store(spark).path}/index"
    assigned = IX.assign_cells(r.source.vectors, r.centroids)
    first = IX.write_shards(assigned, path, SHARD_CAPACITY_TEST, cell_rows=SHARD_CAPACITY_TEST)
    of_shard = F.floor(F.col("title_id") / SHARD_CAPACITY_TEST) == 1
    second = IX.write_index(assigned.where(of_shard & (F.col("cell") % 2 == 0)), path, 1, cell_rows=SHARD_CAPACITY_TEST)
    rows = [IX.read_index(spark, path, n).select(F.lit(n).cast("long").alias("snapshot"), "title_id", F.col("cell").cast("long").alias("cell"),
                                                 F.size("embedding").cast("long").alias("n_dims")) for n in (first, second)]
    return rows[0].unionByName(rows[1])


def index_shards(spark, sf_dir):
    return IX.index_shards(_run(spark, sf_dir).source.docs, SHARD_CAPACITY_TEST)


def missing_vectors(spark, sf_dir):
    r = _run(spark, sf_dir)
    return IX.missing_vectors(r.source.docs, r.source.vectors)


def embed_titles(spark, sf_dir):
    """Every title through an embedding service; a title it refuses would stop the build."""
    titles = _run(spark, sf_dir).source.docs.where(F.length("title") != 13)
    got = IX.embed_titles(titles, FXT.vector_service, **_ONCE)
    return got.select("title_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


def retrieved_texts(spark, sf_dir):
    r = _run(spark, sf_dir)
    hits = r.gen_entities.join(r.neighbours.select("entity", "title_id", "rk"), "entity")
    return RT.retrieve_texts(hits, r.source.docs, r.text_ids).select(
        "gen_id", "entity", F.col("rk").cast("long"), "title_id", "text_id")


def passages(spark, sf_dir):
    return _run(spark, sf_dir).passages.select("gen_id", F.col("pos").cast("long"), "title_id", "text")


def tokenize(spark, sf_dir):
    return _run(spark, sf_dir).passages.select(
        "gen_id", F.col("pos").cast("long"), F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


def bm25_idf(spark, sf_dir):
    return _run(spark, sf_dir).idf.select("gen_id", "token", F.round("idf", 6).alias("idf"))


def bm25_top5(spark, sf_dir):
    return _run(spark, sf_dir).top.select("gen_id", F.col("fact_id").cast("long"), F.col("pos").cast("long"),
                                          F.col("rk").cast("long"), F.round("score", 6).alias("score"))


def verification_prompts(spark, sf_dir):
    return _run(spark, sf_dir).prompts.select("gen_id", F.col("fact_id").cast("long"), "prompt")


def payloads(spark, sf_dir):
    """P10: request bodies for extraction and for embedding."""
    return FXT.generations(spark, sf_dir).select(
        "gen_id", A.completion_payload(F.concat(F.lit("m"), F.length("text").cast("string")), "judge", 0.0).alias("completion"),
        A.embedding_payload(F.concat(F.lit("e"), F.length("text").cast("string")), "embedder").alias("embedding"))


def lexical_answers(spark, sf_dir):
    return _run(spark, sf_dir).answers.select("gen_id", F.col("fact_id").cast("long"), "answer")


def parse_answers(spark, sf_dir):
    return FXT.call_log(spark, sf_dir).select(F.col("row").alias("request_id"), A.parse_answer(F.col("answer")).alias("decision"))


def decisions(spark, sf_dir):
    return _run(spark, sf_dir, "replayed").decided.select("gen_id", F.col("fact_id").cast("long"), "decision")


def decisions_map(spark, sf_dir):
    """A10: decided facts per generation, flattened to (gen_id, fact, decision)."""
    r = _run(spark, sf_dir, "replayed")
    return SC.decisions_map(r.decided, r.facts).select("gen_id", F.explode("decisions").alias("fact", "decision"))


def responses(spark, sf_dir):
    r = FXT.call_log(spark, sf_dir).withColumn("_r", A.parse_response(F.col("body"), A.COMPLETION))
    status = A.call_status(F.col("error"), F.col("_r.content"))
    return r.select(F.col("row").alias("request_id"), F.col("_r.content").alias("content"),
                    F.round(F.col("_r.cost"), 6).alias("cost"), status.alias("status"))


def call_report(spark, sf_dir):
    return SC.call_report(_run(spark, sf_dir, "replayed").calls).select(
        "status", "n_calls", F.round("cost", 6).alias("cost"))


def factual_precision(spark, sf_dir):
    """M8 offline: ``score`` over all generations, those it could score."""
    r = _run(spark, sf_dir)
    r.source.validate()
    return r.precision.join(r.result().scores.where(F.col("status").isin("ok", "undecided")).select("gen_id"), "gen_id", "left_semi")


def scores_all(spark, sf_dir):
    """M8 with replayed model calls: every generation with status, score, cost and time."""
    return _run(spark, sf_dir, "replayed").result().scores.select(
        "gen_id", "status", "score", F.round("cost", 6).alias("cost"), "process_time")


def run_summary(spark, sf_dir):
    return SC.run_summary(_run(spark, sf_dir, "replayed").result().scores)


def complete_batch(spark, sf_dir):
    """M1, M3: every verification prompt through a completion service that refuses some and leaves some empty."""
    reqs = _run(spark, sf_dir).prompts
    calls = IN.complete(reqs, FXT.reply_service, keys=("gen_id", "fact_id"), **_ONCE)
    return calls.select("gen_id", F.col("fact_id").cast("long"), "content", F.round("cost", 6).alias("cost"), "error", "status")


def complete_rounds(spark, sf_dir):
    """M3: every verification prompt in up to 4 rounds, at most 16 calls under way, through a service that refuses each a known number of times."""
    run = _run(spark, sf_dir)
    calls = IN.call_rounds(IN.complete, run.prompts, FXT.StubbornService(), Store(spark), "calls", keys=("gen_id", "fact_id"), max_attempts=4,
                           retry_delay=0.0, max_under_way=16)
    return calls.select("gen_id", F.col("fact_id").cast("long"), "content", F.round("cost", 6).alias("cost"), "error",
                        F.col("attempts").cast("long").alias("attempts"), "status")


def embed_all_titles(spark, sf_dir):
    """Every title through an embedding service that refuses none."""
    got = IX.embed_titles(_run(spark, sf_dir).source.docs, FXT.open_vector_service, **_ONCE)
    return got.select("title_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


def embed_batch(spark, sf_dir):
    """M2: every distinct name of the batch through an embedding service that refuses some."""
    names = _run(spark, sf_dir).gen_entities.select("entity").distinct()
    out = IN.embed(names, FXT.vector_service, keys=("entity",), text_col="entity", **_ONCE)
    return out.select("entity", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "error", "status")


def tag_batch(spark, sf_dir):
    """M4: every fact through a tagging service, all spans with labels."""
    tags = IN.tag_entities(_run(spark, sf_dir).facts, FXT.tag_service, **_ONCE)
    return tags.select("gen_id", F.col("fact_id").cast("long"), "entity", "label")


def person_tags(spark, sf_dir):
    """The distinct person spans of the tagging service."""
    tags = IN.tag_entities(_run(spark, sf_dir).facts, FXT.tag_service, **_ONCE)
    return EN.person_tags(tags).select("gen_id", F.col("fact_id").cast("long"), "entity").distinct()


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    read_generations, generation_lines, read_knowledge, knowledge_source, knowledge_titles, paragraphs, sentence_split, sentence_segments, paragraph_breaks,
    parse_facts, dedupe_facts, extraction_prompts, sentence_prompts, sentence_facts, fact_entities, distinct_entities,
    knn_exact, knn_bounded, lloyd_cells, knn_ivf, neighbours, ivf_assign, vector_index, index_snapshots, index_shards, missing_vectors, embed_titles, retrieved_texts,
    passages, tokenize, bm25_idf, bm25_top5, verification_prompts, payloads, lexical_answers, parse_answers, decisions,
    decisions_map, responses, call_report, factual_precision, scores_all, run_summary, complete_batch, complete_rounds, embed_all_titles, embed_batch,
    tag_batch, person_tags)}
