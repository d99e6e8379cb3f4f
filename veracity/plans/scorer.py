"""End-to-end scoring (M8) and sentence-mode fact generation (M9).

``ScoringRun`` is the one wiring of the pipeline: generations -> facts -> names
-> nearest titles -> passages -> top passages -> answers -> scores.  Every stage
that has several readers is written once to the run's store and read from there;
a stage runs when it is first asked for, and nothing else starts a job.  ``score``
asks for all of them and returns two DataFrames: per-fact decisions and
per-generation scores.  The registered queries ask the same run for the stage
they show.

Backends are pluggable; the defaults are offline and pure Spark (M7 extractor,
gazetteer tagging, title vectors for names, lexical judge).  A model backend
runs in ``mapInPandas``; its calls are a stage too, so no request is sent twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.functions import prompts as P
from veracity.functions import text as T
from veracity.operators import bm25, entities, facts as FX, judge, knn, retrieval, scoring
from veracity.operators.inference import call_rounds, complete, embed, persist_calls, tag_calls, tag_rows
from veracity.session import Store, ship_package
from veracity.sources.readers import KnowledgeSource, require


@dataclass
class ScoreResult:
    decisions: DataFrame   # gen_id, fact_id, fact, decision
    scores: DataFrame      # gen_id, model, status, score, cost, process_time
    calls: dict[str, DataFrame] = field(default_factory=dict)  # of each model stage; ``done`` of a later run
    store: Store | None = None  # the stage tables; delete() when the results are no longer read

    def write(self, path: str, mode: str = "overwrite") -> None:
        """S7 sink: both tables as Parquet; scores partitioned by model run."""
        self.decisions.write.mode(mode).parquet(f"{path}/decisions")
        self.scores.write.mode(mode).partitionBy("model").parquet(f"{path}/scores")


def offline_sentence_backend(sentences: DataFrame) -> DataFrame:
    """Offline sentence-mode extractor: the reply to a sentence is the sentence as one bullet."""
    return sentences.select("gen_id", "sent_id",
                            F.concat(F.lit(T.FACT_BULLET), T.strip(F.col("sentence"))).alias("response"))


def model_sentence_backend(backend: Callable, **call_opts) -> Callable[[DataFrame], DataFrame]:
    """Route sentence prompts (P2) through a completion backend (M1)."""
    def run(sentences: DataFrame) -> DataFrame:
        reqs = sentences.select("gen_id", "sent_id", P.sentence_prompt(F.col("sentence")).alias("prompt"))
        calls = persist_calls(complete(reqs, backend, keys=("gen_id", "sent_id"), **call_opts))
        return calls.where(F.col("status") == "ok").select("gen_id", "sent_id", F.col("content").alias("response"))
    return run


@dataclass
class SentenceFacts:
    facts: DataFrame        # gen_id, sent_id, fact_id, fact
    breaks: DataFrame       # gen_id, para_id, break_at


def sentence_facts(generations: DataFrame, backend: Callable[[DataFrame], DataFrame]) -> SentenceFacts:
    """M9: paragraphs -> sentences -> one prompt each -> facts keyed by
    (gen_id, sent_id), plus paragraph breaks.  Replies are joined to their
    sentence by id (D14), so repeated sentences stay apart."""
    sents = FX.paragraph_sentences(generations)
    replies = backend(sents)
    fx = replies.select("gen_id", "sent_id", F.posexplode(T.parse_facts(F.col("response"))).alias("fact_id", "fact"))
    return SentenceFacts(fx, FX.paragraph_breaks(generations))


def verification_prompts(facts: DataFrame, top: DataFrame, passages: DataFrame) -> DataFrame:
    """P3 for every fact with passages -> (gen_id, fact_id, prompt).  Each fact
    gathers at most ``n`` passages, so the collect is bounded."""
    return ranked_prompts(facts, top.join(passages.select("gen_id", "pos", "text"), ["gen_id", "pos"]))


def ranked_prompts(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """P3 from the texts of each fact's best passages (gen_id, fact_id, rk, text)."""
    ranked = texts.groupBy("gen_id", "fact_id").agg(F.collect_list(F.struct("rk", "text")).alias("ranked"))
    return ranked.join(facts, ["gen_id", "fact_id"]).select(
        "gen_id", "fact_id", P.verification_prompt(F.col("fact"), F.col("ranked")).alias("prompt"))


@dataclass
class ScoringRun:
    """A run over ``generations`` (gen_id bigint, text, model if there is one).

    * ``extract``: completion backend for fact extraction, else the offline M7 extractor.
    * ``tag``: tagger backend (spans with labels, P8 keeps PER), else ``gazetteer``.
    * names get vectors from ``source.embed_fn`` (M2) or, without it, from the
      gazetteer's title vectors.
    * ``verify``: completion backend for the True/False prompts, else the lexical judge.
    * ``exact``: exact kNN (J1); default is IVF (J2) with ``source.nprobe`` cells when centroids are given.
    * ``done``: calls of an earlier run by stage (extract, tag, embed, verify); its answers are used again.
    * ``path``: where the stage tables go, by default a new folder in the shared checkpoint folder.

    A completion backend with ``over_table = True`` gets the requests (gen_id, slot,
    prompt) as a DataFrame and returns the calls as one.
    """

    generations: DataFrame
    source: KnowledgeSource
    gazetteer: DataFrame | None = None
    extract: Callable | None = None
    tag: Callable | None = None
    verify: Callable | None = None
    k: int = 2
    n_passages: int = bm25.TOP_N
    exact: bool | None = None
    dedupe_titles: bool = False
    call_opts: dict = field(default_factory=dict)
    done: dict[str, DataFrame] = field(default_factory=dict)
    path: str | None = None

    def __post_init__(self):
        spark = self.generations.sparkSession
        ship_package(spark)
        require(self.generations, gen_id="bigint", text="string")
        if self.tag is None:
            if self.gazetteer is None:
                raise ValueError("either a tagger backend or a gazetteer is needed")
            require(self.gazetteer, entity="string", **({} if self.source.embed_fn else {"title_id": "bigint"}))
        if "model" not in self.generations.columns:
            self.generations = self.generations.withColumn("model", F.lit(None).cast("string"))
        self.store = Store(spark, self.path)

    def _complete(self, stage: str, requests: DataFrame, backend: Callable) -> DataFrame:
        if getattr(backend, "over_table", False):
            return self.store.keep(f"calls_{stage}", backend(requests))
        return self._calls(stage, complete, requests, backend, keys=scoring.KEYS)

    def _calls(self, stage: str, ask: Callable, requests: DataFrame, backend: Callable, **own) -> DataFrame:
        """A model stage.  A run that starts again on the same path asks only for what its log has no answer to."""
        name = f"calls_{stage}"
        return call_rounds(ask, requests, backend, self.store, name, done=self.done.get(stage), **own, **self.call_opts)

    # ---- facts (M7 or M1 + P1 + P6)
    @cached_property
    def extraction_calls(self) -> DataFrame | None:
        if self.extract is None:
            return None
        reqs = self.generations.select("gen_id", F.lit(scoring.EXTRACTION_SLOT).cast("long").alias("slot"),
                                       P.extraction_prompt(F.col("text")).alias("prompt"))
        return self._complete("extract", reqs, self.extract)

    @cached_property
    def responses(self) -> DataFrame:
        if self.extraction_calls is None:
            return FX.sentence_extractor(self.generations)
        return self.extraction_calls.where(F.col("status") == "ok").select("gen_id", F.col("content").alias("response"))

    @cached_property
    def raw_facts(self) -> DataFrame:
        return FX.explode_facts(self.responses)

    @cached_property
    def facts(self) -> DataFrame:
        return self.store.keep("facts", FX.dedupe_facts(self.raw_facts))

    # ---- names (M5 or M4 + P8)
    @cached_property
    def tag_calls(self) -> DataFrame | None:
        if self.tag is None:
            return None
        return self._calls("tag", tag_calls, self.facts, self.tag, keys=("gen_id", "fact_id"))

    @cached_property
    def tagged(self) -> DataFrame:
        if self.tag_calls is None:
            found = entities.gazetteer_entities(self.facts, self.known_names)
        else:
            found = entities.person_tags(tag_rows(self.tag_calls)).select("gen_id", "fact_id", "entity").distinct()
        return self.store.keep("tagged", found)

    @cached_property
    def known_names(self) -> DataFrame:
        return self.store.keep("names", self.gazetteer)

    @cached_property
    def gen_entities(self) -> DataFrame:
        return entities.distinct_entities(self.tagged)

    # ---- one vector per distinct name over the whole batch
    @cached_property
    def embed_calls(self) -> DataFrame | None:
        if self.source.embed_fn is None:
            return None
        names = self.gen_entities.select("entity").distinct()
        return self._calls("embed", embed, names.withColumn("text", F.col("entity")), self.source.embed_fn, keys=("entity",))

    @cached_property
    def entity_vectors(self) -> DataFrame:
        if self.embed_calls is not None:
            return self.embed_calls.where(F.col("status") == "ok").select("entity", "embedding")
        names = self.gen_entities.select("entity").distinct()
        return self.store.keep("entity_vectors", names.join(self.known_names.select("entity", "title_id"), "entity")
                               .join(self.source.vectors.select("title_id", "embedding"), "title_id").select("entity", "embedding"))

    # ---- nearest titles and their texts
    @cached_property
    def use_exact(self) -> bool:
        return self.exact if self.exact is not None else self.source.centroids is None

    @cached_property
    def centroids(self) -> DataFrame:
        return self.store.keep("centroids", self.source.centroids)

    @cached_property
    def probes(self) -> DataFrame:
        near = knn.probe_cells(self.entity_vectors, self.centroids, self.source.nprobe)
        return self.store.keep("probes", near.select("entity", "cell"))

    @cached_property
    def neighbours(self) -> DataFrame:
        if self.use_exact:
            return self.store.keep("neighbours", knn.knn_join(self.entity_vectors, self.source.vectors, self.k))
        return self.store.keep("neighbours", knn.search_cells(self.entity_vectors, self.source.vectors, self.probes, self.k))

    @cached_property
    def text_ids(self) -> DataFrame:
        return self.store.keep("text_ids", retrieval.first_text_ids(self.source.docs))

    @cached_property
    def title_hits(self) -> DataFrame:
        return retrieval.title_hits(self.gen_entities, self.neighbours, self.source.docs, self.dedupe_titles, self.text_ids)

    @cached_property
    def sentences(self) -> DataFrame:
        return self.store.keep("sentences", retrieval.title_sentences(self.source.docs, retrieval.hit_texts(self.neighbours, self.text_ids)))

    @cached_property
    def hits(self) -> DataFrame:
        return self.store.keep("hits", retrieval.placed_hits(self.title_hits, self.sentences))

    @cached_property
    def postings(self) -> DataFrame:
        return self.store.keep("postings", bm25.packed_postings(bm25.text_postings(self.sentences)))

    @property
    def passages(self) -> DataFrame:
        """All passages with their texts; no later stage reads them."""
        return retrieval.placed_passages(self.hits, self.sentences)

    @property
    def idf(self) -> DataFrame:
        return bm25.hit_idf(self.hits, self.postings, bm25.hit_stats(self.hits))

    # ---- verification (M6 or M1 + P3 + P11/P12 + J6)
    @cached_property
    def top(self) -> DataFrame:
        return self.store.keep("top", bm25.hits_topk(self.facts, self.hits, self.postings, self.n_passages, self.store, in_parts=True))

    def top_texts(self, sentences: DataFrame) -> DataFrame:
        """The texts of each fact's best passages, all of a fact in one place."""
        return retrieval.texts_at(self.top, sentences, ["gen_id", "fact_id", "rk"], ["gen_id", "fact_id"])

    @cached_property
    def prompts(self) -> DataFrame:
        return ranked_prompts(self.facts, self.top_texts(self.sentences))

    @cached_property
    def answers(self) -> DataFrame:
        return judge.judge_texts(self.facts, self.top_texts(self.sentences.withColumn("sentence", F.lower("sentence"))))

    @cached_property
    def verify_calls(self) -> DataFrame | None:
        if self.verify is None:
            return None
        reqs = self.prompts.select("gen_id", scoring.slot_of(F.col("fact_id")).alias("slot"), "prompt")
        return self._complete("verify", reqs, self.verify)

    @cached_property
    def decided(self) -> DataFrame:
        if self.verify_calls is None:
            return self.store.keep("decided", scoring.answers_to_decisions(self.answers))
        judged = self.top.select("gen_id", "fact_id").distinct()
        return self.store.keep("decided", scoring.decisions(judged, self.verify_calls))

    # ---- results
    @cached_property
    def precision(self) -> DataFrame:
        return scoring.factual_precision(self.decided)

    @cached_property
    def calls(self) -> DataFrame | None:
        """The completion calls of the run, for cost, time and the call report."""
        own = [c.select(*scoring.KEYS, "content", "cost", "error", "attempts", "latency_s", "status")
               for c in (self.extraction_calls, self.verify_calls) if c is not None]
        return None if not own else own[0] if len(own) == 1 else own[0].unionByName(own[1])

    @cached_property
    def scores(self) -> DataFrame:
        status = (self.extraction_calls if self.extraction_calls is not None
                  else self.generations.withColumn("status", F.lit("ok"))).select("gen_id", "status")
        totals = scoring.calls_per_generation(self.calls) if self.calls is not None else None
        return self.store.keep("scores", scoring.assemble_scores(
            self.generations, status, self.facts, self.tagged, self.hits, self.precision, totals))

    @cached_property
    def decisions(self) -> DataFrame:
        return self.decided.join(self.facts, ["gen_id", "fact_id"]).select("gen_id", "fact_id", "fact", "decision")

    def result(self) -> ScoreResult:
        calls = {"extract": self.extraction_calls, "tag": self.tag_calls, "embed": self.embed_calls, "verify": self.verify_calls}
        return ScoreResult(self.decisions, self.scores, {k: v for k, v in calls.items() if v is not None}, self.store)


def score(generations: DataFrame, source: KnowledgeSource, **options) -> ScoreResult:
    """M8: factual precision of every generation; options as in ``ScoringRun``.
    The knowledge source must not be empty (S4)."""
    source.validate()
    return ScoringRun(generations, source, **options).result()
