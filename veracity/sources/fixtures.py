"""Views that map the driver's test tables onto the engine's input schemas.

These only re-shape rows (rename, derive ids, pick columns); none of the
scoring work happens here.  The oracle SQL builds the same views as CTEs.

* ``generations``   gen_id, model, text      - assistant turns of ``conversations``
* ``knowledge``     title_id, title, text    - all ``documents``
* ``title_vectors`` title_id, cell, embedding - ``embeddings`` of documents
* ``gazetteer``     entity, title_id          - distinct titles, apart from case
* ``call_log``      row, answer, body, cost, latency_s, error - from ``events``

``Replay`` and the ``*_service`` functions stand in for remote models: they
answer requests from the call log or by a plain rule, so that the call layer runs
on real rows with known results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.functions.answers import COMPLETION, call_status, parse_response
from veracity.functions.text import title_of
from veracity.operators.skew import few
from veracity.session import spread

MODEL_RUNS = 3            # generations are spread over three model runs, as in the experiments
GEN_ID_STRIDE = 1000      # gen_id = conv_id * 1000 + turn
ANSWER_SHAPES = ["True", "False.", "TRUE or FALSE", "untrue", "cannot say", None]
LOG_ROWS = 1 << 21        # distinct rows of the log that go to all of it
LOG_STEP = 31             # a request reads row (gen_id * LOG_STEP + slot) mod rows of the log


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    return spread(conv.select((F.col("conv_id") * GEN_ID_STRIDE + F.col("turn")).alias("gen_id"),
                              F.concat(F.lit("m"), (F.col("conv_id") % MODEL_RUNS).cast("string")).alias("model"),
                              F.col("text")), "gen_id")


def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("title_id"), title_of(F.col("text")).alias("title"), "text")


def title_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("title_id"))
    vecs = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("title_id"), F.col("label").alias("cell"), "embedding")
    return vecs.join(docs, "title_id", "left_semi")


def gazetteer(knowledge_df: DataFrame) -> DataFrame:
    """One row per non-empty title, apart from case: its first spelling in order and its smallest title_id.

    Stands in for a list of people: the test prose is invented, so no real name
    occurs in it.  The vector of that title is the entity's vector.
    """
    return (knowledge_df.where(F.col("title") != "").groupBy(F.lower("title").alias("key"))
            .agg(F.min("title").alias("entity"), F.min("title_id").alias("title_id")).select("entity", "title_id"))


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded model calls, one per event: every answer shape and call outcome.

    answer by ``event_id % 6``; cost = value / 1000 (missing when
    ``event_id % 5 = 0``); latency = value / 10; ``error`` for error events;
    ``body`` is the completion response JSON built from answer and cost.
    """
    ev = table(spark, sf_dir, "events")
    shape = F.col("event_id") % len(ANSWER_SHAPES)
    answer = F.lit(None).cast("string")
    for i, a in reversed(list(enumerate(ANSWER_SHAPES))):
        if a is not None:
            answer = F.when(shape == i, F.lit(a)).otherwise(answer)
    cost = F.when(F.col("event_id") % 5 == 0, F.lit(None).cast("double")).otherwise(F.col("value") / 1000)
    error = F.when(F.col("event_type") == "error",
                   F.concat(F.lit("HTTP 500 on call "), F.col("event_id").cast("string")))
    base = ev.select(F.col("event_id").alias("row"), answer.alias("answer"),
                     cost.alias("cost"), (F.col("value") / 10).alias("latency_s"), error.alias("error"))
    body = F.to_json(F.struct(
        F.array(F.struct(F.struct(F.col("answer").alias("content")).alias("message"))).alias("choices"),
        F.struct(F.col("cost").alias("estimated_cost")).alias("usage")))
    return base.select("row", "answer", F.when(F.col("error").isNull(), body).alias("body"),
                       "cost", "latency_s", "error")


class Replay:
    """Completion backend over whole tables: each request gets a row of the call
    log, whose body is parsed as a live reply would be (P11, P12).

    With ``texts`` (gen_id, content), a call that is ok answers with its
    generation's text instead of the log's.
    """

    over_table = True

    def __init__(self, log: DataFrame, texts: DataFrame | None = None):
        self.log, self.texts = log, texts

    def __call__(self, requests: DataFrame) -> DataFrame:
        n = self.log.select(F.count(F.lit(1))).scalar()
        row = F.pmod(F.col("gen_id") * LOG_STEP + F.col("slot"), n)
        asked = requests.select("gen_id", "slot", row.alias("row"))
        # replies that nobody asks for stay where they are
        log = self.log.select("row", "body", "error", "latency_s").join(few(asked.select("row").distinct(), LOG_ROWS), "row", "left_semi")
        joined = asked.join(log, "row", "left")
        parsed = joined.withColumn("_r", parse_response(F.col("body"), COMPLETION))
        status = call_status(F.col("error"), F.col("_r.content"))
        missing = F.col("body").isNull() & F.col("error").isNull()
        calls = parsed.select(
            "gen_id", "slot", F.col("_r.content").alias("content"),
            F.when(status == "ok", F.col("_r.cost")).otherwise(F.lit(0.0)).alias("cost"),
            F.when(missing, F.lit("no reply")).otherwise(F.col("error")).alias("error"),
            F.lit(1).alias("attempts"), F.coalesce(F.col("latency_s"), F.lit(0.0)).alias("latency_s"),
            status.alias("status"))
        if self.texts is None:
            return calls
        known = calls.drop("content").join(self.texts, "gen_id", "left")
        return known.select(*calls.columns[:2], F.when(F.col("status") == "ok", F.col("content")).alias("content"), *calls.columns[3:])


def reply_service(prompts: list[str]) -> list:
    """By the prompt's length: True, False, an empty reply, or a refused call."""
    out: list = []
    for p in prompts:
        kind = len(p) % 7
        if kind == 6:
            out.append(RuntimeError("refused"))
        else:
            out.append({"content": None if kind == 5 else str(kind % 2 == 0), "cost": len(p) / 1000})
    return out


class StubbornService:
    """Refuses a prompt as many times as its length modulo 6 says, then says True or False by the length."""

    def attempt(self, n: int):
        def ask(prompts: list[str]) -> list:
            return [RuntimeError(f"refused {n}") if len(p) % 6 >= n else {"content": str(len(p) % 2 == 0), "cost": len(p) / 1000} for p in prompts]

        return ask


def vector_service(texts: list[str]) -> list:
    """(length, vowels) of each text; texts of 13 characters are refused."""
    return [RuntimeError("refused") if len(t) == 13 else [float(len(t)), float(sum(t.count(v) for v in "aeiou"))] for t in texts]


def open_vector_service(texts: list[str]) -> list:
    """(length, vowels) of each text."""
    return [[float(len(t)), float(sum(t.count(v) for v in "aeiou"))] for t in texts]


def tag_service(facts: list[str]) -> list:
    """Every blank-separated word: PER if it has four characters, else MISC."""
    return [[(w, "PER" if len(w) == 4 else "MISC") for w in f.split(" ")] for f in facts]
