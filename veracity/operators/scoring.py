"""Decisions and scores: J6, A5-A11, P13, J9, U4.

Statuses of a generation (one per row of ``scores``):

* ``extraction_failed`` - the fact-extraction call failed (D21): score 0
* ``no_facts``          - the extraction gave no fact (D3): score 0
* ``no_entities``       - no fact names an entity (D2): score 0
* ``no_passages``       - retrieved titles had no text (D4): score 0
* ``undecided``         - every answer was undecided (D6): score NULL
* ``ok``                - score = mean of decided facts, 4 places half-even

Failures score 0 with time and cost 0, as the reference records them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.functions.answers import parse_answer

# ---- fixed values: decimals of published scores
SCORE_PLACES = 4
# ---- end of fixed values

# A request is known by two columns: its generation and its slot in it, 0 for
# the extraction and fact_id + 1 for the verification of a fact.
KEYS = ("gen_id", "slot")
EXTRACTION_SLOT = 0


def slot_of(fact_id):
    return fact_id.cast("long") + 1


def decisions(verify_requests: DataFrame, calls: DataFrame) -> DataFrame:
    """Attach each reply to its fact by its key, not by list position
    (D1): a failed call leaves its fact undecided -> (gen_id, fact_id, decision)."""
    replies = calls.select(*KEYS, F.when(F.col("status") == "ok", F.col("content")).alias("content"))
    return (verify_requests.withColumn("slot", slot_of(F.col("fact_id"))).join(replies, list(KEYS), "left")
            .select("gen_id", "fact_id", parse_answer(F.col("content")).alias("decision")))


def answers_to_decisions(answers: DataFrame) -> DataFrame:
    """P9 over (gen_id, fact_id, answer)."""
    return answers.select("gen_id", "fact_id", parse_answer(F.col("answer")).alias("decision"))


def factual_precision(decided: DataFrame) -> DataFrame:
    """A5: per generation, mean of decided facts rounded half-even to 4 places.

    -> (gen_id, n_decided, n_supported, score); score NULL when nothing was
    decided (the reference's NaN, D6)."""
    d = F.col("decision").cast("int")
    return decided.groupBy("gen_id").agg(
        F.count("decision").cast("long").alias("n_decided"),
        F.coalesce(F.sum(d), F.lit(0)).cast("long").alias("n_supported"),
        F.bround(F.avg(d), SCORE_PLACES).alias("score"))


def calls_per_generation(calls: DataFrame) -> DataFrame:
    """A6/A7/A8 per generation: cost (missing costs and failures add 0) and
    summed call latency."""
    return (calls.groupBy("gen_id").agg(
                F.sum(F.when(F.col("status") == "ok", F.coalesce("cost", F.lit(0.0))).otherwise(0.0)).alias("cost"),
                F.sum(F.coalesce("latency_s", F.lit(0.0))).alias("latency_s")))


def call_report(calls: DataFrame) -> DataFrame:
    """A6 + A11: calls and cost per outcome -> (status, n_calls, cost)."""
    return calls.groupBy("status").agg(
        F.count(F.lit(1)).cast("long").alias("n_calls"),
        F.sum(F.when(F.col("status") == "ok", F.coalesce("cost", F.lit(0.0))).otherwise(0.0)).alias("cost"))


def assemble_scores(generations: DataFrame, extraction: DataFrame, facts: DataFrame,
                    tagged: DataFrame, passages: DataFrame, precision: DataFrame,
                    call_totals: DataFrame | None = None) -> DataFrame:
    """J9 + P13: one row per generation, failures kept ->
    (gen_id, model, status, score, cost, process_time).

    ``extraction`` is (gen_id, status) of the extraction call; ``call_totals``
    is (gen_id, cost, latency_s) of all calls made for the generation.
    """
    n_facts = facts.groupBy("gen_id").agg(F.count(F.lit(1)).alias("_nf"))
    n_ents = tagged.where(F.col("entity").isNotNull()).groupBy("gen_id").agg(F.count(F.lit(1)).alias("_ne"))
    n_pass = passages.groupBy("gen_id").agg(F.count(F.lit(1)).alias("_np"))
    base = (generations.select("gen_id", "model")
            .join(extraction.select("gen_id", F.col("status").alias("_ext")), "gen_id", "left")
            .join(n_facts, "gen_id", "left").join(n_ents, "gen_id", "left")
            .join(n_pass, "gen_id", "left").join(precision, "gen_id", "left"))
    if call_totals is not None:
        base = base.join(call_totals, "gen_id", "left")
    else:
        base = base.withColumn("cost", F.lit(0.0)).withColumn("latency_s", F.lit(0.0))
    status = (F.when(F.coalesce(F.col("_ext"), F.lit("ok")) != "ok", "extraction_failed")
              .when(F.col("_nf").isNull(), "no_facts")
              .when(F.col("_ne").isNull(), "no_entities")
              .when(F.col("_np").isNull(), "no_passages")
              .when(F.coalesce(F.col("n_decided"), F.lit(0)) == 0, "undecided")
              .otherwise("ok"))
    failed = ~status.isin("ok", "undecided")
    return base.select(
        "gen_id", "model", status.alias("status"),
        F.when(failed, F.lit(0.0)).otherwise(F.col("score")).alias("score"),
        F.when(failed, F.lit(0.0)).otherwise(F.coalesce("cost", F.lit(0.0))).alias("cost"),
        F.when(failed, F.lit(0.0)).otherwise(F.bround(F.coalesce("latency_s", F.lit(0.0)), SCORE_PLACES))
        .alias("process_time"))


def run_summary(scores: DataFrame, by: str = "model") -> DataFrame:
    """A9 + U4: per run, mean score / time / cost to 4 places; failed and
    undecided generations count as 0 (D6)."""
    return scores.groupBy(by).agg(
        F.bround(F.avg(F.coalesce("score", F.lit(0.0))), SCORE_PLACES).alias("mean_score"),
        F.bround(F.avg(F.coalesce("process_time", F.lit(0.0))), SCORE_PLACES).alias("mean_time"),
        F.bround(F.avg(F.coalesce("cost", F.lit(0.0))), SCORE_PLACES).alias("mean_cost"))


def combine_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """U4: stack several model runs with a ``model`` column."""
    out = None
    for name, df in runs.items():
        df = df.withColumn("model", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def decisions_map(decided: DataFrame, facts: DataFrame) -> DataFrame:
    """A10: the reference's ``{fact: decision}`` per generation; undecided facts
    are left out, as in the reference."""
    rows = decided.where(F.col("decision").isNotNull()).join(facts, ["gen_id", "fact_id"])
    return rows.groupBy("gen_id").agg(
        F.map_from_entries(F.collect_list(F.struct("fact", "decision"))).alias("decisions"))
