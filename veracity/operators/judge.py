"""M6: offline judge standing in for the verifying model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.functions import text as T

SUPPORT_THRESHOLD = 0.5


def _ltokens(c):
    return F.array_distinct(T.tokens(F.lower(c)))


def lexical_judge(facts: DataFrame, top: DataFrame, passages: DataFrame,
                  threshold: float = SUPPORT_THRESHOLD) -> DataFrame:
    """Answer "True" when at least ``threshold`` of a fact's distinct lower-cased
    tokens occur in its top passages, else "False" -> (gen_id, fact_id, answer)."""
    texts = top.select("gen_id", "fact_id", "pos").join(passages.select("gen_id", "pos", F.lower("text").alias("text")), ["gen_id", "pos"], "left")
    return judge_texts(facts, texts, threshold)


def judge_texts(facts: DataFrame, texts: DataFrame, threshold: float = SUPPORT_THRESHOLD) -> DataFrame:
    """``lexical_judge`` with the lower-cased texts of each fact's top passages (gen_id, fact_id, text).

    A fact's few texts are gathered at the fact and their tokens compared there, so no row is made for a token.
    Facts given several times under one id are judged together."""
    words = texts.groupBy("gen_id", "fact_id").agg(F.array_distinct(F.flatten(F.collect_list(T.tokens(F.col("text"))))).alias("_words"))
    own = facts.select("gen_id", "fact_id", _ltokens(F.col("fact")).alias("_own")).where(F.size("_own") > 0)
    counted = own.join(words, ["gen_id", "fact_id"]).select(
        "gen_id", "fact_id", F.size("_own").alias("_all"), F.size(F.array_intersect("_own", "_words")).alias("_met"))
    share = counted.groupBy("gen_id", "fact_id").agg((F.sum("_met") / F.sum("_all")).alias("share"))
    return share.select("gen_id", "fact_id",
                        F.when(F.col("share") >= threshold, "True").otherwise("False").alias("answer"))
