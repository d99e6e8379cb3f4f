"""Fact rows: extraction output -> (gen_id, fact_id, fact), sentence mode pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veracity.functions import text as T


def sentence_extractor(generations: DataFrame, text_col: str = "text") -> DataFrame:
    """M7 offline extractor: the generation's sentences rendered as a ``- `` list.

    Returns (gen_id, response) - the shape a completion backend returns.
    """
    return generations.select("gen_id", T.render_bullets(T.sentences(F.col(text_col))).alias("response"))


def explode_facts(responses: DataFrame, response_col: str = "response",
                  keys: tuple[str, ...] = ("gen_id",)) -> DataFrame:
    """P6 + U1: parse each response and flatten -> (*keys, fact_id, fact)."""
    return responses.select(*keys, F.posexplode(T.parse_facts(F.col(response_col))).alias("fact_id", "fact"))


def dedupe_facts(facts: DataFrame, keys: tuple[str, ...] = ("gen_id",)) -> DataFrame:
    """A2: one row per distinct fact text of a generation, first position kept."""
    return facts.groupBy(*keys, "fact").agg(F.min("fact_id").alias("fact_id")).select(*keys, "fact_id", "fact")


def paragraph_rows(generations: DataFrame, text_col: str = "text") -> DataFrame:
    """P4 + W5: (gen_id, para_id, paragraph)."""
    return generations.select("gen_id", F.posexplode(T.paragraphs(F.col(text_col))).alias("para_id", "paragraph"))


def sentence_rows(generations: DataFrame, text_col: str = "text") -> DataFrame:
    """P5 + W5 over whole generations: (gen_id, sent_id, sentence)."""
    return generations.select("gen_id", F.posexplode(T.sentences(F.col(text_col))).alias("sent_id", "sentence"))


def paragraph_sentences(generations: DataFrame, text_col: str = "text") -> DataFrame:
    """Sentence mode: sentences of each paragraph, numbered across the generation.

    Returns (gen_id, para_id, sent_id, sentence).  ``sent_id`` is the running
    position over paragraphs (W4's prefix sum) plus the index in the paragraph;
    the prefix sum runs over one row per paragraph, not per sentence.
    """
    paras = paragraph_rows(generations, text_col).withColumn("sents", T.sentences(F.col("paragraph")))
    w = Window.partitionBy("gen_id").orderBy("para_id").rowsBetween(Window.unboundedPreceding, -1)
    offs = paras.withColumn("offset", F.coalesce(F.sum(F.size("sents")).over(w), F.lit(0)))
    return offs.select("gen_id", "para_id", F.posexplode("sents").alias("idx", "sentence"), "offset") \
        .select("gen_id", "para_id", (F.col("offset") + F.col("idx")).alias("sent_id"), "sentence")


def paragraph_breaks(generations: DataFrame, text_col: str = "text") -> DataFrame:
    """For each paragraph but the first, the number of sentences before it.

    Returns (gen_id, para_id, break_at); ``para_breaks`` as an array is
    ``collect_list`` of it ordered by para_id.
    """
    paras = paragraph_rows(generations, text_col).withColumn("n", F.size(T.sentences(F.col("paragraph"))))
    w = Window.partitionBy("gen_id").orderBy("para_id").rowsBetween(Window.unboundedPreceding, -1)
    return (paras.withColumn("break_at", F.sum("n").over(w)).where(F.col("para_id") > 0)
            .select("gen_id", "para_id", "break_at"))
