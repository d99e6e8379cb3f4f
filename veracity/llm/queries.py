"""The registered queries of the operators, each over its whole table with
production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.llm import (arc_to_warc, chunk_bpe, language_id, license_scan, minhash_forest, mixing, packing, pivot_index, repair_tokens,
                          topk_columns, toxicity, viterbi_repair, whitening)
from veracity.llm.common import held_out, table


def op1_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents`` at 5 words and similarity 0.75."""
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents"))


def op2_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of ``embeddings`` of equal labels at cosine 0.93."""
    return pivot_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_topk_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all ``embeddings`` for each whose id is divisible by 50."""
    return topk_columns.top_k(table(spark, sf_dir, "embeddings"))


def op4_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all ``documents`` packed into sequences of 1024 ids."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_license_patience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all ``documents`` with at least 80 % of their words aligned."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all ``documents``, written to Re-Pair shards and read from them."""
    return repair_tokens.read(repair_tokens.write(table(spark, sf_dir, "documents")))


#: Target weights of the mix: values not named have weight 1.
MIX_WEIGHTS = {
    "domain": {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0},
    "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0},
}


def domain_of(source):
    """Domain of a source: the rest of its number by four; sources without a number have none."""
    return F.concat(F.lit("d"), F.pmod(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int"), F.lit(4)).cast("string"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a mix of 60 % of all tokens takes each document, in at most 2 epochs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mixing.mix(docs, domain_of(F.col("source")), MIX_WEIGHTS, share=0.6, epochs=2, seed=1)
    return mixed.select("doc_id", F.col("domain_").alias("domain"), F.col("lang_").alias("lang"), F.col("source_").alias("source"),
                        F.col("n_tokens_").alias("n_tokens"), F.col("copies_").alias("copies"))


def op8_toxicity_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that a document is toxic, learnt from the labels not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` converted from ARC to WARC files and read from these."""
    return arc_to_warc.archive_pages(table(spark, sf_dir, "pages"))


def op10_language_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt from the rows not held out."""
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs.select("doc_id", "text"), language_id.fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings`` on the first 4 components of their distinct vectors' covariance, a row for each component."""
    white = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return white.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), "identity_error", "explained",
                        F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.col("explained")[F.col("at")].alias("explained"), "identity_error")


def op12_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded texts of all ``documents``, encoded by shared chunks."""
    return chunk_bpe.encode(table(spark, sf_dir, "documents"))


def op13_viterbi_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and least-cost repair of all ``conversations``, damaged row by row by a checksum."""
    rows = table(spark, sf_dir, "conversations")
    return viterbi_repair.audit(rows, viterbi_repair.damage(rows))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_forest": op1_minhash_forest,
    "op2_pivot_index": op2_pivot_index,
    "op3_topk_columns": op3_topk_columns,
    "op4_linear_grouping": op4_linear_grouping,
    "op5_license_patience": op5_license_patience,
    "op6_repair_tokens": op6_repair_tokens,
    "op7_mixing": op7_mixing,
    "op8_toxicity_nb": op8_toxicity_nb,
    "op9_arc_to_warc": op9_arc_to_warc,
    "op10_language_ftrl": op10_language_ftrl,
    "op11_whitening": op11_whitening,
    "op12_chunk_bpe": op12_chunk_bpe,
    "op13_viterbi_repair": op13_viterbi_repair,
}
