"""The training-data pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs.  All but the last return
the columns they are given; the last returns the pieces of the packed texts.

Texts that are null, empty or without a letter go in the first stage, as no
language can be told.  Rows without an id are never near-duplicates of others.  Rows
given twice are kept or dropped together in every stage.  Other columns, of any
name, come through.  No documents give no pieces.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from veracity.llm import language_id, minhash_forest, mixing, packing, toxicity  # noqa: E402
from veracity.llm.common import stage, table  # noqa: E402
from veracity.llm.queries import MIX_WEIGHTS, domain_of  # noqa: E402

#: Below this probability no language is taken as found.
MIN_LANGUAGE = 0.5
#: Share of all tokens left that the mix takes; no text is taken twice.
MIX_SHARE = 0.9


def _new(docs: DataFrame, name: str) -> str:
    """A name that no column has."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose language is undetermined: without a letter, or with no language of at least MIN_LANGUAGE."""
    lang, score = _new(docs, "_lang"), _new(docs, "_score")
    found = language_id.predict(docs, language_id.fit(docs), lang_name=lang, score_name=score)
    return found.where((F.col(lang) != language_id.UNDETERMINED) & (F.col(score) >= MIN_LANGUAGE)).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are more likely toxic than not."""
    model, score = toxicity.fit(docs, table(spark, sf_dir, "labels")), _new(docs, "_score")
    return toxicity.score(docs, model, score_name=score).where(F.col(score) < 0.5).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near-duplicates."""
    gone = minhash_forest.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that a mix of MIX_SHARE of the tokens takes, by the target weights."""
    return mixing.mix(docs, domain_of(F.col("source")), MIX_WEIGHTS, share=MIX_SHARE, epochs=1, seed=1, keep_all=False)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of token ids."""
    return packing.pack(docs)


STAGES = [("language", language), ("toxicity", toxic), ("near_dedup", near_dedup), ("mixing", mix), ("packing", pack)]

#: SQL can't express the classifiers; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result over ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
