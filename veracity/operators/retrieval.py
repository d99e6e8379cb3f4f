"""From nearest titles to passages: J3, J4, W3, A12, D10, D11.

``passages`` numbers each generation's sentences densely in the order
(entity, rank, sentence index).  The numbering is a prefix sum over the title
*hits* of a generation (entities x k rows), joined back to the sentences of
each text, so no window ever runs over a generation's whole corpus.  Scoring
needs the numbers only: texts are fetched for the passages that are shown to a judge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veracity.functions import text as T
from veracity.operators.skew import few, salted_join
from veracity.session import Store, spread

#: Positions in a block when passages are looked up.
BLOCK = 64
#: Ids of texts that go to all texts when these are fetched.
TEXTS = 1 << 19
#: Places of sentences that go to all sentences when these are fetched, and characters of sentences that go to all places.
PLACES = 1 << 19
CHARACTERS = 1 << 26


def knowledge_titles(knowledge: DataFrame) -> DataFrame:
    """S2 + J3: vector id -> title."""
    return knowledge.select("title_id", "title")


def first_text_ids(knowledge: DataFrame) -> DataFrame:
    """Each title_id -> ``text_id``, the first (smallest id) document
    carrying the same title string: texts are looked up by title and the first
    one counts, so a hit on a repeated title yields that document.

    Grouping by title uses map-side partial aggregation, so a title shared by
    a third of all documents still collapses before the shuffle.
    """
    first = knowledge.groupBy("title").agg(F.min("title_id").alias("text_id"))
    return knowledge.select("title_id", "title").join(first, "title").select("title_id", "text_id")


def retrieve_texts(hits: DataFrame, knowledge: DataFrame, text_ids: DataFrame | None = None) -> DataFrame:
    """(gen_id, entity, rk, title_id) -> + text_id.

    A title without a text row is dropped here (D4); a generation left without passages is reported by
    the scorer as ``no_passages``.
    """
    text_ids = text_ids if text_ids is not None else first_text_ids(knowledge)
    return hits.join(text_ids, "title_id")


def title_sentences(knowledge: DataFrame, text_ids: DataFrame) -> DataFrame:
    """Sentences of each distinct text that was hit, with their number of tokens -> (text_id, idx, sentence, dl).

    Each text is segmented once however many generations retrieved it.  Texts that weren't hit stay where they
    are as long as the list of ids is short.
    """
    texts = (knowledge.select(F.col("title_id").alias("text_id"), "text")
             .join(few(text_ids.select("text_id").distinct(), TEXTS), "text_id"))
    cut = spread(texts, "text_id").select("text_id", F.posexplode(T.sentences(F.col("text"))).alias("idx", "sentence"))
    return cut.withColumn("dl", F.size(T.tokens(F.col("sentence"))))


def hit_texts(neighbours: DataFrame, text_ids: DataFrame) -> DataFrame:
    """The texts that some name leads to -> (text_id)."""
    return neighbours.select("title_id").join(text_ids, "title_id").select("text_id").distinct()


def title_hits(gen_entities: DataFrame, neighbours: DataFrame, knowledge: DataFrame, dedupe_titles: bool = False,
               text_ids: DataFrame | None = None) -> DataFrame:
    """The texts that each generation's names lead to -> (gen_id, entity, rk, title_id, text_id).

    By default a title hit through two entities is hit twice (D10);
    ``dedupe_titles=True`` keeps its first hit only.
    """
    hits = gen_entities.join(neighbours.select("entity", "title_id", "rk"), "entity")
    hits = retrieve_texts(hits, knowledge, text_ids)
    if dedupe_titles:
        first = Window.partitionBy("gen_id", "text_id").orderBy("entity", "rk")
        hits = hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return hits


def placed_hits(hits: DataFrame, sentences: DataFrame) -> DataFrame:
    """A12 without its texts: where each hit's sentences stand in their
    generation's corpus -> (gen_id, title_id, text_id, offset, n_sents, n_tokens).

    Sentence ``idx`` of the text is passage ``offset + idx``, in the order (entity, rank, sentence).
    Texts without a sentence drop out.
    """
    sizes = sentences.groupBy("text_id").agg(F.count(F.lit(1)).alias("n_sents"), F.sum("dl").alias("n_tokens"))
    # prefix sum over the (entities x k) hits of a generation, not over sentences
    w = Window.partitionBy("gen_id").orderBy("entity", "rk").rowsBetween(Window.unboundedPreceding, -1)
    return hits.join(sizes, "text_id").select(
        "gen_id", "title_id", "text_id", F.coalesce(F.sum("n_sents").over(w), F.lit(0)).alias("offset"), "n_sents", "n_tokens")


def text_counts(placed: DataFrame) -> DataFrame:
    """How many hits each text has -> (text_id, n)."""
    return placed.groupBy("text_id").agg(F.count(F.lit(1)).alias("n"))


def placed_passages(placed: DataFrame, sentences: DataFrame) -> DataFrame:
    """The BM25 corpus of every generation -> (gen_id, pos, title_id, text).

    A text that very many generations hit is dealt over salts."""
    rows = salted_join(placed, sentences, ["text_id"], text_counts(placed), "n", ["gen_id", "offset"])
    return rows.select("gen_id", (F.col("offset") + F.col("idx")).alias("pos"), "title_id", F.col("sentence").alias("text"))


def passage_texts(wanted: DataFrame, placed: DataFrame, sentences: DataFrame) -> DataFrame:
    """The texts of some passages (gen_id, pos) -> (gen_id, pos, text).

    Which hit a position belongs to is found by blocks of ``BLOCK`` positions: a hit is
    listed in each block that it reaches, at most ``BLOCK`` hits a block as each has a sentence."""
    block = lambda c: F.floor(c / BLOCK)
    last = F.col("offset") + F.col("n_sents") - 1
    reach = placed.select("gen_id", "text_id", "offset", last.alias("last"), F.explode(F.sequence(block(F.col("offset")), block(last))).alias("block"))
    at = wanted.select("gen_id", "pos").distinct().withColumn("block", block(F.col("pos"))).join(reach, ["gen_id", "block"]).where(
        F.col("pos").between(F.col("offset"), F.col("last"))).select("gen_id", "pos", "text_id", (F.col("pos") - F.col("offset")).cast("int").alias("idx"))
    return texts_at(at, sentences, ["gen_id", "pos"]).select("gen_id", "pos", "text")


def texts_at(rows: DataFrame, sentences: DataFrame, by: list[str], together: list[str] | None = None) -> DataFrame:
    """``rows`` (text_id, idx, ...) with the text of that sentence.

    Many rows have the same few sentences: as long as these are short together they go to the rows, which are dealt by ``together``
    before, if given, and so needn't move with their texts.  Else rows of a sentence that very many have are dealt by ``by``."""
    wanted = few(rows.select("text_id", "idx").distinct(), PLACES)
    held = sentences.select("text_id", "idx", F.col("sentence").alias("text")).join(wanted, ["text_id", "idx"], "left_semi")
    if (held.agg(F.sum(F.length("text"))).first()[0] or 0) <= CHARACTERS:
        return (rows.repartition(*together) if together else rows).join(F.broadcast(held), ["text_id", "idx"])
    counts = rows.groupBy("text_id", "idx").agg(F.count(F.lit(1)).alias("n"))
    return salted_join(rows, held, ["text_id", "idx"], counts, "n", by)


def passages(gen_entities: DataFrame, neighbours: DataFrame, knowledge: DataFrame,
             dedupe_titles: bool = False, text_ids: DataFrame | None = None, store: Store | None = None) -> DataFrame:
    """A12 from names and their nearest titles -> (gen_id, pos, title_id, text).

    ``gen_entities`` is (gen_id, entity); ``neighbours`` is (entity, title_id, rk).
    ``text_ids`` is a precomputed ``first_text_ids(knowledge)``, so a caller
    that already has it spares a pass over the knowledge titles.  The sentences of
    the texts that were hit and the hits are written once to ``store``.
    """
    store = store or Store(gen_entities.sparkSession)
    hits = title_hits(gen_entities, neighbours, knowledge, dedupe_titles, text_ids)
    sents = store.keep("sentences", title_sentences(knowledge, hits.select("text_id")))
    return placed_passages(store.keep("hits", placed_hits(hits, sents)), sents)
