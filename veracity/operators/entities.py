"""Names in facts: gazetteer tagging (M5), tag filter (P8), fact entities (J8), A1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.functions import text as T
from veracity.operators.skew import few, salted_join

PERSON = "PER"
#: First words of names that go to all facts.
FIRST_WORDS = 1 << 18


def name_index(gazetteer: DataFrame) -> DataFrame:
    """(first, n, gram, entity): each name's first word, number of words and words, lower-cased
    and without the punctuation around them."""
    names = gazetteer.select("entity", T.words(F.col("entity")).alias("w")).where(F.size("w") > 0)
    return names.select(F.lower(F.col("w")[0]).alias("first"), F.size("w").alias("n"), F.lower(F.array_join("w", " ")).alias("gram"), "entity")


def fact_runs(facts: DataFrame, names: DataFrame) -> DataFrame:
    """(gen_id, fact_id, gram): the runs of a fact's words that may be a name of ``name_index``.

    A run begins with a capital, and with a word that some name begins with; it is as
    long as one of these names.  So a word costs as many rows as there are lengths of names that begin with it."""
    starts = facts.select("gen_id", "fact_id", T.words(F.col("fact")).alias("w")).select(
        "gen_id", "fact_id", "w", F.posexplode("w").alias("i", "word")).where(T.starts_upper(F.col("word"))).select(
        "gen_id", "fact_id", "i", F.lower(F.col("word")).alias("first"), "w")
    lengths = names.groupBy("first").agg(F.collect_set("n").alias("ns"))
    if (firsts := few(lengths, FIRST_WORDS)) is not lengths:  # a fact's words stay where they are
        met = starts.join(firsts, "first")
    else:
        counts = starts.groupBy("first").agg(F.count(F.lit(1)).alias("rows"))
        met = salted_join(starts, lengths, ["first"], counts, "rows", ["gen_id", "fact_id", "i"])
    runs = met.withColumn("n", F.explode(F.filter("ns", lambda n: n <= F.size("w") - F.col("i"))))
    return runs.select("gen_id", "fact_id", F.lower(F.array_join(F.slice("w", F.col("i") + 1, F.col("n")), " ")).alias("gram")).distinct()


def gazetteer_entities(facts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """M5: the known names that a fact contains -> (gen_id, fact_id, entity), one row per distinct pair.

    A name of any number of words is found where a run of the fact's words
    equals it, apart from case and the punctuation around words, and begins
    with a capital.  The entity keeps the gazetteer's spelling.  The gazetteer grows with the
    knowledge source, so it isn't forced to broadcast.
    """
    names = name_index(gazetteer)
    return fact_runs(facts, names).join(names.select("gram", "entity"), "gram").select("gen_id", "fact_id", "entity").distinct()


def person_tags(tags: DataFrame, label_col: str = "label") -> DataFrame:
    """Keep only person spans from a tagger's output."""
    return tags.where(F.col(label_col) == PERSON)


def fact_entities(facts: DataFrame, tagged: DataFrame) -> DataFrame:
    """Every fact with each of its entities; a fact with none keeps a NULL entity."""
    return facts.select("gen_id", "fact_id").join(tagged.select("gen_id", "fact_id", "entity"),
                                                  ["gen_id", "fact_id"], "left")


def entities_map(facts: DataFrame, tagged: DataFrame) -> DataFrame:
    """The ``{fact: [entities]}`` shape, one map per generation."""
    fe = fact_entities(facts, tagged).join(facts, ["gen_id", "fact_id"])
    per_fact = fe.groupBy("gen_id", "fact_id", "fact").agg(
        F.array_sort(F.collect_list("entity")).alias("entities"))
    return per_fact.groupBy("gen_id").agg(
        F.map_from_entries(F.collect_list(F.struct("fact", "entities"))).alias("fact_entities"))


def distinct_entities(tagged: DataFrame) -> DataFrame:
    """A1 + U2: distinct entities of each generation -> (gen_id, entity)."""
    return tagged.where(F.col("entity").isNotNull()).select("gen_id", "entity").distinct()
