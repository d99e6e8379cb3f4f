"""Names in facts by the index of their first words, against a plain search."""

import random

from veracity.operators import entities as EN


def plain(facts, names):
    """{(gen, fact, entity)}: every run of words, compared with every name."""
    strip = lambda w: w.strip(".,;:!?\"'()[]")
    out = set()
    for g, i, fact in facts:
        w = [x for x in map(strip, fact.split(" ")) if x]
        for name in names:
            n = [x for x in map(strip, name.split(" ")) if x]
            for at in range(len(w) - len(n) + 1):
                if n and w[at][0] != w[at][0].lower() and [x.lower() for x in w[at:at + len(n)]] == [x.lower() for x in n]:
                    out.add((g, i, name))
    return out


def frames(spark, facts, names):
    return (spark.createDataFrame(facts, "gen_id bigint, fact_id int, fact string"),
            spark.createDataFrame([(n, i) for i, n in enumerate(names)], "entity string, title_id bigint"))


def test_against_plain_search(spark):
    rnd = random.Random(2)
    words = ["The", "the", "Old", "old", "Man", "Sea", "Ann", "ann", "Bob.", "(Tea", "of"]
    names = sorted({" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4))) for _ in range(25)})
    facts = [(g, i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 9)))) for g in range(6) for i in range(6)]
    got = EN.gazetteer_entities(*frames(spark, facts, names))
    assert sorted(map(tuple, got.collect())) == sorted(plain(facts, names))


def test_a_long_name_costs_only_its_own_first_word(spark):
    """One title of 40 words: words that no such name begins with get no runs of its length."""
    long = "Zeta " + " ".join(f"w{i}" for i in range(39))
    facts = [(1, 0, " ".join(["Ann"] * 60)), (1, 1, "Bob met Ann"), (1, 2, long)]
    f, g = frames(spark, facts, ["Ann", "Bob", long])
    runs = EN.fact_runs(f, EN.name_index(g)).collect()
    assert sorted((r.fact_id, r.gram) for r in runs) == [(0, "ann"), (1, "ann"), (1, "bob"), (2, long.lower())]
    assert sorted(map(tuple, EN.gazetteer_entities(f, g).collect())) == sorted(plain(facts, ["Ann", "Bob", long]))


def test_no_names_and_hot_words(spark, monkeypatch):
    from veracity.operators import skew
    f, g = frames(spark, [(1, i, "The cat") for i in range(200)] + [(2, 0, "")], ["The Cat", "The"])
    assert EN.gazetteer_entities(f, g.limit(0)).count() == 0
    monkeypatch.setattr(skew.salted_join, "__defaults__", (20,))
    assert EN.gazetteer_entities(f, g).count() == 400


def test_facts_and_places_stay_where_they_are_for_few_names_and_sentences(spark, monkeypatch):
    """First words of names and sentences of best passages go to the rows, not the rows to them; without that the rows are the same."""
    from veracity.operators import retrieval
    facts = spark.createDataFrame([(1, i, f"Ann Lee met Bob {i}.") for i in range(6)], "gen_id bigint, fact_id int, fact string")
    names = EN.name_index(spark.createDataFrame([("Ann Lee",), ("Bob",)], "entity string"))
    rows = spark.createDataFrame([(1, i, 1, 0) for i in range(6)], "gen_id bigint, fact_id int, text_id bigint, idx int")
    sents = spark.createDataFrame([(1, 0, "One."), (1, 1, "Two.")], "text_id bigint, idx int, sentence string")
    found = lambda: (EN.fact_runs(facts, names), retrieval.texts_at(rows, sents, ["gen_id"], ["gen_id", "fact_id"]))
    monkeypatch.setattr(EN, "salted_join", None)
    monkeypatch.setattr(retrieval, "salted_join", None)
    few = [sorted(map(tuple, df.collect())) for df in found()]
    monkeypatch.undo()
    monkeypatch.setattr(EN, "FIRST_WORDS", 0)
    monkeypatch.setattr(retrieval, "CHARACTERS", 0)
    assert few == [sorted(map(tuple, df.collect())) for df in found()] and len(few[0]) == 12 and len(few[1]) == 6
