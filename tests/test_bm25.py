"""BM25 top passages against a plain-Python formula (brute force)."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st

from veracity.operators import bm25
from veracity.session import Store


def python_bm25(corpus, query, k1=1.5, b=0.75, eps=0.25):
    docs = [p.split(" ") for p in corpus]
    n = len(docs)
    avgdl = sum(len(d) for d in docs) / n
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: (eps * mean if v < 0 else v) for t, v in raw.items()}
    scores = []
    for d in docs:
        s = 0.0
        for q in query.split(" "):
            tf = d.count(q)
            s += idf.get(q, 0.0) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / avgdl))
        scores.append(s)
    return scores


def expected_top(corpus, query, n=5):
    scores = [round(x, 9) for x in python_bm25(corpus, query)]
    order = sorted(range(len(corpus)), key=lambda i: (-scores[i], -i))[:n]
    return [(i, scores[i]) for i in order]


def run_top(spark, corpora, facts):
    p = spark.createDataFrame([(g, i, t) for g, c in corpora.items() for i, t in enumerate(c)],
                              "gen_id bigint, pos bigint, text string")
    f = spark.createDataFrame([(g, i, t) for g, fs in facts.items() for i, t in enumerate(fs)],
                              "gen_id bigint, fact_id int, fact string")
    rows = bm25.bm25_topk(f, p).collect()
    out = {}
    for r in rows:
        out.setdefault((r.gen_id, r.fact_id), []).append((r.rk, r.pos, r.score))
    return {k: [(pos, sc) for _, pos, sc in sorted(v)] for k, v in out.items()}


def check(spark, corpora, facts):
    got = run_top(spark, corpora, facts)
    for g, fs in facts.items():
        for i, q in enumerate(fs):
            exp = expected_top(corpora[g], q)
            res = got[(g, i)]
            assert [p for p, _ in res] == [p for p, _ in exp], (g, q)
            for (_, a), (_, e) in zip(res, exp):
                assert abs(a - e) < 1e-7


def test_hand_cases(spark):
    corpora = {
        1: ["only one passage here"],                        # negative idf everywhere
        2: ["a b c", "d e f ", "a a g", "x y", "z", "b c d", "q"],   # trailing blank in a passage
        3: ["the cat sat", "the dog", "the cat ran", "a bird", "the end", "cat cat cat"],
    }
    facts = {
        1: ["one passage", "nothing shared"],
        2: ["a a b", "w", "c d e f"],                        # repeated token, no shared token
        3: ["the cat", "the", "bird song"],
    }
    check(spark, corpora, facts)


def test_negative_scores_rank_below_zero(spark):
    # every token in every passage: idf < 0 for shared words, so matches score below 0
    corpora = {7: ["x y", "x y", "x y", "x", "y", "z w"]}
    facts = {7: ["x y", "z"]}
    check(spark, corpora, facts)


words = st.sampled_from(["a", "b", "c", "d", "e", "f", "", "The", "the"])
passage = st.lists(words, min_size=1, max_size=6).map(" ".join)


@settings(max_examples=5, deadline=None)
@given(st.lists(passage, min_size=1, max_size=9), st.lists(passage, min_size=1, max_size=4))
def test_property_against_formula(spark, corpus, queries):
    check(spark, {5: corpus}, {5: queries})


def test_hot_generation_with_skew_join_split(spark):
    """One generation holds most passages and facts; AQE is made to split the
    skewed (gen_id, token) partitions, and results still equal brute force."""
    import random
    rnd = random.Random(11)
    vocab = ["the", "a", "cat", "dog", "ran", "sat", "Bob", "Alice", "tea", "x", "y", "z"]
    corpora = {1: [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 8))) for _ in range(300)]}
    facts = {1: [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 6))) for _ in range(25)]}
    for g in range(2, 6):
        corpora[g] = ["the cat", "a dog ran"]
        facts[g] = ["the dog"]
    confs = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB"}
    before = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        check(spark, corpora, facts)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_hot_token_is_dealt_over_salts(spark):
    """A token of every passage of one large generation: its rows go to many keys, evenly, and no score changes."""
    import random
    from pyspark.sql import functions as F
    rnd = random.Random(5)
    corpus = ["the " + " ".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    p = spark.createDataFrame([(1, i, t) for i, t in enumerate(corpus)], "gen_id bigint, pos bigint, text string")
    f = spark.createDataFrame([(1, 0, "the a"), (1, 1, "the")], "gen_id bigint, fact_id int, fact string")
    ptoks = bm25.passage_tokens(p)
    stats = bm25.corpus_stats(ptoks)
    whole = {(r.fact_id, r.pos): r.score for r in bm25.bm25_scores(f, ptoks, stats, Store(spark)).collect()}
    split = {(r.fact_id, r.pos): r.score for r in bm25.bm25_scores(f, ptoks, stats, Store(spark), salt_rows=20).collect()}
    assert whole.keys() == split.keys() and all(abs(whole[k] - split[k]) < 1e-9 for k in whole)
    q = bm25.fact_tokens(f).join(bm25.idf_table(ptoks, stats), ["gen_id", "token"])
    hot = bm25.hot_tokens(q, 20)
    assert {r.token: r.salts for r in hot.collect()}["the"] == 20
    dealt = ptoks.where("token = 'the'").select(F.pmod(F.xxhash64("pos"), F.lit(20)).alias("s")).groupBy("s").count().collect()
    assert len(dealt) == 20 and max(r["count"] for r in dealt) < 50
    matched = bm25.salted_match(q, ptoks, hot).where("token = 'the'")
    assert matched.count() == 800  # each passage once for each of the two facts


def _corpus(spark, texts, hits):
    """(sentences, placed hits, passages) of texts {id: sentences} and hits {gen: text ids in order}."""
    from veracity.operators import retrieval
    know = spark.createDataFrame([(t, f"T{t}", "".join(s)) for t, s in texts.items()], "title_id bigint, title string, text string")
    ents = spark.createDataFrame([(g, f"{g}:{i:03d}") for g, ts in hits.items() for i in range(len(ts))], "gen_id bigint, entity string")
    near = spark.createDataFrame([(f"{g}:{i:03d}", t, 1) for g, ts in hits.items() for i, t in enumerate(ts)], "entity string, title_id bigint, rk int")
    found = retrieval.title_hits(ents, near, know)
    sents = retrieval.title_sentences(know, found.select("text_id"))
    placed = retrieval.placed_hits(found, sents)
    return sents, placed, retrieval.passages(ents, near, know)


def _texts(rnd, n):
    words = ["the", "a", "cat", "dog", "Bob", "tea", "x", "y", "z", "rain"]
    return {t: [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 6))).capitalize() + ". " for _ in range(rnd.randint(1, 6))] for t in range(n)}


def test_shared_postings_equal_the_passages_own_counts(spark, monkeypatch):
    """Scores and weights from hits and postings are those from every generation's own passages, hot texts and repeated hits included."""
    import random
    from veracity.operators import skew
    rnd = random.Random(3)
    texts = _texts(rnd, 12)
    hits = {g: [0] + [rnd.randrange(12) for _ in range(rnd.randint(0, 7))] for g in range(1, 13)}
    sents, placed, passages = _corpus(spark, texts, hits)
    facts = spark.createDataFrame([(g, i, " ".join(rnd.choice(["The", "cat.", "dog", "the", "tea", "unknown", "z."]) for _ in range(rnd.randint(1, 5))))
                                   for g in [*hits, 99] for i in range(3)], "gen_id bigint, fact_id int, fact string")
    own = bm25.bm25_idf(passages)
    for rows in (skew.HOT_ROWS, 4):
        monkeypatch.setattr(skew.salted_join, "__defaults__", (rows,))
        postings = bm25.text_postings(sents)
        shared = bm25.hit_idf(placed, postings, bm25.hit_stats(placed))
        a, b = ({(r.gen_id, r.token): round(r.idf, 9) for r in df.collect()} for df in (own, shared))
        assert a == b
        key = lambda r: (r.gen_id, r.fact_id, r.rk, r.pos, round(r.score, 9))
        want, got = (sorted(map(key, df.collect())) for df in (bm25.bm25_topk(facts, passages), bm25.hits_topk(facts, placed, postings)))
        assert got == want and {g for g, *_ in got} == set(hits)


def test_postings_grow_with_distinct_sentences(spark):
    """However many generations hit the same texts, there is one set of postings."""
    import random
    texts = _texts(random.Random(4), 5)
    sizes = set()
    for n in (2, 40):
        sents, placed, passages = _corpus(spark, texts, {g: [0, 1, 2, 3, 4] for g in range(n)})
        assert passages.count() == n * sents.count()
        sizes.add(bm25.text_postings(sents).count())
    assert len(sizes) == 1


def test_passage_texts_by_position(spark):
    """Positions on both sides of block borders lead to their text; those beyond the corpus to none."""
    import random
    from veracity.operators import retrieval
    rnd = random.Random(6)
    texts = {0: ["Aa. "] * 150, **{t: [f"S{t} no{i}. " for i in range(rnd.randint(1, 5))] for t in range(1, 60)}}
    sents, placed, passages = _corpus(spark, texts, {1: [*range(1, 60), 0, 3], 2: [0]})
    every = passages.select("gen_id", "pos")
    got = retrieval.passage_texts(every.unionByName(every).unionByName(spark.createDataFrame([(1, 10**6), (3, 0)], "gen_id bigint, pos bigint")), placed, sents)
    want = sorted((r.gen_id, r.pos, r.text) for r in passages.collect())
    assert sorted((r.gen_id, r.pos, r.text) for r in got.collect()) == want


def test_hot_keys_are_dealt(spark):
    from pyspark.sql import functions as F
    from veracity.operators import skew
    many = spark.createDataFrame([(i, 1 if i < 600 else i) for i in range(900)], "id long, k long")
    other = spark.createDataFrame([(k, v) for k in [*range(600, 900), 1] for v in range(2)], "k long, v long")
    counts = many.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert skew.hot_limit(counts, "n", 50) == (50, True) and skew.hot_limit(counts, "n") == (skew.HOT_ROWS, False)
    assert [tuple(r) for r in skew.hot_keys(counts, "n", 50).collect()] == [(1, 12)]
    got = skew.salted_join(many, other, ["k"], counts, "n", ["id"], hot_rows=50)
    assert sorted((r.id, r.k, r.v) for r in got.collect()) == sorted((r.id, r.k, v) for r in many.collect() for v in range(2))
    # a key is hot only if it has more than its part of all rows: the list stays short whatever the threshold
    even = spark.range(20_000).select(F.col("id").alias("k"), F.when(F.col("id") < 5000, 20).otherwise(1).alias("n"))
    limit, _ = skew.hot_limit(even, "n", 1)
    assert limit == (5000 * 20 + 15_000) // skew.HOT_KEYS and skew.hot_keys(even, "n", limit).count() <= skew.HOT_KEYS


def test_bounded_top_is_equal_and_scores_fewer_pairs(spark):
    """Facts of one rare and several common words: passages that only the common ones lead to are left out, and nothing changes."""
    import random
    rnd = random.Random(12)
    common = ["the", "of", "and", "in"]
    texts = {t: [" ".join([rnd.choice(common) for _ in range(3)] + [f"r{rnd.randrange(25)}"] * rnd.randint(1, 2) + [f"u{rnd.randrange(500)}"]) + ". "
                 for _ in range(12)] for t in range(30)}
    texts = {t: [s.capitalize() for s in v] for t, v in texts.items()}
    hits = {g: [rnd.randrange(30) for _ in range(12)] for g in range(6)}
    sents, placed, passages = _corpus(spark, texts, hits)
    facts = spark.createDataFrame([(g, i, f"the of r{rnd.randrange(25)} in and and" + (" nothing" if i % 3 else "")) for g in hits for i in range(8)]
                                  + [(g, 90, "the of") for g in hits] + [(g, 91, "u1. xx") for g in hits] + [(g, 92, "qq") for g in hits],
                                  "gen_id bigint, fact_id int, fact string")
    postings, store = bm25.text_postings(sents), Store(spark)
    key = lambda r: (r.gen_id, r.fact_id, r.rk, r.pos, round(r.score, 9))
    want = sorted(map(key, bm25.hits_topk(facts, placed, postings, store=store).collect()))
    all_pairs = store.read("bm25_nonzero").count()
    got = sorted(map(key, bm25.hits_topk(facts, placed, postings, store=store, bounded=True).collect()))
    assert got == want == sorted(map(key, bm25.bm25_topk(facts, passages).collect()))
    assert store.read("bm25_nonzero").count() < all_pairs / 2


@settings(max_examples=2, deadline=None)
@given(st.lists(passage, min_size=1, max_size=14), st.lists(passage, min_size=1, max_size=5))
def test_property_of_bounded_top(spark, corpus, queries):
    texts = {0: [p + ". " for p in corpus]}
    sents, placed, passages = _corpus(spark, texts, {1: [0, 0], 2: [0]})
    facts = spark.createDataFrame([(g, i, q) for g in (1, 2) for i, q in enumerate(queries)], "gen_id bigint, fact_id int, fact string")
    key = lambda r: (r.gen_id, r.fact_id, r.rk, r.pos, round(r.score, 8))
    got = sorted(map(key, bm25.hits_topk(facts, placed, bm25.text_postings(sents), bounded=True).collect()))
    assert got == sorted(map(key, bm25.bm25_topk(facts, passages).collect()))


def test_best_of_parts_equal_the_whole_and_few_pairs_leave_the_tasks(spark, monkeypatch):
    """Parts of any size, facts given twice, texts without a fact's token and negative weights: the same best passages,
    and what is written for them grows with facts and parts, not with the pairs of facts and passages."""
    import random
    rnd = random.Random(21)
    texts = _texts(rnd, 14) | {50: ["Rare words. "] * 7}
    hits = {g: [rnd.randrange(14) for _ in range(rnd.randint(1, 25))] + [50] * (g % 3) for g in range(1, 10)}
    sents, placed, passages = _corpus(spark, texts, hits)
    facts = spark.createDataFrame([(g, i, " ".join(rnd.choice(["The", "cat.", "dog", "the", "tea", "unknown", "z."]) for _ in range(rnd.randint(1, 5))))
                                   for g in [*hits, 99] for i in range(4)] + [(g, 7, "qq the") for g in (1, 1, 2)] + [(None, 0, "the")],
                                  "gen_id bigint, fact_id int, fact string")
    postings, store = bm25.text_postings(sents), Store(spark)
    key = lambda r: (r.gen_id, r.fact_id, r.rk, r.pos, round(r.score, 9))
    want = sorted(map(key, bm25.bm25_topk(facts, passages).collect()))
    for rows, tokens, cells in ((bm25.SALT_ROWS, bm25.PART_TOKENS, bm25._CELLS), (9, 20, 50), (1, 1, 1)):
        monkeypatch.setattr(bm25, "PART_TOKENS", tokens)
        monkeypatch.setattr(bm25, "_CELLS", cells)
        assert sorted(map(key, bm25.hits_topk(facts, placed, postings, store=store, salt_rows=rows, in_parts=True).collect())) == want
    bm25.hits_topk(facts, placed, postings, store=store, in_parts=True)
    assert store.read("bm25_nonzero").count() <= 5 * facts.count() < placed.join(facts, "gen_id").selectExpr("sum(n_sents)").first()[0]
    ours = {(r.gen_id, r.token): (r.df, round(r.idf, 9)) for r in bm25.hit_idf(placed, postings, bm25.hit_stats(placed)).collect()}
    assert {k: i for k, (_, i) in ours.items()} == {(r.gen_id, r.token): round(r.idf, 9) for r in bm25.bm25_idf(passages).collect()}


def test_texts_go_once_to_a_block_of_generations(spark, monkeypatch):
    """However many generations of a block hit a text, its row is there once; cells of any size give the same weights and best passages."""
    import random
    rnd = random.Random(31)
    sents, placed, passages = _corpus(spark, _texts(rnd, 6), {g: [rnd.randrange(6) for _ in range(4)] + [0] for g in range(60)})
    packed = sents.select("text_id").distinct()
    assert placed.count() == 300 and bm25.block_texts(packed, placed, 3).count() <= 6 * 3
    assert bm25.block_texts(packed, placed, 1).count() == placed.select("text_id").distinct().count()
    monkeypatch.setattr(bm25, "LEAST_CELLS", 6)
    monkeypatch.setattr(bm25, "PART_ENTRIES", 40)
    facts = spark.createDataFrame([(g, i, f"The {w}") for g in range(60) for i, w in enumerate(["cat.", "tea"])], "gen_id bigint, fact_id int, fact string")
    blocks, parts = bm25.cells_of(placed, 100, 40)
    assert (blocks, parts) == (2, 3)
    key = lambda r: (r.gen_id, r.fact_id, r.rk, r.pos, round(r.score, 9))
    got = bm25.hits_topk(facts, placed, bm25.text_postings(sents), in_parts=True)
    assert sorted(map(key, got.collect())) == sorted(map(key, bm25.bm25_topk(facts, passages).collect()))


def test_rows_are_dealt_once_and_best_passages_know_their_sentence(spark):
    """Postings are counted after one exchange; texts that weren't hit aren't moved; weights are kept by generation; a best passage names the sentence it is."""
    import random
    from veracity.operators import retrieval
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    rnd = random.Random(41)
    texts = _texts(rnd, 9)
    sents, placed, passages = _corpus(spark, texts, {g: [rnd.randrange(9) for _ in range(5)] for g in range(8)})
    rows = spark.createDataFrame(sents.collect(), sents.schema)
    assert exchanges(bm25.text_postings(rows)) == 1
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        know = spark.createDataFrame([(t, "".join(s)) for t, s in texts.items()], "title_id bigint, text string")
        plan = retrieval.title_sentences(know, spark.createDataFrame([(1,), (1,), (4,)], "text_id bigint"))._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    facts = spark.createDataFrame([(g, i, f"The {w} {w}") for g in range(8) for i, w in enumerate(["cat.", "tea", "unheard"])], "gen_id bigint, fact_id int, fact string")
    store = Store(spark)
    top = bm25.hits_topk(facts, placed, bm25.text_postings(sents), store=store, in_parts=True)
    assert store.read("bm25_query").count() == 8
    got = retrieval.texts_at(top, sents, ["gen_id", "fact_id", "rk"]).select("gen_id", "fact_id", "pos", "rk", "text").collect()
    want = bm25.bm25_topk(facts, passages).join(passages, ["gen_id", "pos"]).select("gen_id", "fact_id", "pos", "rk", "text").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 60


def test_a_block_passes_its_texts_in_bounded_parts(spark, monkeypatch):
    """Facts and hits move once and texts once to a block of generations, whatever the number of parts; generations without hits between
    the others, facts without words and small parts change no best passage, and each fact's best are one row."""
    import random
    from pyspark.sql import functions as F
    rnd = random.Random(51)
    sents, placed, passages = _corpus(spark, _texts(rnd, 12), {g: [rnd.randrange(12) for _ in range(9)] for g in range(0, 30, 3)})
    facts = spark.createDataFrame([(g, i, w) for g in range(30) for i, w in enumerate(["The cat.", "tea x", "unheard", None, "rain rain the"])],
                                  "gen_id bigint, fact_id int, fact string")
    packed = bm25.packed_postings(bm25.text_postings(sents))
    assert packed.count() == 12 and bm25.unpacked_postings(packed).count() == bm25.text_postings(sents).count()
    for name, most in (("LEAST_BLOCKS", 2), ("PART_TOKENS", 7), ("PART_ENTRIES", 5)):
        monkeypatch.setattr(bm25, name, most)
    key = lambda r: (r.gen_id, r.fact_id, r.rk, r.pos, round(r.score, 9))
    store = Store(spark)
    got = sorted(map(key, bm25.hits_topk(facts, placed, packed, store=store, in_parts=True).collect()))
    assert got == sorted(map(key, bm25.bm25_topk(facts, passages).collect()))
    assert store.read("bm25_nonzero").count() == 50
    query = store.read("bm25_query")
    plan = bm25.block_scores(facts, query, packed, 5, 100)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(block" not in plan
    whole = {(r.gen_id, r.token): (r.df, round(r.mean_idf, 9)) for r in query.select("gen_id", "mean_idf", F.inline(F.arrays_zip(F.col("tokens").alias("token"), F.col("dfs").alias("df")))).collect()}
    every = {(r.gen_id, r.token): r.df for r in bm25.hit_idf(placed, packed, bm25.hit_stats(placed)).collect()}
    assert whole and all(every[k] == df for k, (df, _) in whole.items())


def test_rows_of_a_block_reach_python_without_null_lists(spark):
    """A list column that only one kind of rows has: on the way to Python each row after a null list would go through all nulls before it."""
    import pyarrow as pa
    from pyspark.sql import functions as F
    own = spark.range(40).select((F.col("id") % 3).cast("int").alias("block"), F.lit(0).alias("kind"), F.lit(0).alias("part"), F.array("id").alias("ids"))
    rest = spark.range(50).select((F.col("id") % 3).cast("int").alias("block"), F.lit(1).alias("kind"), F.lit(0).alias("part"), F.col("id").cast("string").alias("word"))

    def one(rows):
        for kind, _, t in rows:
            yield pa.table({"kind": [kind], "n": [t.num_rows], "nulls": [t["ids"].null_count], "words": [t.num_rows - t["word"].null_count]})

    got = bm25._in_blocks([own, rest], 3, one, "kind long, n long, nulls long, words long").groupBy("kind").agg(F.sum("n"), F.sum("nulls"), F.sum("words")).collect()
    assert sorted(map(tuple, got)) == [(0, 40, 0, 0), (1, 50, 0, 50)]


def test_hits_go_once_to_a_block_for_all_tokens_weights(spark, monkeypatch):
    """However many parts the tokens are in, a generation's hits are one row; small parts, places and files give the same weights, whole or of some tokens."""
    import random
    rnd = random.Random(61)
    sents, placed, passages = _corpus(spark, _texts(rnd, 9), {g: [rnd.randrange(9) for _ in range(rnd.randint(1, 6))] for g in range(14)})
    postings, stats = bm25.packed_postings(bm25.text_postings(sents)), bm25.hit_stats(placed)
    for name, most in (("LEAST_BLOCKS", 2), ("PART_TOKENS", 7)):
        monkeypatch.setattr(bm25, name, most)
    sent, in_blocks = [], bm25._in_blocks
    monkeypatch.setattr(bm25, "_in_blocks", lambda rows, *a: sent.append(rows[0].count()) or in_blocks(rows, *a))
    want = {(r.gen_id, r.token): round(r.idf, 9) for r in bm25.bm25_idf(passages).collect()}
    assert {(r.gen_id, r.token): round(r.idf, 9) for r in bm25.hit_idf(placed, postings, stats).collect()} == want
    assert sent == [14]
    some = spark.createDataFrame([(g, t) for g in (1, 2, 13, 99) for t in ("the", "tea", "Bob.", "unheard", "x")] + [(None, "the"), (1, None)], "gen_id bigint, token string")
    asked = {(r.gen_id, r.token) for r in some.collect()}
    assert {(r.gen_id, r.token): round(r.idf, 9) for r in bm25.hit_idf(placed, postings, stats, some).collect()} == {k: v for k, v in want.items() if k in asked}


def test_weights_of_a_block_in_parts_of_any_size(monkeypatch):
    """Few places for counts, few entries at a time and parts kept in a file: the same weights, by the formula."""
    import random
    import pyarrow as pa
    rnd = random.Random(71)
    texts = {t: {w: rnd.randint(1, 3) for w in rnd.sample("abcdefghij", rnd.randint(1, 6))} for t in range(8)}  # df of each token
    hits = {g: [rnd.randrange(9) for _ in range(rnd.randint(1, 5))] for g in (3, 4, 9, 20)}  # text 8 has no tokens
    held = pa.table({"gen_id": list(hits), "n_docs": [20] * len(hits), "ids": list(hits.values())})
    parts = [[{"text_ids": [t], "tokens": " ".join(own), "dfs": [ws[w] for w in own]} for t, ws in texts.items() if (own := [w for w in ws if w in part])]
             for part in ("abc", "defg", "hij")]
    asks = pa.table({"gen_id": [3, 4, 77], "tokens": ["a h zz", "b", "a"]})
    want = {}
    for g, ids in hits.items():
        df = {}
        for t in ids:
            for w, n in texts.get(t, {}).items():
                df[w] = df.get(w, 0) + n
        raw = {w: math.log(20 - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
        mean = sum(raw.values()) / max(1, len(raw))
        want |= {(g, w): (df[w], round(bm25.EPSILON * mean if x < 0 else x, 9)) for w, x in raw.items()}
    for sizes in ({}, {"_PLACES": 5, "_CELLS": 3, "_HELD": 1}):
        for name, most in sizes.items():
            monkeypatch.setattr(bm25, name, most)
        for whole in (True, False):
            rows = [(0, 0, held), *([] if whole else [(1, 0, asks)]), *((2, n, pa.Table.from_pylist(part)) for n, part in enumerate(parts))]
            found = [r for t in bm25._idf_of_block(whole)(iter(rows)) for r in t.to_pylist()]
            got = {(r["gen_id"], r["token"]): (r["df"], round(r["idf"], 9)) for r in found}
            assert len(got) == len(found) and got == {k: v for k, v in want.items() if whole or k in {(3, "a"), (3, "h"), (4, "b")}}
    assert list(bm25._idf_of_block(True)(iter([(0, 0, held)]))) == []
