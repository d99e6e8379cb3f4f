"""BM25 top passages per fact, as a sparse join.

Scoring follows BM25 Okapi with k1 = 1.5, b = 0.75, epsilon = 0.25:

* idf(t) = ln(N - df + 0.5) - ln(df + 0.5); a negative idf is replaced by
  epsilon * (mean idf over all distinct tokens of the corpus, before replacement)
* score(q, p) = sum over the tokens of q, repeats included, of
  idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * |p| / avgdl)); unknown tokens add 0

Each generation's passages form one corpus.  Only (fact, passage) pairs that
share a token are ever built: fact tokens and passage tokens meet in an
equi-join on (gen_id, token), contributions are summed per (gen_id, fact_id,
pos), and a ``row_number() <= n`` window keeps the top n.  Passages that share
no token score exactly 0; a fact with fewer than n positive scores is filled
with its generation's zero-score passages of highest ``pos`` - drawn from a
candidate range whose length is bounded by n plus the fact's own matches, so
the fill never enumerates all pairs either.

Ties: score rounded to 9 places descending, then ``pos`` descending.

Generations retrieve the same texts, so sentences are cut into tokens once per
text, not per generation: ``text_postings`` has a row for each (text_id, token) with
the sentences it stands in.  A generation's corpus is its title hits; document
frequencies, lengths and the passages that a fact's tokens stand in all follow from hits
joined to postings, and passage texts take no part.  A text that very many generations hit is dealt over salts.

A (gen_id, token) that occurs in more than ``SALT_ROWS`` passages (a common word
of a large corpus) is split: its passage rows are dealt over as many salts as that
takes, and its fact rows are repeated for each.

A generation's facts share a token with nearly all of its passages, so these pairs are many
times the input.  ``hits_topk(in_parts=True)``, which scoring runs use, adds them up within tasks, and
only the best leave them.  Generations are dealt over blocks; facts and hits go to their block once and a text's postings
once to each block of generations that hit it, as one packed row, and not to every hit.  A block's task goes through the texts in bounded
parts: what is shuffled grows with facts, hits, and texts times blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, pairwise
from tempfile import SpooledTemporaryFile
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from veracity.functions import text as T
from veracity.operators.retrieval import text_counts
from veracity.operators.skew import few, salted_join
from veracity.session import Store

# ---- fixed values: BM25 Okapi defaults
K1 = 1.5
B = 0.75
EPSILON = 0.25
TOP_N = 5
# ---- end of fixed values
SALT_ROWS = 10_000
TIE = 1e-7  # scores nearer than this may be ranked as equal
PART_TOKENS = 1 << 20  # postings in a part, when a generation's distinct tokens are counted
PART_ENTRIES = 4 << 20  # places of tokens in a part, when passages are scored
LEAST_CELLS = 48  # blocks of generations times parts of texts, for the tasks of a cluster
LEAST_BLOCKS = 12  # blocks of generations that go through all parts, for the tasks of a cluster
BLOCK_HITS = 1 << 20  # hits of a block of generations
BLOCK_FACTS = 1 << 19  # facts of a block of generations
REACHED = 1 << 19  # (text, block) pairs that go to all postings
CELL_TOKENS = 1 << 28  # tokens that a cell's generations meet in their hits
_CELLS = 4 << 20  # scores, or shares of them, held at once in a task
_HELD = 64 << 20  # bytes of texts that a task holds in memory to go through them again
_PLACES = 1 << 20  # counts of tokens held at once in a task, or those of one generation


def passage_tokens(passages: DataFrame) -> DataFrame:
    """(gen_id, pos, token, tf, dl): term frequencies and passage length.

    Passages are dealt by (gen_id, pos) as text, once; that keeps a passage's
    tokens together, so they are counted where they are cut.
    """
    toks = passages.repartition("gen_id", "pos").select("gen_id", "pos", T.tokens(F.col("text")).alias("toks"))
    return (toks.select("gen_id", "pos", F.size("toks").alias("dl"), F.explode("toks").alias("token"))
            .groupBy("gen_id", "pos", "token").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl")))


def corpus_stats(ptoks: DataFrame) -> DataFrame:
    """Per generation: N passages and average length -> (gen_id, n_docs, avgdl)."""
    return (ptoks.groupBy("gen_id", "pos").agg(F.max("dl").alias("dl"))
            .groupBy("gen_id").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl")))


def idf_table(ptoks: DataFrame, stats: DataFrame) -> DataFrame:
    """A3: (gen_id, token, df, idf) with the epsilon floor applied; the mean idf
    is over every distinct token of a generation's corpus."""
    return idf_of(ptoks.groupBy("gen_id", "token").agg(F.count(F.lit(1)).alias("df")), stats)


def idf_of(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(gen_id, token, df, idf) from document frequencies (gen_id, token, df)."""
    raw = df.join(stats.select("gen_id", "n_docs"), "gen_id").select(
        "gen_id", "token", "df",
        (F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw_idf"))
    mean_idf = raw.groupBy("gen_id").agg(F.avg("raw_idf").alias("mean_idf"))
    return raw.join(mean_idf, "gen_id").select(
        "gen_id", "token", "df",
        F.when(F.col("raw_idf") < 0, F.lit(EPSILON) * F.col("mean_idf")).otherwise(F.col("raw_idf")).alias("idf"))


def bm25_idf(passages: DataFrame) -> DataFrame:
    """A3 from passages -> (gen_id, token, idf)."""
    ptoks = passage_tokens(passages)
    return idf_table(ptoks, corpus_stats(ptoks)).select("gen_id", "token", "idf")


def text_postings(sentences: DataFrame) -> DataFrame:
    """(text_id, token, df, entries): the sentences of each text, from (text_id, idx, sentence, dl), that a token
    stands in, as (idx, tf, dl).  A text's sentences bound the entries.  They are dealt by text once, and counted where they are cut."""
    toks = sentences.repartition("text_id").select("text_id", "idx", "dl", F.explode(T.tokens(F.col("sentence"))).alias("token"))
    counted = toks.groupBy("text_id", "idx", "token").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.max("dl").alias("dl"))
    return counted.groupBy("text_id", "token").agg(F.count(F.lit(1)).alias("df"), F.collect_list(F.struct("idx", "tf", "dl")).alias("entries"))


def packed_postings(postings: DataFrame) -> DataFrame:
    """Postings as a row for each text (text_id, tokens, dfs, idx, tf, dl): the tokens between blanks, in how many sentences each
    stands, and its entries one after another.  Postings that ``text_postings`` has just counted don't move for it."""
    if "tokens" in postings.columns:
        return postings
    held = postings.groupBy("text_id").agg(F.collect_list(F.struct("token", "entries")).alias("_t")).select(
        "text_id", F.array_join("_t.token", " ").alias("tokens"), F.transform("_t.entries", F.size).alias("dfs"), F.flatten("_t.entries").alias("_e"))
    return held.select("text_id", "tokens", "dfs", *[F.col("_e")[c].alias(c) for c in ("idx", "tf", "dl")])


def unpacked_postings(postings: DataFrame) -> DataFrame:
    """(text_id, token, df) from postings in either form."""
    if "tokens" not in postings.columns:
        return postings.select("text_id", "token", "df")
    pairs = F.arrays_zip(F.split("tokens", " ").alias("token"), F.col("dfs").alias("df"))
    return postings.select("text_id", F.inline(pairs)).select("text_id", "token", F.col("df").cast("long").alias("df"))


def hit_stats(placed: DataFrame) -> DataFrame:
    """A3: ``corpus_stats`` from a generation's hits (gen_id, n_sents, n_tokens)."""
    return placed.groupBy("gen_id").agg(F.sum("n_sents").alias("n_docs"), (F.sum("n_tokens") / F.sum("n_sents")).alias("avgdl"))


def cells_of(placed: DataFrame, rows: int, most: int) -> tuple[int, int]:
    """(blocks of generations, parts of the postings) for ``rows`` of postings, about ``most`` in a part: one small job."""
    hits, tokens = placed.agg(F.count(F.lit(1)), F.sum("n_tokens")).first()
    parts = max(1, -(-rows // most))
    return max(1, -(-LEAST_CELLS // parts), -(-hits // BLOCK_HITS), -(-int(tokens or 0) // (parts * CELL_TOKENS))), parts


def block_of(blocks: int):
    """The block of a generation."""
    return F.pmod(F.xxhash64(F.col("gen_id").cast("long")), F.lit(blocks)).cast("int").alias("block")


def block_texts(texts: DataFrame, placed: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``texts`` (text_id, ...) for each block of generations that hit the text, however many they are -> (block, text_id, ...)."""
    reached = few(placed.where("gen_id is not null").select("text_id", block_of(blocks)).distinct(), REACHED)
    return texts.join(reached, "text_id")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _runs(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Borders of runs of rows whose sizes add up to ``most`` at most, or of one row."""
    ends, out, at = np.cumsum(sizes), [], 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        out.append((at, end))
        at = end
    return out


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _hit_counts(texts: pa.Table, gens: np.ndarray, n_docs: np.ndarray, sizes: np.ndarray, wanted: np.ndarray, asks: tuple | None = None,
                mean_idf: np.ndarray | None = None) -> Iterator[pa.Table]:
    """The document frequencies of the texts' tokens for each generation; ``wanted`` are the ids of the texts that it hit, ``sizes`` of them.

    For each generation the sum and number of the raw weights, with the frequencies of the tokens that it asks for by
    ``asks`` (generations' numbers, tokens); or, with the means known, every token's weight, or that of the tokens asked for."""
    flat = lambda c: texts[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    tokens = pc.split_pattern(texts["tokens"].combine_chunks(), " ")
    coded = tokens.flatten().dictionary_encode()
    code, vocab = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    size, dfs, ids = _lengths(tokens), flat("dfs").astype(np.int64), flat("text_ids")
    first, by_id = np.cumsum(size) - size, np.argsort(ids, kind="stable")
    # which texts each generation hit, and how often
    at = np.minimum(np.searchsorted(ids[by_id], wanted), len(ids) - 1)
    known = ids[by_id][at] == wanted
    gen = np.repeat(np.arange(len(gens)), sizes)[known]
    pair, times = np.unique(gen * len(ids) + by_id[at[known]], return_counts=True)
    gen, text = pair // len(ids), pair % len(ids)
    border = np.searchsorted(gen, np.arange(len(gens) + 1))
    entries = np.concatenate([[0], np.cumsum(size[text])])
    asked = np.empty(0, np.int64)
    if asks is not None:
        own, words = asks
        word = pc.fill_null(pc.index_in(words, value_set=vocab), -1).to_numpy(zero_copy_only=False)
        asked = np.unique((own * len(vocab) + word)[(own >= 0) & (word >= 0)])
    among = lambda lo, hi: asked[slice(*np.searchsorted(asked, [lo * len(vocab), hi * len(vocab)]))] - lo * len(vocab)
    # counts of a few generations' tokens at a time, each in its own place, which needs no sorting
    most = max(1, _PLACES // max(1, len(vocab)))
    count, last, flag = (np.zeros(most * len(vocab), k) for k in (np.int64, np.int64, bool))
    for lo, hi in ((a, min(a + most, hi)) for lo, hi in _runs(np.diff(entries[border]), _CELLS) for a in range(lo, hi, most)):
        run = slice(border[lo], border[hi])
        src = _ranges(first[text[run]], size[text[run]])
        if not len(src):
            continue
        own = np.repeat(gen[run], size[text[run]])
        key = (own - lo) * len(vocab) + code[src]
        count[key] = 0
        np.add.at(count, key, dfs[src] * np.repeat(times[run], size[text[run]]))
        at = np.arange(len(key))
        last[key] = at
        keep = last[key] == at  # each token of a generation once
        if mean_idf is not None and asks is not None:
            flag[mine := among(lo, hi)] = True
            keep &= flag[key]
            flag[mine] = False
        key, g = key[keep], own[keep]
        df = count[key]
        raw = np.log(n_docs[g] - df + 0.5) - np.log(df + 0.5)
        if mean_idf is not None:
            idf = np.where(raw < 0, EPSILON * mean_idf[g], raw)
            yield pa.table({"gen_id": gens[g], "token": vocab.take(key % len(vocab)), "df": df, "idf": idf})
            continue
        flag[mine := among(lo, hi)] = True
        keep = flag[key]
        flag[mine] = False
        ends = np.searchsorted(g[keep], np.arange(lo, hi + 1))
        lists = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x)
        yield pa.table({"gen_id": gens[lo:hi], "s": np.bincount(g - lo, raw, minlength=hi - lo), "n": np.bincount(g - lo, minlength=hi - lo),
                        "tokens": lists(vocab.take(key[keep] % len(vocab))), "dfs": lists(pa.array(df[keep]))})


def _asked(asks: pa.Table, gens: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(number of the generation, or -1; token) of each word in rows (gen_id, tokens)."""
    words = pc.split_pattern(asks["tokens"].combine_chunks(), " ")
    row = {g: i for i, g in enumerate(gens.tolist())}
    return np.repeat(np.array([row.get(g, -1) for g in asks["gen_id"].to_pylist()], np.int64), _lengths(words)), words.flatten()


def _idf_of_block(whole: bool) -> Callable[[Iterator], Iterator[pa.Table]]:
    """The weights of all tokens of a block's generations, or of those asked for: hits (0), tokens asked for (1), then the texts' tokens part by part (2).

    The means need all parts and come before the weights, so the parts pass twice; between, they lie in a file of the task's own."""
    def fn(rows: Iterator[tuple]) -> Iterator[pa.Table]:
        hits, asks, counted, spool, state = [], [], [], None, None
        with SpooledTemporaryFile(max_size=_HELD) as file:
            for (kind, _), own in groupby(rows, lambda x: x[:2]):
                tables = [t for _, _, t in own]
                if kind < 2:
                    (hits, asks)[kind].extend(tables)
                    continue
                if not hits:
                    return
                if state is None:
                    held = pa.concat_tables(hits).combine_chunks()
                    gens, ids = held["gen_id"].to_numpy(), held["ids"].combine_chunks()
                    asked = _asked(pa.concat_tables(asks).combine_chunks(), gens) if asks else (np.empty(0, np.int64), pa.array([], pa.string()))
                    state = gens, held["n_docs"].to_numpy(), _lengths(ids), ids.flatten().to_numpy(zero_copy_only=False)
                part = pa.concat_tables(tables).select(["text_ids", "tokens", "dfs"]).combine_chunks()
                spool = spool or pa.ipc.new_stream(file, part.schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))
                [batch] = part.to_batches()  # a token's texts in a part are counted together
                spool.write_batch(batch)
                counted += [t.select(["gen_id", "s", "n"]) for t in _hit_counts(part, *state)]
            if spool is None or not counted:
                return
            spool.close()
            row = {g: i for i, g in enumerate(gens.tolist())}
            found = pa.concat_tables(counted)
            at = np.array([row[g] for g in found["gen_id"].to_pylist()], np.int64)
            s, n = (np.bincount(at, found[c].to_numpy(), minlength=len(gens)) for c in ("s", "n"))
            mean = s / np.maximum(n, 1)
            file.seek(0)
            for batch in pa.ipc.open_stream(file):
                yield from _hit_counts(pa.Table.from_batches([batch]), *state, None if whole else asked, mean)
    return fn


def hit_idf(placed: DataFrame, postings: DataFrame, stats: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """A3: ``idf_table`` from hits and postings -> (gen_id, token, df, idf); with ``wanted`` (gen_id, token) of these tokens only.

    A generation's hits go once to its block and each text's tokens once to each block of generations that hit it.  A block's task counts the
    distinct tokens of its generations part by part, which gives the means, and goes through the parts again for the weights."""
    postings = packed_postings(postings)
    hits_, rows = placed.count(), int(postings.agg(F.sum(F.size("dfs"))).first()[0] or 0)
    blocks, parts = max(LEAST_BLOCKS, -(-hits_ // BLOCK_HITS)), max(1, -(-rows // PART_TOKENS))
    own = placed.where("gen_id is not null")
    gen_id, zero = F.col("gen_id").cast("long").alias("gen_id"), F.lit(0).alias("part")
    # a generation's hits are bounded by its names
    hits = own.groupBy(gen_id).agg(F.collect_list(F.col("text_id").cast("long")).alias("ids")).join(
        stats.select(gen_id, F.col("n_docs").cast("long").alias("n_docs")), "gen_id").select(
        block_of(blocks), F.lit(0).alias("kind"), zero, "gen_id", "n_docs", "ids")
    split = postings.select(F.col("text_id").cast("long").alias("text_id"), "tokens", "dfs").mapInArrow(
        _split_fn(parts), "text_id bigint, part int, tokens string, dfs array<int>")
    texts = block_texts(split, own, blocks).select("block", F.lit(2).alias("kind"), "part", F.array("text_id").alias("text_ids"), "tokens", "dfs")
    every = [hits, texts]
    if wanted is not None:
        every.append(wanted.where("gen_id is not null and token is not null").groupBy(gen_id).agg(F.collect_set("token").alias("_t")).select(
            block_of(blocks), F.lit(1).alias("kind"), zero, "gen_id", F.array_join("_t", " ").alias("tokens")))
    return _in_blocks(every, blocks, _idf_of_block(wanted is None), "gen_id bigint, token string, df bigint, idf double", 1 << 16)


def hit_tokens(placed: DataFrame, postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """``passage_tokens`` of the tokens (gen_id, token) that facts have, from hits and postings -> (gen_id, pos, token, tf, dl)."""
    found = salted_join(placed.select("gen_id", "offset", "text_id"), postings.select("text_id", "token", "entries"), ["text_id"], text_counts(placed), "n",
                        ["gen_id", "offset"])
    return (found.join(wanted, ["gen_id", "token"], "left_semi").select("gen_id", "offset", "token", F.inline("entries"))
            .select("gen_id", (F.col("offset") + F.col("idx")).alias("pos"), "token", "tf", "dl"))


def fact_tokens(facts: DataFrame) -> DataFrame:
    """(gen_id, fact_id, token, qn): query tokens with their repeat count."""
    return (facts.select("gen_id", "fact_id", F.explode(T.tokens(F.col("fact"))).alias("token"))
            .groupBy("gen_id", "fact_id", "token").agg(F.count(F.lit(1)).alias("qn")))


def hot_tokens(qtoks: DataFrame, salt_rows: int) -> DataFrame:
    """(gen_id, token, salts) of the fact tokens that occur in more than ``salt_rows`` passages."""
    return qtoks.where(F.col("df") > salt_rows).select(
        "gen_id", "token", F.ceil(F.col("df") / salt_rows).cast("int").alias("salts")).distinct()


def salted_match(qtoks: DataFrame, ptoks: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows of fact tokens (gen_id, token, ...) with those of passage tokens
    (gen_id, token, pos, ...) of the same key; hot keys are split."""
    n = F.coalesce("salts", F.lit(1))
    spread_q = qtoks.join(hot, ["gen_id", "token"], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("salts")
    dealt = ptoks.join(hot, ["gen_id", "token"], "left").withColumn("_salt", F.pmod(F.xxhash64("pos"), n).cast("int")).drop("salts")
    return spread_q.join(dealt, ["gen_id", "token", "_salt"]).drop("_salt")


def query_tokens(facts: DataFrame, idf: DataFrame, stats: DataFrame) -> DataFrame:
    """(gen_id, token, fact_id, qn, df, idf, avgdl): the fact tokens that the corpus knows, with their weights."""
    return fact_tokens(facts).join(idf, ["gen_id", "token"]).join(stats.select("gen_id", "avgdl"), "gen_id")


def match_scores(qtoks: DataFrame, ptoks: DataFrame, hot: DataFrame) -> DataFrame:
    """A4: the shares of all (fact token, passage) matches added up -> (gen_id, fact_id, pos, score)."""
    w = (F.col("idf") * F.col("tf") * (K1 + 1)
         / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))))
    return salted_match(qtoks, ptoks, hot).groupBy("gen_id", "fact_id", "pos").agg(F.sum(F.col("qn") * w).alias("score"))


def bm25_scores(facts: DataFrame, ptoks: DataFrame, stats: DataFrame, store: Store, salt_rows: int = SALT_ROWS) -> DataFrame:
    """A4 + J5: sparse scores -> (gen_id, fact_id, pos, score) for pairs sharing a token.

    The fact tokens with their weights and the few hot tokens are written to
    ``store`` first: Spark then knows how small the hot ones are, and doesn't move
    the passage tokens for them.
    """
    qtoks = store.keep("bm25_query", query_tokens(facts, idf_table(ptoks, stats), stats))
    return match_scores(qtoks, ptoks, store.keep("bm25_hot", hot_tokens(qtoks, salt_rows)))


def bm25_topk(facts: DataFrame, passages: DataFrame, n: int = TOP_N, store: Store | None = None,
              salt_rows: int = SALT_ROWS) -> DataFrame:
    """The top ``n`` passages (gen_id, pos, text) of every fact -> (gen_id, fact_id, pos, rk, score).

    Only facts of generations that have passages get rows.  Zero scores still
    fill the ``n`` places.  The passage tokens, the corpus statistics, the fact tokens and
    the nonzero scores are written once to ``store``, as each has several readers.
    """
    store = store or Store(facts.sparkSession)
    ptoks = store.keep("bm25_tokens", passage_tokens(passages))
    stats = store.keep("bm25_stats", corpus_stats(ptoks))
    return ranked(facts, bm25_scores(facts, ptoks, stats, store, salt_rows), stats, n, store)


def weighted(ptoks: DataFrame, qtoks: DataFrame) -> DataFrame:
    """(gen_id, token, pos, w): what one occurrence of a fact's token adds to a passage's score."""
    known = qtoks.groupBy("gen_id", "token").agg(F.max("idf").alias("idf"), F.max("avgdl").alias("avgdl"))
    w = (F.col("idf") * F.col("tf") * (K1 + 1)
         / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))))
    return ptoks.join(known, ["gen_id", "token"]).select("gen_id", "token", "pos", w.alias("w"))


def bounded_tokens(qtoks: DataFrame, shares: DataFrame, n: int) -> DataFrame:
    """The fact tokens (gen_id, token, fact_id, qn, df) with bounds from the shares (gen_id, token, pos, w):
    ``skip``, whether passages that only this and weaker skipped tokens lead to can't be among the
    fact's ``n`` best; ``least``, which the n-th best score is not below; ``rest``, what the skipped tokens add at most.

    A token that ``n`` passages have makes each of their scores at least its n-th
    largest share, less what tokens of negative weight may take away.  Tokens are
    skipped from the weakest on as long as their largest shares together stay below the best such bound.
    """
    w = Window.partitionBy("gen_id", "token").orderBy(F.col("w").desc())
    tops = shares.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).groupBy("gen_id", "token").agg(
        F.max("w").alias("hi"), F.min(F.when(F.col("_n") == n, F.col("w"))).alias("nth"))
    lows = shares.groupBy("gen_id", "token").agg(F.min("w").alias("lo"))
    known = qtoks.join(tops.join(lows, ["gen_id", "token"]), ["gen_id", "token"]).select(
        "gen_id", "token", "fact_id", "qn", "df", (F.col("qn") * F.greatest("hi", F.lit(0.0))).alias("gain"),
        (F.col("qn") * F.least("lo", F.lit(0.0))).alias("loss"), (F.col("qn") * F.col("nth")).alias("sure"))
    fact = Window.partitionBy("gen_id", "fact_id")
    upto = fact.orderBy("gain", "token").rowsBetween(Window.unboundedPreceding, 0)
    least = F.max("sure").over(fact) + F.sum("loss").over(fact)
    bound = known.withColumn("least", least).withColumn("_gains", F.sum("gain").over(upto))
    # without n passages above zero the zeros count too: nothing is skipped then
    skip = F.coalesce((F.col("least") > TIE) & (F.col("_gains") < F.col("least") - TIE), F.lit(False))
    marked = bound.withColumn("skip", skip)
    rest = F.sum(F.when(F.col("skip"), F.col("gain")).otherwise(0.0)).over(fact)
    return marked.withColumn("rest", rest).select("gen_id", "token", "fact_id", "qn", "df", "skip", "least", "rest")


def bounded_scores(bounds: DataFrame, shares: DataFrame, hot: DataFrame) -> DataFrame:
    """A4 for the passages that may be among a fact's best -> (gen_id, fact_id, pos, score).

    Passages are found by the tokens that aren't skipped; what the skipped
    ones add is looked up for those of them that can still reach the bound."""
    found = salted_match(bounds.where("not skip"), shares, hot).groupBy("gen_id", "fact_id", "pos").agg(
        F.sum(F.col("qn") * F.col("w")).alias("part"), F.max("least").alias("least"), F.max("rest").alias("rest"))
    able = found.where((F.col("rest") == 0) | (F.col("part") + F.col("rest") >= F.col("least") - TIE))
    weak = bounds.where("skip").select("gen_id", "fact_id", "token", "qn")
    more = able.where("rest > 0").select("gen_id", "fact_id", "pos").join(weak, ["gen_id", "fact_id"]).join(shares, ["gen_id", "token", "pos"]).groupBy(
        "gen_id", "fact_id", "pos").agg(F.sum(F.col("qn") * F.col("w")).alias("more"))
    return able.join(more, ["gen_id", "fact_id", "pos"], "left").select(
        "gen_id", "fact_id", "pos", (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("score"))


def _rounded(scores: np.ndarray) -> np.ndarray:
    """Scores as they are ranked."""
    return np.floor(np.abs(scores) * 1e9 + 0.5) / 1e9 * np.sign(scores)


def _best(scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, rounded score) of the ``n`` best of each row, of equal ones the last first."""
    kk, size = min(n, scores.shape[1]), scores.shape[1]
    least = -np.partition(-scores, kk - 1, axis=1)[:, kk - 1]
    kth = _rounded(least)  # rounding keeps the order
    scores = scores[:, ::-1]  # of equal ones the last is the best
    i, j = np.nonzero(scores >= (least - 2e-9 - 1e-14 * np.abs(least))[:, None])
    top = _rounded(scores[i, j])
    reach = top >= kth[i]
    i, j, top = i[reach], j[reach], top[reach]
    same = top == kth[i]
    above = np.bincount(i[~same], minlength=len(scores))
    # the first of those that equal the last one kept
    nth = np.cumsum(same)
    before = np.concatenate([[0], nth])[np.searchsorted(i, np.arange(len(scores)))]
    keep = ~same | (nth - before[i] <= (kk - above)[i])
    return i[keep], size - 1 - j[keep], top[keep] + 0.0


def blocks_of(facts: DataFrame, placed: DataFrame) -> int:
    """Blocks of generations, so that the facts and hits of one stay in bounds: one small job for each."""
    return max(LEAST_BLOCKS, -(-facts.count() // BLOCK_FACTS), -(-placed.count() // BLOCK_HITS))


def _in_blocks(rows: list[DataFrame], blocks: int, one: Callable[[Iterator], Iterator[pa.Table]], schema: str, most: int = 1 << 12) -> DataFrame:
    """``one`` over the rows (block, kind, part, ...) of each block, given in the order of kind and part as (kind, part, table)."""
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r, allowMissingColumns=True)
    # lists that a kind of rows doesn't have are empty: on its way to Python, each row after a null list goes through all nulls before it
    lists = {f.name: f.dataType for f in every.schema if isinstance(f.dataType, ArrayType)}
    every = every.select(*[F.coalesce(c, F.array().cast(lists[c])).alias(c) if c in lists else F.col(c) for c in every.columns])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            if batch.num_rows:
                key = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ("block", "kind", "part")])
                new = np.flatnonzero((np.diff(key, axis=1) != 0).any(axis=0)) + 1
                for lo, hi in pairwise([0, *new.tolist(), batch.num_rows]):
                    yield (*key[:, lo].tolist(), pa.Table.from_batches([batch.slice(lo, hi - lo)]))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in groupby(runs(batches), lambda x: x[0]):
            for rows in one((kind, part, t) for _, kind, part, t in own):
                yield from rows.combine_chunks().to_batches(max_chunksize=most)

    return every.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "kind", "part").mapInArrow(fn, schema)


def block_facts(facts: DataFrame, blocks: int) -> DataFrame:
    """The facts' words for their block -> (block, kind, part, gen_id, fact_id, tokens)."""
    words = T.tokens(F.col("fact"))
    return facts.where("gen_id is not null").select(block_of(blocks), F.lit(1).alias("kind"), F.lit(0).alias("part"), F.col("gen_id").cast("long").alias("gen_id"),
                                                    "fact_id", F.when(F.size(words) > 0, F.array_join(words, " ")).alias("tokens"))


def _split_fn(parts: int):
    """The tokens of each text dealt over parts by their hash: a row for each (text, part) that has any."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = pc.split_pattern(batch["tokens"], " ")
            coded = tokens.flatten().dictionary_encode()
            of_word = np.array([crc32(w.encode()) % parts for w in coded.dictionary.to_pylist()], np.int64)
            key = np.repeat(np.arange(batch.num_rows), _lengths(tokens)) * parts + of_word[coded.indices.to_numpy(zero_copy_only=False)]
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            ends = pa.array(np.append(first, len(key)), pa.int32())
            lists = lambda x: pa.ListArray.from_arrays(ends, x.take(pa.array(order)))
            key = key[first]
            yield pa.RecordBatch.from_pydict({"text_id": batch["text_id"].take(pa.array(key // parts)), "part": pa.array(key % parts, pa.int32()),
                                              "tokens": pc.binary_join(lists(tokens.flatten()), " "), "dfs": lists(batch["dfs"].flatten())})
    return fn


def _weights_of_block(rows: Iterator[tuple]) -> Iterator[pa.Table]:
    """The weights of a block's generations: hits (0), facts (1), then the texts' tokens part by part (2)."""
    hits, asks, sums, state = [], [], [], None

    def ready() -> tuple:
        held = pa.concat_tables(hits).combine_chunks()
        gens, ids = held["gen_id"].to_numpy(), held["ids"].combine_chunks()
        words = _asked(pa.concat_tables(asks).combine_chunks(), gens) if asks else None
        return held, (gens, held["n_docs"].to_numpy(), _lengths(ids), ids.flatten().to_numpy(zero_copy_only=False), words)

    for (kind, _), own in groupby(rows, lambda x: x[:2]):
        tables = [t for _, _, t in own]
        if kind < 2:
            (hits, asks)[kind].extend(tables)
        elif hits:
            state = state or ready()
            sums += _hit_counts(pa.concat_tables(tables).combine_chunks(), *state[1])
    if not hits:
        return
    held = (state or ready())[0].sort_by("gen_id").combine_chunks()
    gens = held["gen_id"].to_numpy()
    if not sums:
        sums = [pa.table({"gen_id": gens[:0], "s": np.empty(0), "n": np.empty(0, np.int64), "tokens": pa.array([], pa.list_(pa.string())),
                          "dfs": pa.array([], pa.list_(pa.int64()))})]
    found = pa.concat_tables(sums).sort_by("gen_id").combine_chunks()
    row = np.searchsorted(gens, found["gen_id"].to_numpy())
    s, n = (np.bincount(row, found[c].to_numpy(), minlength=len(gens)) for c in ("s", "n"))
    sizes = np.bincount(row, _lengths(found["tokens"].combine_chunks()), minlength=len(gens)).astype(np.int64)
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    lists = lambda c: pa.ListArray.from_arrays(ends, found[c].combine_chunks().flatten())
    yield pa.table({**{c: held[c] for c in ("gen_id", "n_docs", "avgdl", "ids", "offsets", "n_sents")},
                    "mean_idf": pa.array(s / np.maximum(n, 1), mask=n == 0), "tokens": lists("tokens"), "dfs": lists("dfs")})


def block_weights(facts: DataFrame, placed: DataFrame, postings: DataFrame) -> DataFrame:
    """A3 of the facts' tokens, a row for each generation that hit a text -> (gen_id, n_docs, avgdl, ids, offsets, n_sents, mean_idf, tokens, dfs).

    Each text brings its tokens once to each block of generations that hit it.  A block's task counts
    them part by part of the tokens; a generation's hits come as one row, as its names bound them."""
    blocks, postings = blocks_of(facts, placed), packed_postings(postings)
    parts = max(1, -(-int(postings.agg(F.sum(F.size("dfs"))).first()[0] or 0) // PART_TOKENS))
    own = placed.where("gen_id is not null")
    longs = [F.col(c).cast("long").alias(c) for c in ("text_id", "offset", "n_sents")]
    hits = own.groupBy(F.col("gen_id").cast("long").alias("gen_id")).agg(
        F.collect_list(F.struct(*longs)).alias("_h"), F.sum("n_sents").cast("long").alias("n_docs"), (F.sum("n_tokens") / F.sum("n_sents")).alias("avgdl")).select(
        block_of(blocks), F.lit(0).alias("kind"), F.lit(0).alias("part"), "gen_id", "n_docs", "avgdl", F.col("_h.text_id").alias("ids"),
        F.col("_h.offset").alias("offsets"), F.col("_h.n_sents").alias("n_sents"))
    split = postings.select(F.col("text_id").cast("long").alias("text_id"), "tokens", "dfs").mapInArrow(
        _split_fn(parts), "text_id bigint, part int, tokens string, dfs array<int>")
    texts = block_texts(split, own, blocks).select("block", F.lit(2).alias("kind"), "part", F.array("text_id").alias("text_ids"), "tokens", "dfs")
    return _in_blocks([hits, block_facts(facts, blocks).drop("fact_id"), texts], blocks, _weights_of_block,
                      "gen_id bigint, n_docs bigint, avgdl double, ids array<bigint>, offsets array<bigint>, n_sents array<bigint>, mean_idf double, "
                      "tokens array<string>, dfs array<bigint>")


def _fact_terms(words: pa.Array, fact: np.ndarray, own: np.ndarray, weights: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(vocabulary, code, weight, first row of each fact): the distinct tokens of each fact that its generation's corpus knows,
    each with its number in the fact times its idf.  ``words`` are the tokens of the facts ``fact``, ``own`` is each fact's row of ``weights``."""
    known = weights["tokens"].combine_chunks()
    vocab, size = pc.unique(known.flatten()), _lengths(known)
    df = weights["dfs"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    n_docs, mean = (np.repeat(weights[c].to_numpy(), size) for c in ("n_docs", "mean_idf"))
    raw = np.log(n_docs - df + 0.5) - np.log(df + 0.5)
    idf = np.where(raw < 0, EPSILON * mean, raw)
    key = np.repeat(np.arange(len(size)), size) * len(vocab) + pc.index_in(known.flatten(), value_set=vocab).to_numpy(zero_copy_only=False)
    order = np.argsort(key, kind="stable")
    key, idf = key[order], idf[order]
    code = pc.fill_null(pc.index_in(words, value_set=vocab), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    fact, code = fact[code >= 0], code[code >= 0]
    term, times = np.unique(fact * max(1, len(vocab)) + code, return_counts=True)
    fact, code = term // max(1, len(vocab)), term % max(1, len(vocab))
    mine = own[fact]
    at = np.minimum(np.searchsorted(key, mine * len(vocab) + code), max(0, len(key) - 1))
    met = key[at] == mine * len(vocab) + code if len(key) else np.zeros(len(mine), bool)
    fact, code, weight = fact[met], code[met], (times * idf[at] if len(key) else np.empty(0))[met]
    return vocab, code, weight, np.searchsorted(fact, np.arange(len(own) + 1))


class _Block:
    """The facts of a block of generations, their weights and hits, and the ``n`` best passages of each fact among the texts so far."""

    def __init__(self, weights: pa.Table, facts: pa.Table, n: int, part_rows: int):
        self.n, self.part_rows = n, part_rows
        weights, facts = weights.sort_by("gen_id").combine_chunks(), facts.sort_by("gen_id").combine_chunks()
        self.gens, self.avgdl = weights["gen_id"].to_numpy(), weights["avgdl"].to_numpy()
        # facts of generations without hits have no passages; a fact that is given several times is one fact with all their words
        facts = facts.filter(pa.array(np.isin(facts["gen_id"].to_numpy(), self.gens))).combine_chunks()
        gen = np.searchsorted(self.gens, facts["gen_id"].to_numpy())
        names = facts["fact_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        number = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, at, fact, self.copies = np.unique(gen * max(1, len(names.dictionary)) + number, return_index=True, return_inverse=True, return_counts=True)
        self.facts = facts.select(["gen_id", "fact_id"]).take(pa.array(at))
        self.first_fact = np.searchsorted(gen[at], np.arange(len(self.gens) + 1))
        words = pc.split_pattern(facts["tokens"].combine_chunks(), " ")
        self.vocab, self.term, self.weight, self.first = _fact_terms(words.flatten(), np.repeat(fact, _lengths(words)), gen[at], weights)
        # the hits of each generation, in their order
        flat = lambda c: weights[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        gen, self.hit_id, self.offset, self.n_sents = np.repeat(np.arange(len(self.gens)), _lengths(weights["ids"].combine_chunks())), flat("ids"), flat("offsets"), flat("n_sents")
        order = np.lexsort((self.offset, gen))
        self.gen, self.hit_id, self.offset, self.n_sents = gen[order], self.hit_id[order], self.offset[order], self.n_sents[order]
        self.met = np.zeros(len(order), bool)
        self.best = tuple(np.empty(0, k) for k in (int, int, float, float, int, int))

    def score(self, texts: pa.Table | None) -> None:
        """Looks through the hits on these texts; without texts, through those on texts that have no postings."""
        if texts is None:
            mine, tokens, code, dfs, idx, tf, dl, ids = ~self.met, None, *(np.empty(0, np.int64) for _ in range(6))
        else:
            flat = lambda c: texts[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            # the texts' postings of the facts' tokens: rows of (code, first entry, entries), text by text
            tokens = pc.split_pattern(texts["tokens"].combine_chunks(), " ")
            code = pc.fill_null(pc.index_in(tokens.flatten(), value_set=self.vocab), -1).to_numpy(zero_copy_only=False)
            dfs, idx, tf, dl = (flat(c).astype(np.int64) for c in ("dfs", "idx", "tf", "dl"))
            ids = texts["text_id"].to_numpy()
            mine = np.isin(self.hit_id, ids)
            self.met |= mine
        gens, hit_id, offset, n_sents = self.gen[mine], self.hit_id[mine], self.offset[mine], self.n_sents[mine]
        used = np.flatnonzero(code >= 0)
        code, start, dfs = code[used], (np.cumsum(dfs) - dfs)[used], dfs[used]
        if texts is None:
            lo = hi = np.zeros(len(hit_id), np.int64)
        else:
            at_text = np.searchsorted(used, np.concatenate([[0], np.cumsum(_lengths(tokens))]))
            by_id = np.argsort(ids, kind="stable")
            text = by_id[np.searchsorted(ids[by_id], hit_id)]
            lo, hi = at_text[text], at_text[text + 1]
        out, place, n = [self.best], np.full(len(self.vocab), -1), self.n
        first, term, weight = self.first, self.term, self.weight
        for g in np.unique(gens):
            f0, f1 = self.first_fact[g], self.first_fact[g + 1]
            if f0 == f1:
                continue
            h0, h1 = np.searchsorted(gens, g), np.searchsorted(gens, g, side="right")
            avgdl = self.avgdl[g]
            mine, t_all = np.unique(term[first[f0]:first[f1]], return_inverse=True)
            place[mine] = np.arange(len(mine))
            for r0, r1 in _runs(n_sents[h0:h1], self.part_rows):
                run = slice(h0 + r0, h0 + r1)
                before = np.cumsum(n_sents[run]) - n_sents[run]
                size = int(n_sents[run].sum())
                src = _ranges(lo[run], hi[run] - lo[run])
                hit = np.repeat(np.arange(r1 - r0), hi[run] - lo[run])
                own = place[code[src]]
                src, hit, own = src[own >= 0], hit[own >= 0], own[own >= 0]
                order = np.argsort(own, kind="stable")
                src, hit, own = src[order], hit[order], own[order]
                entry = _ranges(start[src], dfs[src])
                pos = np.repeat(before[hit], dfs[src]) + idx[entry]
                share = tf[entry] * (K1 + 1) / (tf[entry] + K1 * (1 - B + B * dl[entry] / avgdl))
                starts = np.concatenate([[0], np.cumsum(np.bincount(own, dfs[src], minlength=len(mine)).astype(np.int64))])
                of_pos = np.repeat(np.arange(r1 - r0), n_sents[run])
                in_text = np.arange(size) - before[of_pos]
                step = max(1, _CELLS // size)
                for a in range(f0, f1, step):
                    b = min(a + step, f1)
                    scores = np.zeros((b - a) * size)
                    row = np.repeat(np.arange(b - a), np.diff(first[a:b + 1])) * size
                    t, w = t_all[first[a] - first[f0]:first[b] - first[f0]], weight[first[a]:first[b]]
                    met = starts[t + 1] - starts[t]
                    for x, y in _runs(met, _CELLS):
                        m = met[x:y]
                        where = _ranges(starts[t[x:y]], m)
                        scores += np.bincount(np.repeat(row[x:y], m) + pos[where], np.repeat(w[x:y], m) * share[where], minlength=len(scores))
                    scores = scores.reshape(b - a, size)
                    i, j, top = _best(scores, n)
                    h = h0 + r0 + of_pos[j]
                    out.append((i + a, offset[h] + in_text[j], np.where(top == 0, 0.0, scores[i, j]), top, hit_id[h], in_text[j]))
            place[mine] = -1
        self._keep(tuple(np.concatenate(x) for x in zip(*out, strict=True)))

    def _keep(self, found: tuple) -> None:
        """The ``n`` best of each fact, of equal ones the last position first."""
        order = np.lexsort((-found[1], -found[3], found[0]))
        fact = found[0][order]
        order = order[np.arange(len(fact)) - np.searchsorted(fact, fact) < self.n]
        self.best = tuple(x[order] for x in found)

    def rows(self) -> pa.Table:
        """A row for each fact with its best, in order; a fact given several times has its zeros several times."""
        again = np.where(self.best[3] == 0, self.copies[self.best[0]], 1)
        self._keep(tuple(np.repeat(x, again) for x in self.best))
        fact, pos, score, _, text, idx = self.best
        first = np.flatnonzero(np.diff(fact, prepend=-1))
        ends = pa.array(np.append(first, len(fact)), pa.int32())
        lists = {c: pa.ListArray.from_arrays(ends, pa.array(x, k)) for c, x, k in (
            ("pos", pos, pa.int64()), ("score", score, pa.float64()), ("text_id", text, pa.int64()), ("idx", idx, pa.int32()))}
        own = self.facts.take(pa.array(fact[first]))
        return pa.table({"gen_id": own["gen_id"], "fact_id": own["fact_id"], **lists})


def _block_fn(n: int, part_rows: int):
    """The best passages of a block's facts: weights with hits (0), facts (1), then texts (2), ``PART_ENTRIES`` places of tokens at a time."""
    most = PART_ENTRIES

    def fn(rows: Iterator[tuple]) -> Iterator[pa.Table]:
        held, block, waiting, size = ([], []), None, [], 0

        def scored() -> None:
            texts = pa.concat_tables(waiting).combine_chunks()
            for lo, hi in _runs(_lengths(texts["idx"].combine_chunks()), most):
                block.score(texts.slice(lo, hi - lo).combine_chunks())
            waiting.clear()

        for kind, _, t in rows:
            if kind < 2:
                held[kind].append(t)
                continue
            if not all(held):
                return
            block = block or _Block(*map(pa.concat_tables, held), n, part_rows)
            waiting.append(t)
            size += int(_lengths(t["idx"].combine_chunks()).sum())
            if size >= most:
                scored()
                size = 0
        if not all(held):
            return
        block = block or _Block(*map(pa.concat_tables, held), n, part_rows)
        if waiting:
            scored()
        block.score(None)
        yield block.rows()
    return fn


def block_scores(facts: DataFrame, query: DataFrame, postings: DataFrame, n: int, part_rows: int) -> DataFrame:
    """A4 + W1 by blocks of generations -> (gen_id, fact_id, pos, score, text_id, idx): a row for each fact with lists of its ``n`` best
    passages, the best first, and the sentence each is.

    ``query`` has a row for each generation, as of ``block_weights``.  Facts and hits go to their block once, and each
    text once to each block that hits it; its task goes through the texts in bounded parts, ``part_rows`` of a generation's positions
    at a time, and keeps the best so far.  So what is shuffled grows with facts, hits, and texts times blocks, and only the best leave the tasks."""
    own = query.select("gen_id", F.explode("ids").alias("text_id"))
    blocks, kind = blocks_of(facts, own), facts.schema["fact_id"].dataType.simpleString()
    weights = query.select(block_of(blocks), F.lit(0).alias("kind"), F.lit(0).alias("part"), "gen_id", "n_docs", "avgdl", "mean_idf", "ids", "offsets", "n_sents",
                           F.col("tokens").alias("known"), F.col("dfs").cast("array<bigint>").alias("known_dfs"))
    held, numbers = packed_postings(postings), ("dfs", "idx", "tf", "dl")
    most_of = held.agg(*[F.max(F.array_max(c)) for c in numbers]).first()
    short = "array<smallint>" if max(x or 0 for x in most_of) < 1 << 15 else "array<int>"  # half the bytes, where they do
    held = held.select(F.col("text_id").cast("long").alias("text_id"), "tokens", *[F.col(c).cast(short).alias(c) for c in numbers])
    texts = block_texts(held, own, blocks).select("block", F.lit(2).alias("kind"), F.lit(0).alias("part"), "text_id", "tokens", "dfs", "idx", "tf", "dl")
    best = _block_fn(n, part_rows)

    def one(rows: Iterator[tuple]) -> Iterator[pa.Table]:
        cut = {0: ["gen_id", "n_docs", "avgdl", "mean_idf", "ids", "offsets", "n_sents", "known", "known_dfs"], 1: ["gen_id", "fact_id", "tokens"],
               2: ["text_id", "tokens", "dfs", "idx", "tf", "dl"]}
        named = {"known": "tokens", "known_dfs": "dfs"}
        return best((k, p, t.select(cut[k]).rename_columns([named.get(c, c) for c in cut[k]])) for k, p, t in rows)

    return _in_blocks([weights, block_facts(facts, blocks), texts], blocks, one,
                      f"gen_id bigint, fact_id {kind}, pos array<bigint>, score array<double>, text_id array<bigint>, idx array<int>")


def hits_topk(facts: DataFrame, placed: DataFrame, postings: DataFrame, n: int = TOP_N, store: Store | None = None,
              salt_rows: int = SALT_ROWS, bounded: bool = False, in_parts: bool = False) -> DataFrame:
    """W1 as ``bm25_topk``, with each generation's corpus given by its hits on texts and the texts' postings.

    ``in_parts`` scores a part of the texts for a block of generations within a task, ``salt_rows`` positions at a time:
    ``bm25_nonzero`` then holds the best of each, zeros among them, and the result has (text_id, idx) too, the sentence that a passage is.  ``bounded`` leaves out passages that can't be among a fact's best,
    which pays where facts share common words with very many passages."""
    store = store or Store(facts.sparkSession)
    if in_parts:
        query = store.keep("bm25_query", block_weights(facts, placed, postings))
        best = store.keep("bm25_nonzero", block_scores(facts, query, postings, n, salt_rows))
        fields = ("pos", "score", "text_id", "idx")
        return best.select("gen_id", "fact_id", F.posexplode(F.arrays_zip(*fields)).alias("_at", "_b")).select(
            "gen_id", "fact_id", "_b.pos", (F.col("_at") + 1).alias("rk"), "_b.score", "_b.text_id", "_b.idx")
    stats = hit_stats(placed)
    toks = fact_tokens(facts)
    idf = hit_idf(placed, postings, stats, toks.select("gen_id", "token").distinct())
    qtoks = store.keep("bm25_query", toks.join(idf, ["gen_id", "token"]).join(stats.select("gen_id", "avgdl"), "gen_id"))
    ptoks = hit_tokens(placed, postings, qtoks.select("gen_id", "token").distinct())
    hot = hot_tokens(qtoks, salt_rows)
    if not bounded:
        return ranked(facts, match_scores(qtoks, ptoks, hot), stats, n, store)
    shares = store.keep("bm25_shares", weighted(ptoks, qtoks))
    bounds = store.keep("bm25_bounds", bounded_tokens(qtoks, shares, n))
    return ranked(facts, bounded_scores(bounds, shares, hot), stats, n, store)


def top_ranks(scored: DataFrame, n: int) -> DataFrame:
    """The ``n`` best of (gen_id, fact_id, pos, score, rank_score) for each fact, of equal ones the last position first."""
    w = Window.partitionBy("gen_id", "fact_id").orderBy(F.col("rank_score").desc(), F.col("pos").desc())
    return (scored.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= n)
            .select("gen_id", "fact_id", "pos", "rk", "score", *[c for c in ("text_id", "idx") if c in scored.columns]))


def ranked(facts: DataFrame, scores: DataFrame, stats: DataFrame, n: int, store: Store) -> DataFrame:
    """The ``n`` best passages of each fact by its nonzero ``scores``, then by position among the zeros."""
    # rank on the score rounded to 9 places (sums of doubles differ in the last
    # bits between engines); keep the unrounded sum as the published score
    sparse = scores.withColumn("rank_score", F.round("score", 9))
    nonzero = store.keep("bm25_nonzero", sparse.where(F.col("rank_score") != 0))
    counts = nonzero.groupBy("gen_id", "fact_id").agg(
        F.sum((F.col("rank_score") > 0).cast("int")).alias("n_pos"),
        F.count(F.lit(1)).alias("n_nz"))
    need = (facts.select("gen_id", "fact_id").join(stats.select("gen_id", "n_docs"), "gen_id")
            .join(counts, ["gen_id", "fact_id"], "left")
            .select("gen_id", "fact_id", "n_docs",
                    F.coalesce("n_pos", F.lit(0)).alias("n_pos"),
                    F.coalesce("n_nz", F.lit(0)).alias("n_nz"))
            .where(F.col("n_pos") < n))
    # highest positions first: among the last (n - n_pos) + n_nz positions at
    # least n - n_pos are zero-score passages, and they are the best zeros
    lo = F.greatest(F.col("n_docs") - (F.lit(n) - F.col("n_pos")) - F.col("n_nz"), F.lit(0))
    cand = need.select("gen_id", "fact_id",
                       F.explode(F.sequence(lo, F.col("n_docs") - 1)).alias("pos"))
    zeros = (cand.join(nonzero.select("gen_id", "fact_id", "pos"), ["gen_id", "fact_id", "pos"], "left_anti")
             .withColumn("score", F.lit(0.0)).withColumn("rank_score", F.lit(0.0)))
    scored = nonzero.select("gen_id", "fact_id", "pos", "score", "rank_score").unionByName(zeros)
    return top_ranks(scored, n)
