"""MinHash near-dedup with an LSH forest.

Every text becomes the set of its distinct word shingles, hashed to 64 bits.
``TREES`` signature orders of ``max(DEPTHS)`` minhashes each form the forest.
Texts with equal sets are one class, represented by their smallest id.

* A region of a tree holds the classes that share the first d minhashes of
  its order.  Regions start at the smallest depth; one with more than
  ``REGION`` classes gives stars at the next depth as well, so their depth
  adapts to how dense a place of the order is.
* A pair is a candidate if the set sizes allow the similarity and the two
  128-bit sketches (one bit of 128 minhashes) differ in at most
  ``SKETCH_BITS`` bits; a pair at the threshold differs in 16 on average with
  a deviation of 3.7, so that passes it in all but about 1 of 10 million cases.
* First each member of a region, of any size and at every depth, is paired
  with the region's most central member (the one whose prefixes are shared
  most often over the forest).  These stars are confirmed on full sets and
  give a first set of components.
* Then the regions of the smallest depth that still hold several components meet in full: all pairs
  across components, large regions in pairs of blocks of about ``BLOCK`` members, so that no task
  holds a whole region and no pair is left out.  Blocks of a region's largest component don't
  meet each other.  A pair is looked at in the first tree that has both in a region.  Its sketches may differ in ``LOOSE_BITS`` bits,
  7 deviations from a pair at the threshold.  Members without such a pair drop out; the others meet
  again with their full sets, are compared exactly in the task, and what
  leaves the task is a spanning forest of the confirmed links.

Only ids, sketches and prefix hashes are shuffled for the search.  Full sets
are built again from the texts for classes that are in a candidate pair; a bit
map of their ids, of the fixed size ``2 ** FILTER_BITS`` bits, keeps most other
texts out before the exact semi-join.  A region with very many members is dealt over salts.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.llm.common import drop_stage, kept, ready, stage
from veracity.llm.components import connected_components, forest
from veracity.operators.skew import salted_join

WORDS = 5
PERCENT = 75
TREES = 24
DEPTHS = (2, 4, 6)
REGION = 24
BLOCK = 1024
BLOCK_SHINGLES = 1 << 20
SKETCH_BITS = 36
LOOSE_BITS = 44
FILTER_BITS = 24
_SLOTS = TREES * DEPTHS[-1]
_CACHE = 150_000

_rng = np.random.default_rng(20240229)
_LOW = _rng.integers(0, 2**32, _SLOTS, dtype=np.uint32) | np.uint32(1)
_HIGH = _rng.integers(0, 2**32, _SLOTS, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, _SLOTS, dtype=np.uint32)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes | None, words: int, hashes: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles.  ASCII letters
    are lower-cased and words are split at ASCII white space; a text of fewer
    words is one shingle, one without words has none."""
    if not text:
        return np.empty(0, np.uint64)
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += w[i:len(w) - n + 1 + i]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of the forest's hash functions over the set."""
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(_SLOTS, 2**32 - 1, np.uint32)
    for at in range(0, len(low), 1024):
        y = low[at:at + 1024, None] * _LOW
        y += high[at:at + 1024, None] * _HIGH
        y += _ADD
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        np.minimum(best, y.min(axis=0), out=best)
    return best


def prefix_keys(best: np.ndarray) -> np.ndarray:
    """A 64-bit key of every tree's prefix at every depth (depths x trees)."""
    m = best.reshape(TREES, DEPTHS[-1]).astype(np.uint64)
    h = np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keys = []
    for j in range(DEPTHS[-1]):
        h = (h ^ m[:, j]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        if j + 1 in DEPTHS:
            keys.append(h)
    return np.array(keys).view(np.int64)


_KEYS = [f"p{i}" for i in range(len(DEPTHS))]


def _describe(words: int):
    def run(batches):
        kept("shingles", dict)
        hashes = _WordHashes()
        for batch in batches:
            if not batch.num_rows:
                continue
            n, key, bits, keys = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), words, hashes)
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else bytes(16))
                m = minhashes(s)
                keys.append(prefix_keys(m))
                bits.append(np.packbits((m[:128] >> np.uint32(9)) & np.uint32(1)))
                if len(hashes) > _CACHE:
                    hashes.clear()
            k = np.frombuffer(b"".join(key), np.int64).reshape(-1, 2)
            b = np.concatenate(bits).view(np.int64).reshape(-1, 2)
            ends = pa.array(np.arange(len(n) + 1) * TREES, pa.int32())
            deep = np.array(keys)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), *(pa.array(x) for x in (k[:, 0], k[:, 1], b[:, 0], b[:, 1])),
                 *(pa.ListArray.from_arrays(ends, pa.array(deep[:, i].reshape(-1))) for i in range(len(DEPTHS)))],
                names=["doc_id", "n", "h1", "h2", "b1", "b2", *_KEYS])

    return run


def _sets(texts: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, s): the shingle sets of the texts whose doc_id is in ``ids`` (id)."""
    slot = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS))
    marks = ids.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {1 << FILTER_BITS}) & 63 as int))").alias("bit"))
    rows = marks.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2 ** FILTER_BITS / 64 rows at most
    full = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    full[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(full)

    def run(batches):
        hashes = _WordHashes()
        for batch in batches:
            at = batch.column(2).to_numpy()
            hit = np.flatnonzero(shared.value[at >> 6] >> (at & 63) & 1)
            for k in range(0, len(hit), 256):
                part = batch.take(pa.array(hit[k:k + 256]))
                sets = [shingle_set(t.as_py(), words, hashes) for t in part.column(1)]
                if len(hashes) > _CACHE:
                    hashes.clear()
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                                              pa.array(np.concatenate(sets).view(np.int64)))],
                    names=["id", "s"])

    known = texts.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text").select("id", "text", slot.alias("slot"))
    return stage(known.mapInArrow(run, "id long, s array<long>").join(ids, "id", "left_semi"), "sets")


def _close(a: str, b: str, percent: int):
    """The sizes allow the similarity and the sketches are near."""
    fit = F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * percent
    return fit & (_gap(a, b) <= SKETCH_BITS)


def _gap(a: str, b: str):
    return F.bit_count(F.col(f"{a}.b1").bitwiseXOR(F.col(f"{b}.b1"))) + F.bit_count(
        F.col(f"{a}.b2").bitwiseXOR(F.col(f"{b}.b2")))


def regions(classes: DataFrame) -> DataFrame:
    """A row for each class and region of the smallest depth that it shares
    with others: x (rep, n, b1, b2), cent, the keys k0, k1, ..., the tree and the size c0."""
    rows = classes.select("doc_id", F.posexplode(_KEYS[0]).alias("tree", "k0")).select("doc_id", "tree", "k0")
    shared = stage(rows.groupBy("k0").agg(F.count(F.lit(1)).alias("c0")).where("c0 > 1"), "sizes")
    live = stage(salted_join(rows, shared, ["k0"], shared, "c0", ["doc_id"]), "shared")
    cent = live.groupBy("doc_id").agg(F.sum("c0").alias("cent"))
    known = classes.join(cent, "doc_id").select(
        "doc_id", F.struct(F.col("doc_id").alias("rep"), F.col("n").cast("int").alias("n"), "b1", "b2").alias("x"), "cent", *_KEYS[1:])
    deeper = [F.col(p)[F.col("tree")].alias(f"k{i}") for i, p in enumerate(_KEYS) if i]
    out = stage(live.join(known, "doc_id").select("x", "cent", "tree", "k0", *deeper, "c0"), "regions")
    drop_stage(live)
    drop_stage(shared)
    return out


def _deeper(rows: DataFrame, i: int, region: int) -> DataFrame:
    """The rows of regions too large at depth i - 1, with their size at depth i."""
    large = rows.where(F.col(f"c{i - 1}") > region)
    sizes = large.groupBy(f"k{i}").agg(F.count(F.lit(1)).alias(f"c{i}")).where(f"c{i} > 1")
    return stage(salted_join(large, sizes, [f"k{i}"], sizes, f"c{i}", ["x.rep"]), "dense")


def star_pairs(rows: DataFrame, percent: int, region: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, of regions' members with their centres.
    Each depth is a job of its own, so that plans stay small."""
    pairs, first = [], rows
    for i in range(len(DEPTHS)):
        rows = _deeper(rows, i, region) if i else rows
        k = f"k{i}"
        centres = rows.groupBy(k).agg(F.max(F.struct("cent", (-F.col("x.rep")).alias("neg"), "x")).getField("x").alias("p"), F.count(F.lit(1)).alias("_n"))
        met = salted_join(rows, centres.drop("_n"), [k], centres.select(k, "_n"), "_n", ["x.rep"])
        own = met.where((F.col("x.rep") != F.col("p.rep")) & _close("x", "p", percent)).select(*_ordered("x", "p"))
        pairs.append(stage(own.distinct(), "pairs"))
        if i > 1:
            drop_stage(before)
        before = rows
    if before is not first:
        drop_stage(before)
    out = stage(reduce(DataFrame.union, pairs).distinct(), "stars")
    for p in pairs:
        drop_stage(p)
    return out


def _ordered(a: str, b: str) -> list:
    return [F.least(f"{a}.rep", f"{b}.rep").alias("a"), F.greatest(f"{a}.rep", f"{b}.rep").alias("b")]


def _meetings(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The members of mixed regions once for each meeting (g, i, j) that they are in: k0, tree, own, rep, n, b1, b2, c, first.

    ``rows`` name the component of each member in x.c; ``keys`` (doc_id, p0) are each class's regions
    in all trees.  A region is cut into blocks of about ``BLOCK`` members or ``BLOCK_SHINGLES`` shingles; those
    of its largest component, which need not meet each other, follow the others.  Regions of one block share a group."""
    parts = rows.groupBy("k0", F.col("x.c").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x.n").cast("long")).alias("words"))
    top = F.max(F.struct("n", "c", "words"))
    mixed = parts.groupBy("k0").agg(top.alias("top"), F.sum("n").alias("size"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    blocks = lambda n, w: F.ceil(F.greatest(n / BLOCK, w / BLOCK_SHINGLES)).cast("int")
    one = (F.col("size") <= BLOCK) & (F.col("words") <= BLOCK_SHINGLES)
    plan = mixed.select("k0", "size", F.col("top.c").alias("main"), F.when(one, 1).otherwise(blocks(F.col("size") - F.col("top.n"), F.col("words") - F.col("top.words"))).alias("few"),
                        F.when(one, 0).otherwise(blocks(F.col("top.n"), F.col("top.words"))).alias("most"))
    plan = stage(plan, "mixed")
    open_ = salted_join(rows.select("k0", "tree", "x.*"), plan.drop("size"), ["k0"], plan.select("k0", "size"), "size", ["rep"])
    own = F.when((F.col("c") == F.col("main")) & (F.col("most") > 0), F.col("few") + F.pmod(F.xxhash64("rep"), F.col("most"))).otherwise(
        F.pmod(F.xxhash64("rep"), F.col("few"))).cast("int")
    last = F.when(F.col("own") < F.col("few"), F.col("few") + F.col("most") - 1).otherwise(F.col("few") - 1)
    groups = F.ceil(plan.agg(F.coalesce(F.sum("size"), F.lit(0))).scalar() / (BLOCK * 8)) + 1
    met = open_.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last))).select(
        F.when(F.col("few") + F.col("most") > 1, F.col("k0")).otherwise(F.pmod("k0", groups)).alias("g"),
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "k0", "tree", "own", "rep", "n", "b1", "b2", "c")
    first = keys.select(F.col("doc_id").alias("rep"), F.col("p0").alias("first"))
    return stage(met.join(first, "rep").where(F.col("first")[F.col("tree")] == F.col("k0")), "meetings")  # an id may have several texts


_MEMBER = ["k0", "own", "rep", "n", "b1", "b2", "c", "tree", "first"]


def _candidates(table: pa.Table, i: int, j: int, percent: int):
    """(rows of p, rows of q) of a group's pairs that are to be compared, block of rows by block of rows:
    members of one region and of different components whose sizes and sketches allow the similarity, in the first tree that has both in a region."""
    k0, own, n, c, tree = (table.column(k).to_numpy() for k in ("k0", "own", "n", "c", "tree"))
    n = n.astype(np.int64)
    bits = [table.column(k).to_numpy().view(np.uint64) for k in ("b1", "b2")]
    first = np.asarray(table.column("first").combine_chunks().flatten()).reshape(len(n), -1)
    order = np.argsort(k0, kind="stable")
    ends = np.flatnonzero(np.diff(k0[order], prepend=~k0[order[:1]], append=~k0[order[-1:]]))
    for lo, hi in zip(ends, ends[1:]):
        member = order[lo:hi]
        a, b = (member, member) if i == j else (member[own[member] == i], member[own[member] == j])
        for at in range(0, len(a), 256):
            p, q = a[at:at + 256, None], b[None, :]
            fit = (c[p] != c[q]) & (np.minimum(n[p], n[q]) * 100 >= np.maximum(n[p], n[q]) * percent)
            if i == j:
                fit &= p < q
            r, s = np.nonzero(fit)
            r, s = a[at + r], b[s]
            near = sum(np.bitwise_count(x[r] ^ x[s]).astype(np.int64) for x in bits) <= LOOSE_BITS
            r, s = r[near], s[near]
            for part in range(0, len(r), 1 << 16):
                rp, sp = r[part:part + (1 << 16)], s[part:part + (1 << 16)]
                new = (first[rp] == first[sp]).argmax(axis=1) == tree[rp]
                yield rp[new], sp[new]


def _open_members(percent: int):
    """The members of a group that have anybody to be compared with."""
    def run(key, table):
        table = table.combine_chunks()
        wanted = np.zeros(table.num_rows, bool)
        for r, s in _candidates(table, key[1].as_py(), key[2].as_py(), percent):
            wanted[r] = wanted[s] = True
        return table.filter(pa.array(wanted))

    return run


def _common(sets: list[np.ndarray], r: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets of each pair."""
    if len(r) < 64:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(r.tolist(), s.tolist(), strict=True)], np.int64)
    rows, at = np.unique(np.concatenate([r, s]), return_inverse=True)
    sizes = [len(sets[k]) for k in rows]
    words, col, times = np.unique(np.concatenate([sets[k] for k in rows]), return_inverse=True, return_counts=True)
    row, met = np.repeat(np.arange(len(rows)), sizes), np.flatnonzero(times > 1)
    place = np.full(len(words), -1)
    place[met] = np.arange(len(met))
    keep = place[col] >= 0
    row, col = row[keep], place[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total = np.zeros((len(rows), len(rows)), np.float32)  # counts up to 2 ** 24 are exact in each step
    full = np.zeros(len(r), np.int64)
    a, b = at[:len(r)], at[len(r):]
    for lo in range(0, len(met), 2048):
        x, y = np.searchsorted(col, (lo, lo + 2048))
        has = np.zeros((len(rows), min(2048, len(met) - lo)), np.float32)
        has[row[x:y], col[x:y] - lo] = 1
        np.matmul(has, has.T, out=total)
        full += total[a, b].astype(np.int64)
    return full


def _linked_members(percent: int):
    """A spanning forest (u, v) of the links among a group's pairs, from members with their sets."""
    def run(key, table):
        table = table.combine_chunks()
        rep, ends = table.column("rep").to_numpy(), np.append(0, np.cumsum(np.asarray(table.column("s").combine_chunks().value_lengths())))
        flat = np.asarray(table.column("s").combine_chunks().flatten())
        sets = [flat[x:y] for x, y in zip(ends, ends[1:])]
        size = np.diff(ends)
        found = [(np.empty(0, np.int64),) * 2]
        for r, s in _candidates(table, key[1].as_py(), key[2].as_py(), percent):
            if len(r):
                both = _common(sets, r, s)
                ok = both * 100 >= (size[r] + size[s] - both) * percent
                found.append((r[ok], s[ok]))
        r, s = (np.concatenate(x) for x in zip(*found, strict=True))
        # the same member may be there for several regions: places by id
        ids, at = np.unique(rep, return_inverse=True)
        root = forest(at[r], at[s], len(ids))
        hung = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({"u": ids[hung], "v": ids[root[hung]]})

    return run


def cross_links(rows: DataFrame, keys: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (u, v) that join the components named in x.c: for each meeting a spanning forest of
    all links between its members.  A region of a greater depth lies in one of the smallest depth."""
    met = _meetings(rows, keys)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in met.schema)
    live = stage(met.groupBy("g", "i", "j").applyInArrow(_open_members(percent), kinds), "open")
    drop_stage(met)
    sets = _sets(texts, live.select(F.col("rep").alias("id")).distinct(), words)
    full = live.join(sets.select(F.col("id").alias("rep"), "s"), "rep").select("g", "i", "j", *_MEMBER, "s")
    links = stage(full.groupBy("g", "i", "j").applyInArrow(_linked_members(percent), "u long, v long"), "links")
    drop_stage(live)
    drop_stage(sets)
    return links


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    b = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    ab = b.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    both = F.size(F.array_intersect("sa", "sb"))
    return ab.where(both * 100 >= (F.size("sa") + F.size("sb") - both) * percent).select(
        F.col("a").alias("u"), F.col("b").alias("v"))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, region: int = REGION,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``.

    Two texts are linked when 100 * common shingles >= ``percent`` * united
    ones; the component is the smallest id reachable by links.

    Null or empty texts and texts of white space have no shingles, link with
    nothing and are kept.  A null id links with nothing and is kept.  Repeated
    rows come back as often as they are given; rows of one id are one document
    that links where any of its texts does.  An empty table gives no rows.
    Other columns are not read.
    """
    ready(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    deep = ", ".join(f"{p} array<long>" for p in _KEYS)
    sigs = stage(texts.mapInArrow(_describe(words), f"doc_id long, n long, h1 long, h2 long, b1 long, b2 long, {deep}"), "signatures")
    live = sigs.where("n > 0 and doc_id is not null")
    classes = stage(live.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = live.join(classes.select("h1", "h2", F.col("rep").alias("doc_id")), ["h1", "h2", "doc_id"], "left_semi")
    rows = regions(reps)

    def confirmed(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        sets = _sets(texts, ids, words)
        links = stage(_verified(pairs, sets, percent), "links")
        drop_stage(sets)
        return links

    stars = star_pairs(rows, percent, region)
    links = confirmed(stars)
    drop_stage(stars)
    part = connected_components(links).select(F.col("id").alias("_id"), F.col("component").alias("_c"))
    open_ = stage(rows.join(part, F.col("x.rep") == F.col("_id"), "left").withColumn(
        "x", F.col("x").withField("c", F.coalesce("_c", "x.rep"))).select("k0", "tree", "x"), "named")
    drop_stage(rows)
    across = cross_links(open_, reps.select("doc_id", "p0"), texts, words, percent)
    drop_stage(open_)
    part = connected_components(links.union(across))
    named = classes.join(part.withColumnRenamed("id", "rep"), "rep", "left").select(
        "h1", "h2", F.coalesce("component", "rep").alias("component"))
    one = sigs.join(named, ["h1", "h2"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    out = one.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
