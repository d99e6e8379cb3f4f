"""Embedding near-dedup with a pivot-permutation index.

* Equal vectors of a label are one class, represented by their smallest id, so
  copies are never compared with each other.
* Pivots are reference points: vectors drawn from the classes of each vector
  length, of which a label uses the first, one for ``BLOCK`` of its vectors, at least
  one and at most ``MAX_PIVOTS``.  A vector's home is its nearest pivot.
* A vector's prefix is chosen by distance: its home and each later pivot that can be
  the home of a vector close enough to link.  If y is nearer to its home p than to
  the home q of x, y lies on p's side of the plane between them, so x does or is
  nearer to the plane than x is to y; and by the triangle inequality the angle of x
  to p is in the range of those of p's vectors, widened by the angle of a link.
* An inverted list for each label and pivot holds the vectors at home there and the
  visitors that have the pivot in their prefix.  Both are cut into blocks of about
  ``BLOCK`` vectors, and each pair of home blocks and of a home and a visitors'
  block is a group of its own, so that no task holds a whole list.
* In a pair of blocks all pairs are compared by one matrix product and verified
  by their cosine in double precision.  A pair meets in the list of its later home only.

Links are counted, weighted by the sizes of the classes; what leaves a task of
the links themselves is a spanning forest.

The bounds leave out only pairs that can't be linked, so all links are found,
whatever the size and density of the table.  Where the bounds can't tell vectors
apart, as with directions spread evenly over many dimensions, all blocks of a label meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.llm.common import ready, stage
from veracity.llm.components import connected_components

COSINE = 0.93
MAX_PIVOTS = 4096
BLOCK = 512
_SLACK = 1e-6  # of the bounds, for rounding


def _unit(flat: np.ndarray, n: int) -> np.ndarray:
    x = flat.reshape(n, -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square over- or underflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def prefixes(x: np.ndarray, pivots: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, p, angle): the length of each unit vector's prefix, and its pivots with the angles to them, the home first."""
    near = x @ pivots.T
    home = near.argmax(axis=1)
    gap = np.sqrt(np.maximum(2 - 2 * (pivots[home] @ pivots.T), 0))  # of each pivot to the home
    reach = np.sqrt(max(2 - 2 * cosine, 0.0)) + _SLACK
    beyond = near[np.arange(len(x)), home][:, None] - near > reach * gap + _SLACK
    visit = ~beyond & (np.arange(len(pivots)) > home[:, None])
    row, p = np.nonzero(visit)
    n = visit.sum(axis=1) + 1
    at = np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.int64)
    rest = np.ones(len(out), bool)
    rest[at] = False
    out[at], out[rest] = home, p
    return n, out.astype(np.int32), np.arccos(np.clip(near[np.repeat(np.arange(len(x)), n), out], -1, 1))


def linked(x: np.ndarray, y: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the pairs of x and y that are verified."""
    i, j = np.nonzero(x @ y.T >= cosine - _SLACK)
    keep = np.concatenate([np.einsum("ij,ij->i", x[i[at:at + 4096]], y[j[at:at + 4096]]) >= cosine
                           for at in range(0, len(i), 4096)] or [np.empty(0, bool)])
    return i[keep], j[keep]


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest position of each position's component."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        was = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (root == was).all():
            break
    while (root[root] != root).any():
        root = root[root]
    return root


def usable(vector, label):
    """The label is known and the vector has a direction: no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return label.isNotNull() & vector.isNotNull() & F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors``.

    Two vectors are linked if their labels are equal and their cosine is at
    least ``cosine``; vectors of other lengths are never linked.  Vectors that are
    null, zero or hold null or non-finite components, null labels and null ids
    link with nothing and are kept.  Rows of one id count as one vector each
    for the links of others; the ids' rows get the largest count and one component.
    An empty table gives no rows.  Other columns are not read.
    """
    spark = vectors.sparkSession
    ready(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    good = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v"), F.col("label")))
    classes = stage(good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"))
                    .withColumn("dim", F.size("v")), "classes")
    count = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    cells = stage(count.select("label", "dim", F.least(F.ceil(F.col("n") / BLOCK), F.lit(MAX_PIVOTS)).cast("int").alias("cells")), "cells")
    pivots = {}
    for d, wanted in cells.groupBy("dim").agg(F.max("cells")).collect():  # a row for each length, at most MAX_PIVOTS vectors
        drawn = classes.where(F.col("dim") == d).orderBy(F.xxhash64("rep", F.lit("pivot")), "rep", "label").limit(wanted).select("v").collect()
        pivots[d] = _unit(np.array([r["v"] for r in drawn], float).ravel(), len(drawn))
    shared = spark.sparkContext.broadcast(pivots)

    def describe(batches):
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            kind = np.stack([batch.column(3).to_numpy(), batch.column(5).to_numpy()], axis=1)
            for d, m in np.unique(kind, axis=0):
                part = batch.filter(pa.array((kind == (d, m)).all(axis=1)))
                x = part.column(2).flatten().to_numpy()
                n, p, angle = prefixes(_unit(x, part.num_rows), shared.value[int(d)][:m], cosine)
                ends = pa.array(np.append(0, np.cumsum(n)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(k)) for k in (p, angle)]
                yield pa.RecordBatch.from_arrays([*part.columns[:5], *lists], names=["label", "rep", "v", "dim", "size", "p", "angle"])

    kind = classes.schema["label"].dataType.simpleString()
    described = stage(classes.join(cells, ["label", "dim"]).select("label", "rep", "v", "dim", "size", "cells").mapInArrow(
        describe, f"label {kind}, rep long, v array<double>, dim int, size long, p array<int>, angle array<double>"), "described")
    # entries of the inverted lists carry no vector until lists and blocks are known
    entries = described.select("label", "dim", "rep", "angle", F.posexplode("p").alias("at", "pivot")).select(
        "label", "dim", "rep", "pivot", (F.col("at") == 0).alias("home"), F.col("angle")[F.col("at")].alias("angle"))
    lists = ["label", "dim", "pivot"]
    homes = entries.where("home").groupBy(*lists).agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    turn = float(np.arccos(np.clip(cosine, -1, 1))) + _SLACK
    met = stage(entries.join(homes, lists).where(F.col("home") | F.col("angle").between(F.col("low") - turn, F.col("high") + turn))
                .select(*lists, "rep", "home", "n"), "entries")
    visitors = met.groupBy(*lists).agg(F.count_if(~F.col("home")).alias("more")).select(*lists, F.ceil(F.col("more") / BLOCK).cast("int").alias("more"))
    cut = met.join(visitors, lists).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.when(
        F.col("home"), F.pmod(F.xxhash64("rep"), "blocks")).otherwise(F.col("blocks") + F.pmod(F.xxhash64("rep"), "more")).cast("int"))
    # blocks of visitors follow those at home; they don't meet each other
    last = F.col("blocks") - 1 + F.when(F.col("home"), F.col("more")).otherwise(0)
    pairs = cut.where("n + more > 1").withColumn("other", F.explode(F.sequence(F.lit(0), last))).select(
        "label", "dim", "rep", "pivot", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    full = pairs.join(described.select("label", "dim", "rep", "v", "size"), ["label", "dim", "rep"])

    def compare(key, table):
        i, j = key[3].as_py(), key[4].as_py()
        own = table.column("own").to_numpy()
        table = table.select(["rep", "size", "v"]).combine_chunks()
        v = np.asarray(table.column("v").combine_chunks().flatten())
        x, rep, size = _unit(v, table.num_rows), table.column("rep").to_numpy(), table.column("size").to_numpy()
        a = np.flatnonzero(own == i)
        b = np.flatnonzero(own == j)
        r, c = linked(x[a], x[b], cosine) if len(a) and len(b) else (np.empty(0, int),) * 2
        r, c = a[r], b[c]
        if i == j:
            r, c = r[r < c], c[r < c]
        n = np.bincount(r, size[c], len(rep)) + np.bincount(c, size[r], len(rep))
        root = _forest(r, c, len(rep))
        some = np.flatnonzero(n)
        return pa.table({"u": rep[some], "v": rep[root[some]], "n": n[some].astype(np.int64)})

    links = stage(full.groupBy("label", "dim", "pivot", "i", "j").applyInArrow(compare, "u long, v long, n long"), "links")
    part = connected_components(links.select("u", "v"))
    counts = links.groupBy("u").agg(F.sum("n").alias("n"))
    known = classes.join(counts.withColumnRenamed("u", "rep"), "rep", "left").join(
        part.withColumnRenamed("id", "rep"), "rep", "left").select(
        "label", "v", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    found = good.join(known, ["label", "v"]).groupBy("vec_id").agg(F.max("n").alias("n"), F.min("component").alias("component"))
    out = rows.select("vec_id").join(found, "vec_id", "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
