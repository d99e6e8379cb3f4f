"""Nearest-title joins (J1 exact, J2 IVF) without all-pairs rows.

Both are built on ``block_topk``: queries and targets are hash-split into
bounded blocks inside each group (IVF cell, or one group for exact search);
each (group, query block, target block) is a cogroup handled by numpy, which
emits only the k best targets per query.  A ``row_number() <= k`` window then
merges the per-block winners (Spark plans a map-side WindowGroupLimit for it).

Scale notes
* No cross join: block ids are exploded with ``sequence`` and equi-joined.
* A hot cell (say a third of all vectors) is cut into ``ceil(n / target_block)``
  blocks, so no task holds more than one block of each side.
* Cells are counted in Spark and joined as a table; nothing is forced to broadcast.
* Exact search without cells meets every query block with every target block.
  With cells, ``bounded_knn_join`` leaves out the shells of cells that the triangle
  inequality keeps out of a query's reach.  Scoring runs use the IVF join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veracity.operators.skew import salted_join
from veracity.session import Store

# Default block sizes: a target block of 16k x 768 floats is ~50 MB in a task.
QUERY_BLOCK = 2048
TARGET_BLOCK = 16384
SLACK = 1e-9       # of the bounds, for rounding
_CELLS = 4 << 20   # distances held at once
_VALUES = 4 << 20  # vector components gathered at once


def first_of_equal(vectors: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the rows that can be among anybody's k nearest: of equal
    vectors only the k smallest ids."""
    order = np.argsort(ids, kind="stable")
    seen: dict[bytes, int] = {}
    keep = []
    for i in order:
        key = vectors[i].tobytes()
        n = seen.get(key, 0)
        if n < k:
            seen[key] = n + 1
            keep.append(i)
    return np.sort(np.array(keep, np.int64))


def nearest(q: np.ndarray, t: np.ndarray, tids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, target ids, squared distances) of the k nearest targets of
    each query, ties to the smaller id.  Memory is bounded by ``_CELLS`` and ``_VALUES``."""
    own = first_of_equal(t + 0.0, tids, k)
    t, tids = t[own], tids[own]
    t2 = np.einsum("ij,ij->i", t, t)
    kk = min(k, len(t))
    step = max(1, _CELLS // len(t))
    out = []
    for s in range(0, len(q), step):
        part = q[s:s + step]
        q2 = np.einsum("ij,ij->i", part, part)
        approx = q2[:, None] - 2.0 * (part @ t.T) + t2[None, :]
        kth = np.partition(approx, kk - 1, axis=1)[:, kk - 1]
        tol = 1e-9 * (q2 + t2.max() + 1.0)
        # every target within tolerance of the k-th approximate distance is
        # measured exactly, so ties and rounding never drop a true neighbour
        rows, cols = np.nonzero(approx <= (kth + tol)[:, None])
        exact = np.empty(len(rows))
        gather = max(1, _VALUES // t.shape[1])
        for at in range(0, len(rows), gather):
            r, c = rows[at:at + gather], cols[at:at + gather]
            exact[at:at + gather] = np.square(part[r] - t[c]).sum(axis=1)
        order = np.lexsort((tids[cols], exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < kk
        out.append((s + rows[keep], tids[cols[keep]], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest_in_shells(q: np.ndarray, first: np.ndarray, last: np.ndarray, t: np.ndarray, tids: np.ndarray, shell: np.ndarray,
                      k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``nearest`` of targets in shells, where each query looks into the shells from ``first`` to ``last`` only."""
    rows, ids, d2 = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    for s in np.unique(shell):
        asks, own = np.nonzero((first <= s) & (s <= last))[0], shell == s
        if not len(asks):
            continue
        r, i, d = nearest(q[asks], t[own], tids[own], k)
        rows, ids, d2 = np.concatenate([rows, asks[r]]), np.concatenate([ids, i]), np.concatenate([d2, d])
        order = np.lexsort((ids, d2, rows))
        rows, ids, d2 = rows[order], ids[order], d2[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
        rows, ids, d2 = rows[keep], ids[keep], d2[keep]
    return rows, ids, d2


def _block_fn(k: int, qid: str, tid: str, q_vec: str, t_vec: str, shelled: bool = False):
    def fn(qpdf: pd.DataFrame, tpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(tpdf) == 0:
            return pd.DataFrame(columns=[qid, tid, "d2"])
        q = np.stack(qpdf[q_vec].to_numpy()).astype(np.float64)
        t = np.stack(tpdf[t_vec].to_numpy()).astype(np.float64)
        tids = tpdf[tid].to_numpy().astype(np.int64)
        if shelled:
            rows, ids, d2 = nearest_in_shells(q, qpdf["_first"].to_numpy(), qpdf["_last"].to_numpy(), t, tids, tpdf["_shell"].to_numpy(), k)
        else:
            rows, ids, d2 = nearest(q, t, tids, k)
        return pd.DataFrame({qid: qpdf[qid].to_numpy()[rows], tid: ids, "d2": d2})
    return fn


def block_topk(queries: DataFrame, targets: DataFrame, k: int, *, qid: str, tid: str,
               group: str | None = None, q_vec: str = "embedding", t_vec: str = "embedding",
               query_block: int = QUERY_BLOCK, target_block: int = TARGET_BLOCK, shelled: bool = False) -> DataFrame:
    """For each query, the ``k`` targets of its group nearest by squared L2.

    With ``shelled`` targets have a ``_shell``, and a query looks only into those from its ``_first``
    to its ``_last``.  Ties are broken by the smaller target id.  Returns ``(qid, tid, rk, d2)``;
    fewer than ``k`` rows when the group holds fewer targets.
    """
    g = group or "_grp"
    q_more, t_more = (["_first", "_last"], ["_shell"]) if shelled else ([], [])
    if group is None:
        queries = queries.withColumn(g, F.lit(0))
        targets = targets.withColumn(g, F.lit(0))
    queries = queries.select(qid, g, q_vec, *q_more).where(F.col(q_vec).isNotNull())
    targets = targets.select(F.col(tid).cast("long").alias(tid), g,
                             F.col(t_vec).alias("_tvec"), *t_more).where(F.col("_tvec").isNotNull())
    if group is None:
        # one group: block counts are two scalar subqueries, no join at all
        nq = queries.select(F.count(F.lit(1))).scalar()
        nt = targets.select(F.count(F.lit(1))).scalar()
        blocks = lambda df: df.withColumn("_nqb", F.ceil(nq / query_block).cast("int")) \
            .withColumn("_ntb", F.ceil(nt / target_block).cast("int"))
        qb, tb = blocks(queries), blocks(targets)
    else:
        stats = (queries.groupBy(g).agg(F.count(F.lit(1)).alias("_nq"))
                 .join(targets.groupBy(g).agg(F.count(F.lit(1)).alias("_nt")), g)
                 .select(g, F.ceil(F.col("_nq") / query_block).cast("int").alias("_nqb"),
                         F.ceil(F.col("_nt") / target_block).cast("int").alias("_ntb")))
        qb, tb = queries.join(stats, g), targets.join(stats, g)
    q = (qb.withColumn("_qb", F.pmod(F.xxhash64(qid), F.col("_nqb")).cast("int"))
         .withColumn("_tb", F.explode(F.sequence(F.lit(0), F.col("_ntb") - 1)))
         .select(g, "_qb", "_tb", qid, q_vec, *q_more))
    t = (tb.withColumn("_tb", F.pmod(F.xxhash64(tid), F.col("_ntb")).cast("int"))
         .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_nqb") - 1)))
         .select(g, "_qb", "_tb", tid, "_tvec", *t_more))
    qtype = queries.schema[qid].dataType.simpleString()
    schema = f"{qid} {qtype}, {tid} bigint, d2 double"
    pairs = (q.groupBy(g, "_qb", "_tb")
             .cogroup(t.groupBy(g, "_qb", "_tb"))
             .applyInPandas(_block_fn(k, qid, tid, q_vec, "_tvec", shelled), schema))
    w = Window.partitionBy(qid).orderBy(F.col("d2"), F.col(tid))
    return (pairs.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)
            .select(qid, tid, "rk", "d2"))


def knn_join(queries: DataFrame, vectors: DataFrame, k: int = 2, *, qid: str = "entity",
             vec_col: str = "embedding", **blocks) -> DataFrame:
    """Exact k nearest titles per query -> (qid, title_id, rk, d2)."""
    return block_topk(queries, vectors, k, qid=qid, tid="title_id", q_vec=vec_col,
                      t_vec=vec_col, **blocks)


def _distance(a: str, b: str):
    """Euclidean distance of two array columns."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
                              F.lit(0.0), lambda s, v: s + v))


def shells(vectors: DataFrame, centroids: DataFrame, target_block: int = TARGET_BLOCK, vec_col: str = "embedding") -> DataFrame:
    """Vectors (title_id, cell, embedding) with their distance to their cell's centroid and the
    shell of the cell that they lie in -> (cell, shell, title_id, far, _tvec).

    A cell has as many shells, of equal widths, as its rows fill blocks."""
    cells = vectors.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"))
    own = vectors.select(F.col("cell").cast("int").alias("cell"), F.col("title_id").cast("long").alias("title_id"), F.col(vec_col).alias("_tvec")).where(
        F.col("_tvec").isNotNull())
    cents = centroids.select(F.col("cell").cast("int").alias("cell"), "centroid").join(cells, "cell").withColumn("_blocks", F.ceil(F.col("_n") / target_block))
    far = salted_join(own, cents.drop("_n"), ["cell"], cells.select(F.col("cell").cast("int").alias("cell"), "_n"), "_n", ["title_id"]).select(
        "cell", "title_id", _distance("_tvec", "centroid").alias("far"), "_tvec", "_blocks")
    radius = far.groupBy("cell").agg(F.max("far").alias("_radius"))
    shell = F.least(F.floor(F.col("far") / F.greatest("_radius", F.lit(1e-300)) * F.col("_blocks")), F.col("_blocks") - 1)
    sized = salted_join(far, radius, ["cell"], cells.select(F.col("cell").cast("int").alias("cell"), "_n"), "_n", ["title_id"])
    return sized.select("cell", shell.cast("int").alias("shell"), "title_id", "far", "_tvec")


def _reach_fn(qid: str, q_vec: str):
    """The cells that may hold a vector within a query's reach, with the distance to their centroid."""
    def fn(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(cpdf) == 0:
            return pd.DataFrame(columns=[qid, "cell", "_to", "_reach"])
        q = np.stack(qpdf[q_vec].to_numpy()).astype(np.float64)
        c = np.stack(cpdf["centroid"].to_numpy()).astype(np.float64)
        reach, radius = qpdf["_reach"].to_numpy()[:, None], cpdf["_radius"].to_numpy()[None, :]
        out = []
        step = max(1, _VALUES // (len(c) * c.shape[1]))
        for at in range(0, len(q), step):
            to = np.sqrt(np.square(q[at:at + step, None, :] - c[None, :, :]).sum(axis=2))
            i, j = np.nonzero(to - radius <= reach[at:at + step] * (1 + SLACK) + SLACK)
            out.append((i + at, j, to[i, j]))
        i, j, to = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({qid: qpdf[qid].to_numpy()[i], "cell": cpdf["cell"].to_numpy()[j], "_to": to, "_reach": qpdf["_reach"].to_numpy()[i]})
    return fn


def shells_in_reach(queries: DataFrame, reach: DataFrame, centroids: DataFrame, bounds: DataFrame, *, qid: str = "entity",
                    vec_col: str = "embedding", query_block: int = QUERY_BLOCK, cell_block: int = 1024, run: int = 1) -> DataFrame:
    """(qid, cell, run, _first, _last): the shells that may hold a vector within ``reach`` (qid, _reach) of a query, the first
    and the last of each run of ``run`` shells of a cell.  Shells follow each other in their distances, so all between are in reach too.

    By the triangle inequality a vector at distance f from its centroid is at least |f - d| from a query at
    distance d.  ``bounds`` is (cell, shell, lo, hi), the distances in each shell."""
    radius = bounds.groupBy("cell").agg(F.max("hi").alias("_radius"))
    cells = centroids.select(F.col("cell").cast("int").alias("cell"), "centroid").join(radius, "cell")
    nq, nc = (df.select(F.count(F.lit(1))).scalar() for df in (queries, cells))
    qb, cb = F.ceil(nq / query_block).cast("int"), F.ceil(nc / cell_block).cast("int")
    q = queries.select(qid, vec_col).join(reach, qid).withColumn("_qb", F.pmod(F.xxhash64(qid), qb).cast("int")).withColumn(
        "_cb", F.explode(F.sequence(F.lit(0), cb - 1)))
    c = cells.withColumn("_cb", F.pmod(F.xxhash64("cell"), cb).cast("int")).withColumn("_qb", F.explode(F.sequence(F.lit(0), qb - 1)))
    kind = queries.schema[qid].dataType.simpleString()
    near = q.groupBy("_qb", "_cb").cogroup(c.groupBy("_qb", "_cb")).applyInPandas(_reach_fn(qid, vec_col), f"{qid} {kind}, cell int, _to double, _reach double")
    wide = F.col("_reach") * (1 + SLACK) + SLACK
    met = near.join(bounds, "cell").where((F.col("lo") - wide <= F.col("_to")) & (F.col("_to") <= F.col("hi") + wide))
    return met.groupBy(qid, "cell", F.floor(F.col("shell") / run).alias("run")).agg(F.min("shell").alias("_first"), F.max("shell").alias("_last"))


def bounded_knn_join(queries: DataFrame, vectors: DataFrame, centroids: DataFrame, k: int = 2, *, qid: str = "entity", vec_col: str = "embedding",
                     store: Store | None = None, query_block: int = QUERY_BLOCK, target_block: int = TARGET_BLOCK) -> DataFrame:
    """J1 by bounds: the exact k nearest titles of each query -> (qid, title_id, rk, d2), from vectors in cells.

    The cell of the nearest centroid gives each query k distances; the largest is its reach, and only
    shells that may hold something within it are searched.  A query whose nearest cell has
    fewer than k vectors reaches everywhere.  The shells of the vectors and what each query reaches are written once to ``store``.
    """
    store = store or Store(queries.sparkSession)
    asked = queries.select(qid, vec_col).where(F.col(vec_col).isNotNull())
    probes = probe_cells(asked, centroids, 1, qid=qid, vec_col=vec_col)
    first = search_cells(asked, vectors, probes.select(qid, "cell"), k, qid=qid, vec_col=vec_col, query_block=query_block, target_block=target_block)
    found = first.groupBy(qid).agg(F.count(F.lit(1)).alias("_k"), F.sqrt(F.max("d2")).alias("_d"))
    reach = asked.select(qid).join(found, qid, "left").select(qid, F.when(F.col("_k") == k, F.col("_d")).otherwise(F.lit(float("inf"))).alias("_reach"))
    held = store.keep("shells", shells(vectors, centroids, target_block, vec_col))
    bounds = held.groupBy("cell", "shell").agg(F.min("far").alias("lo"), F.max("far").alias("hi"))
    # small shells meet a query together, so its vector goes to a run of them once and the best of the run come back
    run = max(1, TARGET_BLOCK // target_block)
    met = store.keep("shells_in_reach", shells_in_reach(asked, reach, centroids, bounds, qid=qid, vec_col=vec_col, query_block=query_block, run=run))
    group = F.concat_ws(":", "cell", "run")
    wanted = met.select(qid, group.alias("_group"), "_first", "_last").join(asked, qid)
    targets = held.withColumn("run", F.floor(F.col("shell") / run)).select(
        group.alias("_group"), "title_id", F.col("shell").alias("_shell"), F.col("_tvec").alias(vec_col)).join(wanted.select("_group").distinct(), "_group", "left_semi")
    return block_topk(wanted, targets, k, qid=qid, tid="title_id", group="_group", q_vec=vec_col, t_vec=vec_col,
                      query_block=query_block, target_block=run * target_block, shelled=True)


def probe_cells(queries: DataFrame, centroids: DataFrame, nprobe: int, *, qid: str = "entity",
                vec_col: str = "embedding") -> DataFrame:
    """The ``nprobe`` cells whose centroids are nearest each query -> (qid, cell, rk, d2)."""
    cents = centroids.select(F.col("cell").cast("long").alias("cell"),
                             F.col("centroid").alias("_cvec"))
    return block_topk(queries, cents, nprobe, qid=qid, tid="cell", q_vec=vec_col, t_vec="_cvec")


def search_cells(queries: DataFrame, vectors: DataFrame, probes: DataFrame, k: int = 2, *, qid: str = "entity",
                 vec_col: str = "embedding", **blocks) -> DataFrame:
    """The k nearest titles in the cells that ``probes`` (qid, cell) names -> (qid, title_id, rk, d2)."""
    probed = (queries.select(qid, vec_col)
              .join(probes.select(qid, F.col("cell").cast("int").alias("cell")), qid))
    # only probed cells are read: on an index partitioned by cell this semi-join
    # lets Spark prune whole cell directories (dynamic partition pruning)
    wanted = probes.select(F.col("cell").cast("int").alias("cell")).distinct()
    vecs = (vectors.join(wanted, "cell", "left_semi")
            .select("title_id", F.col("cell").cast("int").alias("cell"), vec_col))
    return block_topk(probed, vecs, k, qid=qid, tid="title_id", group="cell",
                      q_vec=vec_col, t_vec=vec_col, **blocks)


def ivf_knn_join(queries: DataFrame, vectors: DataFrame, centroids: DataFrame, k: int = 2,
                 nprobe: int = 8, *, qid: str = "entity", vec_col: str = "embedding",
                 **blocks) -> DataFrame:
    """Probe the ``nprobe`` nearest cells, then rank the titles in them.

    With ``nprobe`` >= number of cells the result equals ``knn_join``.  A run
    that keeps stage tables writes the probes once and calls ``search_cells``.
    """
    probes = probe_cells(queries, centroids, nprobe, qid=qid, vec_col=vec_col)
    return search_cells(queries, vectors, probes, k, qid=qid, vec_col=vec_col, **blocks)
