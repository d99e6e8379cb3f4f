"""Exact top-k search by inner product: branch and bound over columns.

Components are turned into whole numbers floor(scale * x).  Queries and
candidates are dealt into blocks, and every pair of a query block and a
candidate block is a group of its own.  In a group the candidates lie
in vertical layout, a row for each dimension.  Scores are accumulated
``DIMS`` dimensions at a time.  After each step a candidate's score can rise by no
more than the product of the lengths of the query's and its own remaining parts
(the remaining mass); candidates that can't reach the query's k-th best score
known are dropped and the survivors are compacted for the next step.  The k-th best
score comes from the best ``SEEDS`` candidates after the first step, scored in full.
Only exact whole-number scores are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veracity.llm.common import ready, stage

K = 5
SCALE = 256
EVERY = 50
DIMS = 16
SEEDS = 16
QUERY_BLOCK = 256
CANDIDATE_BLOCK = 4096
_EXACT = 1 << 53
_LONG = (1 << 63) - 1


def quantise(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles: float64 if every product and sum of a score stays exact in it, else Python's whole numbers."""
    with np.errstate(over="ignore"):
        q = np.floor(scale * x)
    if not q.size or np.isfinite(q).all() and (m := float(np.abs(q).max())) * m * q.shape[-1] < _EXACT:
        return q
    return np.array([[(int(v) * scale if float(v).is_integer() else int(np.floor(scale * v))) for v in row] for row in x], object)


def best(query: np.ndarray, columns: np.ndarray, rest: np.ndarray, own: np.ndarray, ids: np.ndarray, skip: int, k: int) -> list[tuple[int, int]]:
    """(score, id) of the k best candidates, ties to the smaller id.

    columns: dimensions x candidates; rest: length of each candidate's part from every
    step on (steps x candidates); own: the same of the query.
    """
    alive = np.flatnonzero(ids != skip)
    dims = len(query)
    if not len(alive):
        return []
    score, tau = np.zeros(len(alive)), -np.inf
    for step, at in enumerate(range(0, dims, DIMS)):
        score = score + query[at:at + DIMS] @ columns[at:at + DIMS][:, alive]
        if at + DIMS >= dims or len(alive) <= k:
            continue
        if step == 0:
            seeds = np.argpartition(-score, min(SEEDS, len(score)) - 1)[:SEEDS]
            known = query @ columns[:, alive[seeds]]
            if len(known) >= k:
                tau = np.partition(known, len(known) - k)[len(known) - k]
        # sums of squares are rounded: a little room keeps the bound safe
        stay = np.flatnonzero(score + own[step + 1] * rest[step + 1, alive] * (1 + 1e-9) + 1e-6 >= tau)
        alive, score = alive[stay], score[stay]
    top = np.lexsort((ids[alive], -score))[:k]
    return [(int(score[i]), int(ids[alive[i]])) for i in top]


def _remaining(q: np.ndarray) -> np.ndarray:
    """Length of every row's part from each step on (steps + 1 x rows)."""
    squares = (q * q)[:, ::-1].cumsum(axis=1)[:, ::-1]
    parts = [squares[:, at] for at in range(0, q.shape[1], DIMS)]
    return np.sqrt(np.stack([*parts, np.zeros(len(q))]))


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible by
    ``every`` the k rows of other ids with the highest whole-number inner product.

    Ties go to the smaller id; fewer rows than k give fewer results.  Vectors
    and ids that are null and vectors with null or non-finite components take no part,
    empty vectors neither.  Vectors are compared with those of their own length only.
    Rows given twice with the same id and vector count once; a score beyond the
    range of a long is set to its end.  Other columns are not read.
    """
    spark = vectors.sparkSession
    ready(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = stage(rows.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size("v") > 0)).distinct()
                 .withColumn("dim", F.size("v")), "vectors")
    total = rows.count()
    q_blocks = max(1, -(-total // (every * QUERY_BLOCK)))
    c_blocks = max(1, -(-total // CANDIDATE_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(n)).cast("int")
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = rows.where(F.col("vec_id") % every == 0).select(
        F.lit(True).alias("is_query"), "vec_id", "v", "dim", block(q_blocks).alias("qb"), every_block(c_blocks).alias("cb"))
    candidates = rows.select(F.lit(False).alias("is_query"), "vec_id", "v", "dim", every_block(q_blocks).alias("qb"), block(c_blocks).alias("cb"))

    def search(table):
        table = table.combine_chunks()
        ids, query = table.column("vec_id").to_numpy(), np.asarray(table.column("is_query"))
        x = np.asarray(table.column("v").combine_chunks().flatten()).reshape(table.num_rows, -1)
        z = quantise(x, scale)
        q, c, own = z[query], z[~query], ids[~query]
        out = []
        if z.dtype == object:
            for i, row in zip(ids[query], q, strict=True):
                found = sorted(((-sum(a * b for a, b in zip(row, other, strict=True)), int(j)) for j, other in zip(own, c, strict=True) if j != i))[:k]
                out += [(int(i), j, max(-_LONG - 1, min(_LONG, -s))) for s, j in found]
        elif len(c):
            columns, rest, mass = np.ascontiguousarray(c.T), _remaining(c), _remaining(q)
            for n, i in enumerate(ids[query]):
                out += [(int(i), j, s) for s, j in best(q[n], columns, rest, mass[:, n], own, i, k)]
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({n: pa.array(col, pa.int64()) for n, col in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    found = queries.union(candidates).groupBy("dim", "qb", "cb").applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
