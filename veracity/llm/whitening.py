"""Whitening of embeddings by the covariance of their distinct vectors.

Entries are made integers, ``floor(scale * c)``, and equal integer vectors are
one row with a count.  The fit runs over these distinct vectors, each weighted
with one or with its count: exact integer sums first, then a weighted, centred
matrix product per task, whose d x d results are added up in two steps.  The
eigenvectors of the covariance come from LAPACK on the driver, where only d x d
numbers arrive, d being the length of a vector.  Every distinct vector is
projected once and joined back to the rows that have it; a vector with very many rows is dealt over salts.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.llm.common import drop_stage, ready, stage
from veracity.operators.skew import salted_join

SCALE = 256
COMPONENTS = 4
#: Values in one block of a partial matrix, and partial matrices added by one task of the first step.
_BLOCK = 1 << 15
_SPLIT = 256
_BIG = float(1 << 62)
#: An eigenvalue of at most this part of the trace is none: rounding alone gives that much.
_FLAT = 1e-13


def _by_length(batch: pa.RecordBatch, at: int, kind) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of each vector length in the list column ``at``."""
    lists = batch.column(at)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    ends = np.cumsum(np.asarray(lists.value_lengths()))
    n = np.diff(ends, prepend=0)
    for d in np.unique(n):
        rows = np.flatnonzero(n == d)
        yield rows, flat[(ends[rows] - d)[:, None] + np.arange(d)]


def _weighted_sum(x: np.ndarray, w: np.ndarray) -> list[int]:
    """Exact sum of the rows of integers, each times its weight."""
    if float(np.abs(x).max()) * float(w.sum()) < _BIG:
        return (w @ x).tolist()
    return (x.astype(object) * w.astype(object)[:, None]).sum(axis=0).tolist()


def _sums(distinct: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Weight and exact sums by vector length of (x, w)."""
    def run(batches):
        kept: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            w = batch.column(1).to_numpy()
            for rows, x in _by_length(batch, 0, np.int64):
                n, s = kept.get(x.shape[1], (0, [0] * x.shape[1]))
                kept[x.shape[1]] = n + int(w[rows].sum()), [a + b for a, b in zip(s, _weighted_sum(x, w[rows]), strict=True)]
        for d, (n, s) in kept.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d], pa.int32()), pa.array([Decimal(n)], pa.decimal128(38, 0)), pa.array([[Decimal(v) for v in s]], pa.list_(pa.decimal128(38, 0)))],
                names=["d", "n", "s"])

    parts = distinct.select("x", "w").mapInArrow(run, "d int, n decimal(38,0), s array<decimal(38,0)>")
    total = parts.select("d", "n", F.posexplode("s").alias("i", "v")).groupBy("d", "i").agg(
        F.sum("n").cast("decimal(38,0)").alias("n"), F.sum("v").cast("decimal(38,0)").alias("v"))
    out: dict[int, tuple[int, list[int]]] = {}
    for d, i, n, v in sorted(total.collect()):  # a number for each dimension
        out.setdefault(d, (int(n), []))[1].append(int(v))
    return out


def _added(parts: DataFrame, *keys: str) -> DataFrame:
    def add(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("part").to_numpy(), kind="stable")
        g = table.column("g").to_pylist()
        total = np.sum([np.frombuffer(g[i]) for i in order], axis=0)
        return pa.table({"d": table.column("d")[:1], "block": table.column("block")[:1], "part": table.column("part")[:1], "g": [total.tobytes()]})

    return parts.groupBy(*keys).applyInArrow(add, "d int, block int, part int, g binary")


def _covariances(vectors: DataFrame, means: dict[int, np.ndarray], weight: dict[int, int]) -> dict[int, np.ndarray]:
    """Covariance by vector length of (x, w) around the means, divisor ``weight``."""
    shared = vectors.sparkSession.sparkContext.broadcast(means)

    def run(batches):
        from pyspark import TaskContext

        part, kept = TaskContext.get().partitionId(), {}
        for batch in batches:
            w = batch.column(1).to_numpy()
            for rows, x in _by_length(batch, 0, np.float64):
                c = x - shared.value[x.shape[1]]
                g = c.T @ (c * w[rows, None])
                kept[x.shape[1]] = kept[x.shape[1]] + g if x.shape[1] in kept else g
        for d, g in kept.items():
            step = max(1, _BLOCK // d)
            for b in range(0, d, step):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d], pa.int32()), pa.array([b], pa.int32()), pa.array([part], pa.int32()), pa.array([g[b:b + step].tobytes()], pa.binary())],
                    names=["d", "block", "part", "g"])

    parts = vectors.select("x", "w").mapInArrow(run, "d int, block int, part int, g binary").withColumn("split", F.pmod("part", F.lit(_SPLIT)))
    rows = _added(_added(parts, "d", "block", "split"), "d", "block").select("d", "block", "g").collect()  # d x d numbers
    out = {}
    for d in means:
        blocks = [np.frombuffer(g) for _, _, g in sorted((r for r in rows if r[0] == d), key=lambda r: r[1])]
        full = np.concatenate(blocks).reshape(d, d) / weight[d]
        out[d] = (full + full.T) / 2
    return out


def _components(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues, unit eigenvectors (columns) and shares of the trace of the
    ``k`` largest; each vector's largest entry is positive."""
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
    trace = float(np.trace(cov))
    return e, u, e / trace if trace > 0 else np.full(len(e), np.nan)


def _deviations(x: np.ndarray, n: int, s: list[int]) -> list[Decimal | None]:
    """Exact sums over the dimensions of (n * x - s) ** 2; None beyond 38 digits."""
    if (float(np.abs(x).max()) * n + max(map(abs, s))) ** 2 * x.shape[1] < _BIG:
        return [Decimal(v) for v in np.square(x * n - np.array(s, np.int64)).sum(axis=1).tolist()]
    exact = ((x.astype(object) * n - np.array(s, object)) ** 2).sum(axis=1).tolist()
    return [Decimal(v) if v < 10**38 else None for v in exact]


def _valid(e):
    """Entries that can be made a long; null, NaN and infinite ones can't."""
    return e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= F.lit(_BIG / SCALE)))


def whiten(vectors: DataFrame, components: int = COMPONENTS, weights: str = "one", scale: int = SCALE,
           id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, d, n, deviation decimal(38,0), whitened array<double>, explained
    array<double>, identity_error) for each row with a usable vector.

    ``weights``: each distinct vector counts once ("one") or as often as it
    occurs ("count"); n is the total weight.  ``whitened`` holds the first ``components`` (at most d)
    of the centred vector on the eigenvectors, over the root of the eigenvalue; ``identity_error``
    is the largest absolute entry of its covariance minus the identity.

    Rows whose vector is null or empty, or holds null, NaN, infinite or out of range entries
    (``scale`` times them has no long) have no result.  Repeated rows and null ids come back as they are given;
    equal vectors get equal results.  Vectors of different lengths are different spaces, each with a fit
    of its own.  A component without variance (one distinct vector, say) is null, and the identity
    is measured on the others; a deviation of more than 38 digits is null.  An empty table gives no rows.
    Other columns are not read.  Memory of a task and of the driver: some d x d matrices.
    """
    if weights not in ("one", "count"):
        raise ValueError(f"unknown weights {weights!r}")
    spark = vectors.sparkSession
    ready(spark)
    e = F.col(f"`{vec_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), e.alias("e")).where(_valid(F.col("e"))).select(
        "vec_id", F.transform("e", lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("x"))
    keys = [F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(1), "x").alias("h2")]
    w = F.lit(1).cast("long") if weights == "one" else F.col("copies")
    distinct = stage(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")).select("x", "copies", w.alias("w"), *keys), "distinct")
    sums = _sums(distinct)
    means = {d: np.array([v / n for v in s]) for d, (n, s) in sums.items()}
    weight = {d: n for d, (n, _) in sums.items()}
    fits = {d: _components(c, min(components, d)) for d, c in _covariances(distinct, means, weight).items()}
    shared = spark.sparkContext.broadcast({d: (*sums[d], means[d], *fits[d]) for d in fits})

    def project(batches):
        for batch in batches:
            size = batch.num_rows
            dev, made, length = [None] * size, [None] * size, [0] * size
            for at, x in _by_length(batch, 0, np.int64):
                n, s, mean, ev, u, share = shared.value[x.shape[1]]
                with np.errstate(divide="ignore", invalid="ignore"):
                    z = (x - mean) @ u / np.sqrt(ev)
                z[:, ~(share > _FLAT)] = np.nan
                for i, a, b in zip(at.tolist(), _deviations(x, n, s), z.tolist(), strict=True):
                    dev[i], made[i], length[i] = a, [None if v != v else v for v in b], x.shape[1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in range(1, 5)), pa.array(length, pa.int32()), pa.array(dev, pa.decimal128(38, 0)), pa.array(made, pa.list_(pa.float64()))],
                names=["h1", "h2", "copies", "w", "d", "deviation", "whitened"])

    white = stage(distinct.select("x", "h1", "h2", "copies", "w").mapInArrow(
        project, "h1 long, h2 long, copies long, w long, d int, deviation decimal(38,0), whitened array<double>"), "white")
    drop_stage(distinct)
    facts = [(d, sums[d][0], [None if v != v else float(v) for v in fits[d][2]], _identity_error(white, d, weight[d], fits[d][2])) for d in sorted(fits)]
    known = F.broadcast(spark.createDataFrame(facts, "d int, n long, explained array<double>, identity_error double"))  # a row for each vector length
    found = salted_join(rows.select("vec_id", *keys), white.drop("w", "copies"), ["h1", "h2"], white.select("h1", "h2", "copies"), "copies", ["vec_id"])
    return found.join(known, "d").select("vec_id", "d", "n", "deviation", "whitened", "explained", "identity_error")


def _identity_error(white: DataFrame, d: int, weight: int, share: np.ndarray) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    real = [i for i, v in enumerate(share) if v > _FLAT]
    if not real:
        return None
    z = white.where(F.col("d") == d).select(F.array(*[F.col("whitened")[i] for i in real]).alias("x"), "w")
    mean = np.array(z.agg(*[F.sum(F.col("x")[i] * F.col("w")) for i in range(len(real))]).first()) / weight
    cov = _covariances(z, {len(real): mean}, {len(real): weight})[len(real)]
    return float(np.abs(cov - np.eye(len(real))).max())
