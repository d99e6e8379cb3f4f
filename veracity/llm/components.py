"""Connected components by repeated contraction.

Every vertex hooks to its smallest neighbour if that is smaller than itself,
the hooks are shortened by pointer jumping, and the edges are rewritten to the
new labels; loops and repeats disappear.  Labels only ever fall, so the last
vertex left of a component is its smallest one.  Hubs with any number of
edges are met by partial aggregation and by joins that may be split: no task
needs all edges of a vertex, and only the number of edges left goes to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.llm.common import drop_stage, stage


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest place of each place's component, for links between places 0 to n - 1 in one task."""
    root = np.arange(n)
    while len(i):
        was = root.copy()
        low = np.minimum(root[i], root[j])
        for ends in (root[i], root[j], i, j):
            np.minimum.at(root, ends, low)
        root = root[root]
        if (root == was).all():
            break
    while (root[root] != root).any():
        root = root[root]
    return root


def _hooks(edges: DataFrame) -> DataFrame:
    """(id, c): each vertex and the label it takes in this round."""
    both = edges.select(F.col("u").alias("id"), F.col("v").alias("c")).union(
        edges.select(F.col("v").alias("id"), F.col("u").alias("c")))
    return both.groupBy("id").agg(F.min("c").alias("c")).select("id", F.least("id", "c").alias("c"))


def _jump(hooks: DataFrame) -> DataFrame:
    nxt = hooks.select(F.col("id").alias("c"), F.col("c").alias("d"))
    return hooks.join(nxt, "c").select("id", F.col("d").alias("c"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex of ``edges`` (u, v); component is the
    smallest id of the vertex's component.

    Null ends and loops are ignored, repeats and direction don't matter, and
    no edges give no rows.
    """
    edges = stage(edges.where("u is not null and v is not null and u <> v")
                  .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = None
    while labels is None or not edges.isEmpty():
        first = stage(_hooks(edges), "hooks")
        hooks = stage(_jump(_jump(first)), "jumped")
        drop_stage(first)
        u = hooks.select(F.col("id").alias("u"), F.col("c").alias("cu"))
        v = hooks.select(F.col("id").alias("v"), F.col("c").alias("cv"))
        left = edges.join(u, "u").join(v, "v").where("cu <> cv").select(
            F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).distinct()
        left = stage(left, "edges")
        if labels is None:
            labels = hooks
        else:
            nxt = hooks.select(F.col("id").alias("c"), F.col("c").alias("d"))
            merged = stage(labels.join(nxt, "c", "left").select("id", F.coalesce("d", "c").alias("c")), "labels")
            drop_stage(labels)
            drop_stage(hooks)
            labels = merged
        drop_stage(edges)
        edges = left
    return labels.select("id", F.col("c").alias("component"))
