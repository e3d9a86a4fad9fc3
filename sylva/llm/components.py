"""Connected components of a large graph: local forests, hooking and contraction.

One level of the loop:

1. *Thin.*  Edges are dealt by a hash of both ends to buckets of about ``per_bucket``;
   each bucket becomes a forest of stars with the same components (numpy, one bucket in
   memory at a time).  A hub is dealt to all buckets.
2. *Hook.*  Every node points to the least of its neighbours and itself.  Pointers
   descend, so they form trees, and no root that has a larger neighbour stays alone.
3. *Compress.*  Pointers are doubled until every node points to its root.
4. *Contract.*  Edges are rewritten to roots; loops and copies go.

Every node with an edge either is no root or gains a child, so each level loses at least
a half of the nodes of every component that is not yet one node (random names: two
thirds), whatever the graph's diameter.  There is no cap on levels.  A graph that fits
one bucket is settled by its first level.  The least node of a component stays a root at every level and names it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import drop_table, materialize

PER_BUCKET = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """A star per component of some edges, centred on its smallest node."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        x, y = root[x], root[y]
        open_ = x != y
        x, y = x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # roots hook to smaller roots
        while (root[root] != root).any():
            root = root[root]
    leaf = root != np.arange(len(nodes))
    return pd.DataFrame({"a": nodes[root[leaf]], "b": nodes[leaf]})


def _thin(pdf: pd.DataFrame) -> pd.DataFrame:
    return stars(pdf["a"].to_numpy(), pdf["b"].to_numpy())


def _hooked(edges: DataFrame) -> DataFrame:
    """(node, root): the least of a node and its neighbours, by partial aggregates, so a hub is no single task."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")
    return edges.select(ends).groupBy(F.col("e.node").alias("node")).agg(F.min("e.other").alias("m")).select("node", F.least("node", "m").alias("root"))


def _compressed(pointers: DataFrame) -> DataFrame:
    """Pointer doubling until all point to roots; only pointers to nodes that are no roots are looked up."""
    while True:
        inner = pointers.filter("node <> root").select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        after = materialize(pointers.join(inner, F.col("root") == F.col("n2"), "left").select("node", F.coalesce("r2", "root").alias("root"), F.col("r2").isNotNull().alias("moved")), "pointers")
        moved = after.filter("moved").limit(1).count()
        drop_table(pointers)
        pointers = after.select("node", "root")
        if not moved:
            return pointers


def components(edges: DataFrame, per_bucket: int = PER_BUCKET) -> DataFrame:
    """(node, root): the smallest node of each node's component; nodes without edges are not listed.

    Loops and repeated edges are allowed, ends must not be null; an empty graph gives an
    empty table.  The driver sees one count a level.
    """
    graph = materialize(edges.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).filter("a <> b").distinct(), "edges")
    levels = []
    while n := graph.count():
        buckets = -(-n // per_bucket)
        deal = F.pmod(F.xxhash64("a", "b", F.lit(len(levels))), F.lit(buckets)).alias("k")
        forest = materialize(graph.groupBy(deal).applyInPandas(_thin, "a long, b long"), "forest")
        pointers = materialize(_hooked(forest), "pointers")
        levels.append(_compressed(pointers) if buckets > 1 else pointers)
        drop_table(graph)
        if buckets == 1:
            break
        root = levels[-1].select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        half = forest.join(root, F.col("a") == F.col("n2")).select(F.col("r2").alias("a"), "b")
        moved = half.join(root, F.col("b") == F.col("n2")).select(F.least("a", "r2").alias("a"), F.greatest("a", "r2").alias("b")).filter("a <> b").distinct()
        graph = materialize(moved, "edges")
        drop_table(forest)
    if not levels:
        return graph.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = levels[-1]
    for below in reversed(levels[:-1]):
        up = labels.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        labels = below.join(up, F.col("root") == F.col("n2"), "left").select("node", F.coalesce("r2", "root").alias("root"))
    return labels
