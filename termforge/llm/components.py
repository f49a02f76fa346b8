"""Connected components of an edge list, by alternating minimum labels and pointer jumping."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def joined(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least of 0 .. n - 1 that each is joined to by the edges (x, y), in one task."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, before[x], low)
        np.minimum.at(root, before[y], low)
        while (root[root] != root).any():
            root = root[root]
        open_ = root[x] != root[y]
        if not open_.any():
            return root
        x, y = x[open_], y[open_]


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the least node of its component.

    A round takes the least label among neighbours, then the label of that label, so a path of n nodes needs about
    log n rounds. Only nodes with an edge take part. Each round is a written table, so no lineage builds up.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), what)
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), what)
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        stepped = labels.join(near, labels.node == near.a, "left").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        # Hooking: a node whose label sank takes its old root along.
        hooks = stepped.where("root < was").groupBy(F.col("was").alias("hook")).agg(F.min("root").alias("low"))
        hooked = stepped.join(hooks, stepped.node == hooks.hook, "left").select("node", "was", F.least("root", "low").alias("root"))
        over = hooked.select(F.col("node").alias("over"), F.col("root").alias("top"))
        after = written(hooked.join(over, hooked.root == over.over, "left").select("node", "was", F.least("root", "top").alias("root")), what)
        labels = after.select("node", "root")
        if after.where("root < was").isEmpty():
            return labels
