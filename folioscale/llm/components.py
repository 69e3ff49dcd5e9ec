"""Connected components by alternating large and small stars, as joins and minimum aggregates.

Nothing gathers a node's neighbours: a node's least neighbour is a partial aggregate, and a join that Spark can split
hands it to the others. Each round is written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscale.llm import common


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the smallest node of its component) for every node of a link other than the roots themselves.

    Links to a null or to itself count for nothing; repeats and both directions are allowed.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` is not null and `{b}` is not null and u <> v").distinct()
    edges = common.cut(edges, "stars")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(now)
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).union(edges.select("v", "u"))
        least = both.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("n", "least").alias("least"))
        large = both.join(least, "n").where("m > n").select(F.col("m").alias("u"), F.col("least").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).union(least)
        edges = common.cut(small.distinct(), "stars")


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and their component's smallest node, of the links in one batch; roots are left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        for ends in (root[left], root[right], left, right):
            np.minimum.at(new, ends, low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]
