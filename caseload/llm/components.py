"""Connected components of a link table, without any node's links in one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseload.session import materialise


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the links ``a - b``."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root[root], root):
            root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def components(links: DataFrame, u: str, v: str) -> DataFrame:
    """``node, component`` of every linked node but the components' smallest ones.

    Rounds of the large-star and small-star steps; each is written to the shared folder, so a
    lost executor costs one round. A hub's neighbours combine before the shuffle,
    and its join is an ordinary one that Spark splits when it is skewed. Nulls and
    self links are left out.
    """
    high, low = F.greatest(u, v), F.least(u, v)
    edges = links.where(F.col(u) != F.col(v)).select(high.alias("u"), low.alias("v")).distinct()
    edges = materialise(edges, "links")
    state = None
    while True:
        sign = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == state or not sign[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = sign
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.distinct(), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
