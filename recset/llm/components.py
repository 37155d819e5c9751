"""Connected components of a graph that is given by its links."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from recset.llm.common import written


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i] in `root`, an array in which every node points at its class's smallest node."""
    while len(a):
        a, b = root[a], root[b]
        differ = a != b
        a, b = a[differ], b[differ]
        if not len(a):
            return
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in links(a, b): the smallest node that can be reached.

    Rounds of large star and small star: each node's neighbours are linked to the smallest of them, first the larger
    ones, then the others, until nothing changes, which takes a number of rounds that grows with the logarithm of the
    size. Minima are pre-aggregated and joined back, so a node with very many links is not one task. The links of each
    round are written to the shared folder.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "small")
        old, mark = mark, _mark(edges)
        if old == mark:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]
