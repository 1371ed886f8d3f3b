"""Connected components of an edge table by alternating star contraction (large star, small star)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Edges that one task may finish: 4 MB of them, some tens of MB as its union-find.
FITS = 1 << 18


def local_forest(batches):
    """Replace a task's edges by star edges to the smallest node of each of their components: fewer rows, same components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def stars():
        rows = [(x, r) for x in parent if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array(np.array([r[i] for r in rows], np.int64)) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 1_000_000:
            yield stars()
            parent.clear()
    if parent:
        yield stars()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (columns a and b, long, not null): the smallest node it reaches.

    Every round rewrites the edges so that nodes hang on smaller ones; a round that changes nothing leaves stars, and their
    centres are the components. The number of rounds grows with the logarithm of the largest component. As soon as no more than
    FITS edges are left, a task joins them at once. Nothing but counts reaches the driver; each round is written to the shared
    checkpoint folder.
    """
    edges = cut(edges.filter("a <> b").mapInArrow(local_forest, "a long, b long").distinct())
    before, left = None, edges.count()
    while True:
        if left <= FITS:
            return _named(cut(edges.coalesce(1).mapInArrow(local_forest, "a long, b long")))
        # large star: larger neighbours of a node move to the smallest node around it
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.n).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        moved = large.join(low, large.a == low.n).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")),
                                                                          F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = cut(moved.select("e.*").filter("a <> b").distinct())
        state = edges.select(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.countDistinct("a")).first()
        if state[0] == state[2] and state == before:
            return _named(edges)
        before, left = state, state[0]


def _named(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select(F.col("b"), F.col("b")).distinct())
