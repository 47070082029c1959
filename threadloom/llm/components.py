"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ._spark import durable


def _written(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The edges as a table, with their number and a digest that tell whether a round changed them."""
    seen = Observation()
    out = durable(edges.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")), "edges")
    return out, (seen.get["n"], seen.get["x"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge: the component is its smallest node.

    Edges are pairs of long ids without nulls; loops and repeated edges do no harm; an empty table gives no row.
    Each round relinks every node to the least node among its neighbours, by aggregation and a join, and is written
    to the shared folder; the rounds grow with the logarithm of the longest chain.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col("a") != F.col("b")).distinct()
    e, mark = _written(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the join on a hub's key is of two plain exchanges, which Spark splits
        least = durable(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = durable(large.where(F.col("a") != F.col("b")).distinct(), "large")
        root = durable(large.groupBy("a").agg(F.min("b").alias("m")), "roots")
        pair = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))
        small = large.join(root, "a").select(F.inline(pair)).where(F.col("a") != F.col("b")).distinct()
        e, now = _written(small)
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
