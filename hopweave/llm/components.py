"""Connected components by alternating large-star and small-star steps on an edge table.

Every step is a grouped minimum, combined before the shuffle, and an equi-join with one row per key on the other
side, so that a node with very many edges is split by AQE's skew join. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopweave.llm.common import materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("b", "a") % 1_000_003).alias("s")).head()
    return row["n"], row["x"], row["s"]


def _round(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return low.select("a", F.col("m").alias("b")).union(small).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges(a long, b long) to labels(node, root): the smallest node reachable from each node that has an edge.

    Loops (a = b), nulls and repeated edges change nothing; an empty table gives an empty table.
    """
    edges = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, name)
    before = _state(edges)
    while before[0]:
        edges = materialize(_round(edges), name)
        now = _state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
