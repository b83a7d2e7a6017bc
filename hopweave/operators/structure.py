"""Structural queries over a graph: degrees, rows, transposes, statistics, relabelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopweave.functions.prefix import place, prefix_sum
from hopweave.graph import Graph, from_edges, out_of_lists


def degrees(graph: Graph) -> DataFrame:
    """id, degree of every node, isolated ones too."""
    counts = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return graph.nodes.join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("degree"))


def offsets(graph: Graph) -> DataFrame:
    """id, degree, start: where each node's row begins."""
    return prefix_sum(degrees(graph), "id", "degree", "start").select("id", "degree", "start")


def degrees_of(graph: Graph, wanted: DataFrame) -> DataFrame:
    """wanted(pos, id) to pos, id, degree: input order and repeats stay; ids out of range have 0."""
    counts = graph.edges.join(wanted.select(F.col("id").alias("src")).distinct(), "src", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return wanted.join(counts, "id", "left").select("pos", "id", F.coalesce("n", F.lit(0)).cast("bigint").alias("degree"))


def neighbors(graph: Graph, wanted: DataFrame) -> DataFrame:
    """wanted(pos, id) to one row per neighbor: pos, id, rank in the stored row, and the edge's columns."""
    found = wanted.join(graph.edges, F.col("id") == F.col("src")).drop("src")
    rank = F.row_number().over(Window.partitionBy("pos").orderBy("eid")).cast("bigint") - 1
    return found.select("pos", "id", rank.alias("rank"), *[c for c in graph.edges.columns if c != "src"])


def neighbor_lists(graph: Graph, wanted: DataFrame) -> DataFrame:
    """wanted(pos, id) to pos, id and the stored row as an array; no neighbor: an empty array."""
    rows = graph.edges.join(wanted.select(F.col("id").alias("src")).distinct(), "src", "left_semi").groupBy(F.col("src").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("eid", "dst"))), lambda x: x["dst"]).alias("row"))
    return wanted.join(rows, "id", "left").select("pos", "id", F.coalesce("row", F.array().cast("array<bigint>")).alias("neighbors"))


def transpose(graph: Graph) -> DataFrame:
    """dst, rank among its in-edges, src, eid: sources in stored order."""
    return place(graph.edges.select("dst", "src", "eid"), ("dst",), "eid", "rank").select("dst", "rank", "src", "eid")


def stats(graph: Graph) -> DataFrame:
    """One row: nodes, edges, greatest and mean degree, isolated nodes."""
    return degrees(graph).agg(
        F.count("*").cast("bigint").alias("num_nodes"),
        F.coalesce(F.sum("degree"), F.lit(0)).cast("bigint").alias("num_edges"),
        F.coalesce(F.max("degree"), F.lit(0)).cast("bigint").alias("max_degree"),
        F.coalesce(F.sum("degree") / F.count("*"), F.lit(0.0)).alias("avg_degree"),
        F.coalesce(F.sum((F.col("degree") == 0).cast("bigint")), F.lit(0)).cast("bigint").alias("isolated"),
    )


def degree_histogram(graph: Graph) -> DataFrame:
    return degrees(graph).groupBy("degree").agg(F.count("*").cast("bigint").alias("num_nodes"))


def degree_percentiles(graph: Graph, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Linear percentiles of the degrees, cut to integers."""
    values = degrees(graph).agg(F.percentile("degree", F.array(*map(F.lit, shares))).alias("p"))
    return values.select(*[F.floor(F.get("p", F.lit(i))).cast("bigint").alias(f"p{round(s * 100)}") for i, s in enumerate(shares)])


def degree_percentiles_discrete(graph: Graph, shares: tuple[tuple[int, int], ...] = ((1, 2), (9, 10), (99, 100))) -> DataFrame:
    """The least degree up to which n * a // b nodes lie, from the histogram alone."""
    upto = Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)
    rows = degree_histogram(graph).withColumn("seen", F.sum("num_nodes").over(upto)).withColumn("n", F.sum("num_nodes").over(Window.partitionBy()))
    return rows.agg(*[F.min(F.when(F.col("seen") >= F.floor(F.col("n") * a / b), F.col("degree"))).cast("bigint").alias(f"p{100 * a // b}") for a, b in shares])


def permute(graph: Graph, order: DataFrame) -> Graph:
    """order(id, old): the node `old` becomes `id`. Rows keep their neighbors' order; weights and timestamps follow. For
    homogeneous graphs: one order can't name both sides of a bipartite one."""
    if not graph.is_homogeneous:
        raise ValueError(f"a bipartite graph ({graph.num_nodes} to {graph.num_dst} nodes) can't be permuted by one order")
    checked = order.agg(F.count("*").alias("n"), F.count_distinct("old").alias("d"), F.min("old").alias("a"), F.max("old").alias("b")).head()
    if (checked["n"], checked["d"]) != (graph.num_nodes, graph.num_nodes) or (graph.num_nodes and (checked["a"], checked["b"]) != (0, graph.num_nodes - 1)):
        raise ValueError("not a permutation of the nodes")
    return _relabelled(graph, order.select(F.col("old"), F.col("id").alias("new")))


def _relabelled(graph: Graph, names: DataFrame) -> Graph:
    ends = [names.select(F.col("old").alias(c), F.col("new").alias(f"new_{c}")) for c in ("src", "dst")]
    moved = graph.edges.join(ends[0], "src").join(ends[1], "dst")
    kept = [c for c in ("weight", "ts") if c in graph.edges.columns]
    return from_edges(moved.select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), F.col("eid").alias("old_eid"), *kept), graph.num_nodes, ["old_eid"], graph.num_dst)


def reversed_ids(graph: Graph) -> Graph:
    """The permutation that turns ids around, without a join."""
    if not graph.is_homogeneous:
        raise ValueError(f"a bipartite graph ({graph.num_nodes} to {graph.num_dst} nodes) can't be permuted by one order")
    n, m, lists = graph.num_nodes, graph.num_edges(), graph.adjacency()
    # rows move as they are, the last one first
    turned = lists.select((F.lit(n - 1) - F.col("src")).alias("src"), (F.lit(m) - F.col("start") - F.col("degree")).alias("start"), "degree", "first", F.transform("dst", lambda d: F.lit(n - 1) - d).alias("dst"), *graph.kept())
    return Graph(graph.nodes, out_of_lists(turned), n, n, lists=turned)
