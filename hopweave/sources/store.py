"""Graphs, typed graphs and features at rest: Parquet, sorted by source so that a row is read together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hopweave.graph import Graph
from hopweave.operators import features, hetero


def _mode(force: bool) -> str:
    return "overwrite" if force else "errorifexists"


def save_graph(graph: Graph, path: str, force: bool = False) -> None:
    """edges and a metadata row; the committer makes each atomic."""
    graph.edges.repartitionByRange("src").sortWithinPartitions("src", "eid").write.mode(_mode(force)).parquet(f"{path}/edges")
    graph.edges.sparkSession.createDataFrame([(graph.num_nodes, graph.num_dst)], "num_nodes bigint, num_dst bigint").coalesce(1).write.mode(_mode(force)).parquet(f"{path}/meta")


def load_graph(spark: SparkSession, path: str, validate: bool = True) -> Graph:
    """validate: check the ranges of all edges, in one pass, before anything is drawn."""
    meta = spark.read.parquet(f"{path}/meta").head()
    graph = Graph(spark.range(meta["num_nodes"]), spark.read.parquet(f"{path}/edges"), meta["num_nodes"], meta["num_dst"])
    if validate:
        graph.validate()
    return graph


def save_hetero(graph: hetero.HeteroGraph, path: str, force: bool = False) -> None:
    """One folder for each edge type, so that a scan of some types reads no other."""
    spark = graph.edges.sparkSession
    graph.edges.repartition("src_type", "rel", "dst_type").sortWithinPartitions("src_type", "rel", "dst_type", "src", "eid").write.mode(_mode(force)).partitionBy("src_type", "rel", "dst_type").parquet(f"{path}/edges")
    spark.createDataFrame([*graph.counts.items()], "node_type string, num_nodes bigint").coalesce(1).write.mode(_mode(force)).parquet(f"{path}/nodes")
    spark.createDataFrame([(i, *t) for i, t in enumerate(graph.types)], "place int, src_type string, rel string, dst_type string").coalesce(1).write.mode(_mode(force)).parquet(f"{path}/types")


def load_hetero(spark: SparkSession, path: str, validate: bool = True) -> hetero.HeteroGraph:
    counts = {r["node_type"]: r["num_nodes"] for r in spark.read.parquet(f"{path}/nodes").collect()}
    types = tuple((r["src_type"], r["rel"], r["dst_type"]) for r in spark.read.parquet(f"{path}/types").orderBy("place").collect())
    edges = spark.read.schema("src bigint, dst bigint, eid bigint, place bigint, src_type string, rel string, dst_type string").parquet(f"{path}/edges")
    graph = hetero.HeteroGraph(counts, types, edges.select("src_type", "rel", "dst_type", "src", "dst", "eid", "place"))
    if validate:
        hetero.validate(graph)
    return graph


def save_features(rows: DataFrame, path: str, dtype: str = "f32", force: bool = False) -> None:
    """rows(id, x) as f32, rounded to what f16 or bf16 hold, or as int8 blocks."""
    coded = {"f32": lambda r: r.select("id", "x"), "f16": features.f16_roundtrip, "bf16": features.bf16_roundtrip, "int8": features.int8_encode}
    if dtype not in coded:
        raise ValueError(f"unknown dtype {dtype}")
    coded[dtype](rows).write.mode(_mode(force)).parquet(path)


def load_features(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return features.int8_decode(rows) if "codes" in rows.columns else rows


def register(graph: Graph, prefix: str) -> None:
    """{prefix}_nodes and {prefix}_edges as views, for spark.sql."""
    graph.nodes.createOrReplaceTempView(f"{prefix}_nodes")
    graph.edges.createOrReplaceTempView(f"{prefix}_edges")
