"""From seed sets to batches, and from samples to one row per batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from hashlib import md5
from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopweave.functions.draws import key
from hopweave.graph import Graph
from hopweave.operators import dynamic, hetero, sampling
from hopweave.operators.sampling import Config, Sample


def input_nodes(nodes: DataFrame, num_nodes: int) -> DataFrame:
    """nodes(pos, node) or nodes(id, mask) to seeds (pos, node) in order; ids out of range are an error."""
    if "mask" in nodes.columns:
        if (n := nodes.count()) != num_nodes:
            raise ValueError(f"a mask of {n} entries for {num_nodes} nodes")
        return nodes.where("mask").select(F.col("id").alias("pos"), F.col("id").alias("node"))
    if (kind := nodes.schema["node"].dataType.simpleString()) not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"node ids are {kind}, not integers")
    if bad := nodes.where((F.col("node") < 0) | (F.col("node") >= num_nodes) | F.col("node").isNull()).head():
        raise ValueError(f"seed {bad['node']} is not in 0..{num_nodes - 1}")
    return nodes.select("pos", "node")


def sequential(seeds: DataFrame, size: int) -> DataFrame:
    """seeds(pos dense from 0, node) to (batch, pos, node), `pos` within the batch; the last batch may be short."""
    if size <= 0:
        raise ValueError("the batch size must be positive")
    return seeds.select(F.floor(F.col("pos") / size).cast("bigint").alias("batch"), (F.col("pos") % size).cast("bigint").alias("pos"), "node")


def shuffled(seeds: DataFrame, size: int, seed: int, epoch: int) -> DataFrame:
    """The same after a shuffle by digest. Ranks come from 256 ranges of the digest's order, not from one window."""
    k = seeds.withColumn("key", key(seed, epoch, F.col("pos"))).withColumn("part", F.substring("key", 1, 2))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = k.groupBy("part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("key", "pos")) - 1
    placed = k.withColumn("rank", rank).join(F.broadcast(starts), "part")  # at most 256 rows
    return sequential(placed.select((F.col("start") + F.col("rank")).alias("pos"), "node"), size)


def coprime(spark, num_nodes: int, size: int, offset: int, stride: int) -> DataFrame:
    """All nodes in the order (offset + pos * stride) mod n, which visits each once: arithmetic, no shuffle."""
    if num_nodes and gcd(stride, num_nodes) != 1:
        raise ValueError("stride and the number of nodes must be coprime")
    rows = spark.range(num_nodes).select(F.col("id").alias("pos"), ((F.lit(offset) + F.col("id") * stride) % max(1, num_nodes)).cast("bigint").alias("node"))
    return sequential(rows, size)


def drawn_order(num_nodes: int, seed: int, epoch: int) -> tuple[int, int]:
    """An offset and a stride for coprime(), drawn for each epoch."""
    word = lambda *parts: int(md5("|".join(map(str, (seed, epoch, *parts))).encode()).hexdigest()[:15], 16)
    n, at = max(1, num_nodes), 0
    while gcd(stride := 1 + word("stride", at) % n, n) != 1:
        at += 1
    return word("offset") % n, stride


def epoch_seed(seed: int, epoch: int) -> int:
    """The seed of an epoch's draws: the same in each run, another in each epoch."""
    return int(md5(f"{seed}|{epoch}".encode()).hexdigest()[:12], 16)


def gather(nodes: DataFrame, features: DataFrame, width: str = "x") -> DataFrame:
    """nodes(..., node) joined with features(id, x); a missing row is an error when the frame is run."""
    joined = nodes.join(features.select(F.col("id").alias("node"), F.col(width)), "node", "left")
    missing = F.concat(F.lit("no features for node "), F.col("node").cast("string"))
    return joined.withColumn(width, F.when(F.col(width).isNull(), F.raise_error(missing).cast(features.schema[width].dataType)).otherwise(F.col(width)))


def batch_rows(sampled: Sample, features: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """One row per batch: edge_index_0, edge_index_1, n_id, e_id, batch_size, and with features x, x_shape_0, x_shape_1; with labels y.
    For samples that aren't disjoint."""
    nodes = sampled.nodes
    if features is not None:
        nodes = gather(nodes, features)
    if labels is not None:
        nodes = nodes.join(labels.select(F.col("id").alias("node"), F.col("label").alias("y")), "node", "left")
    kept = ["local", "node", *(["x"] if features is not None else []), *(["y"] if labels is not None else [])]
    packed = nodes.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("n"), F.sum((F.col("hop") == 0).cast("int")).cast("int").alias("batch_size"))
    edges = sampled.edge_index().groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("hop", "edge_index_1", "e_id", "edge_index_0"))).alias("e"))
    rows = packed.join(edges, "batch", "left").withColumn("e", F.coalesce("e", F.array().cast(edges.schema["e"].dataType)))
    # a field of an array of structs is the array of that field
    cols = ["batch", F.col("e.edge_index_0").alias("edge_index_0"), F.col("e.edge_index_1").alias("edge_index_1"), F.col("n.node").alias("n_id"), F.col("e.e_id").alias("e_id"), "batch_size"]
    if features is not None:
        cols += [F.flatten("n.x").alias("x"), F.size("n").alias("x_shape_0"), F.size(F.get("n", F.lit(0))["x"]).alias("x_shape_1")]
    if labels is not None:
        cols.append(F.col("n.y").alias("y"))
    return rows.select(*cols)


def custom_batches(seeds: DataFrame, sampler, schema: str) -> DataFrame:
    """A user's own sampler, one call per batch: pandas rows of seeds to pandas rows of `schema`."""
    return seeds.groupBy("batch").applyInPandas(sampler, schema)


def neighbor_batches(graph: Graph | tuple[DataFrame, int], seeds: DataFrame, size: int, config: Config, epoch: int = 0, shuffle: bool = False, features: DataFrame | None = None, labels: DataFrame | None = None, transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One epoch of a loader, a row for each batch: batch_rows() and with it input_id (each seed's place among the input nodes),
    seed_index (its place among the batch's nodes), num_sampled_nodes and num_sampled_edges by hop. Each epoch has draws, and
    with shuffle an order, of its own. seeds(pos, node) as input_nodes() gives them; of a growing graph, (log, num_nodes), each
    epoch sees the edges up to it. transform gets the frame of batches last."""
    if config.disjoint:
        raise ValueError("one row for each batch needs samples that aren't disjoint")
    if isinstance(graph, tuple):
        graph = dynamic.to_static(graph[0], epoch, graph[1])
    dense = seeds.withColumn("pos", F.col("pos").cast("bigint"))
    ordered = shuffled(dense.select("pos", "node"), size, config.seed, epoch) if shuffle else sequential(dense.select("pos", "node"), size)
    drawn = sampling.sample(graph, ordered, replace(config, seed=epoch_seed(config.seed, epoch)))
    rows = batch_rows(drawn, features, labels)
    # places among the input nodes: of equal nodes the first
    first = dense.groupBy("node").agg(F.min("pos").alias("input_id"))
    places = drawn.seed_indices().join(first, "node").groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("pos", "input_id", "local"))).alias("s"))
    hops = F.sequence(F.lit(0).cast("bigint"), F.lit(len(config.fanout)).cast("bigint"))
    counts = drawn.counts().groupBy("batch").agg(F.map_from_entries(F.collect_list(F.struct("hop", F.struct("num_nodes", "num_edges")))).alias("c"))
    count = lambda name, first: F.transform(F.slice(hops, first + 1, len(config.fanout) + 1 - first), lambda h: F.coalesce(F.col("c")[h][name], F.lit(0)))
    out = rows.join(places, "batch").join(counts, "batch").select(*rows.columns, F.col("s.input_id").alias("input_id"), F.col("s.local").alias("seed_index"), count("num_nodes", 0).alias("num_sampled_nodes"), count("num_edges", 1).alias("num_sampled_edges"))
    return transform(out) if transform else out


def hetero_batches(graph: hetero.HeteroGraph, seed_type: str, seeds: DataFrame, size: int, fanout: dict, seed: int = 42, epoch: int = 0, shuffle: bool = False, replace: bool = False, features: dict[str, DataFrame] | None = None, transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One epoch of a typed loader, a row for each batch: batch, batch_size, seed_index, n_id (map of each node type to its nodes
    in local order), edge_index_0, edge_index_1 and e_id (maps of each edge type, its names joined by __, to local sources, local
    destinations and edges), x (map of the types with features(id, x) to their rows). Types without a node or edge are there, empty."""
    dense = seeds.select(F.col("pos").cast("bigint").alias("pos"), "node")
    ordered = shuffled(dense, size, seed, epoch) if shuffle else sequential(dense, size)
    drawn = hetero.sample(graph, seed_type, ordered, fanout, epoch_seed(seed, epoch), replace)
    longs = "array<bigint>"

    def maps(cells: DataFrame, of: str, names: list[str], **columns) -> DataFrame:
        """batch and a map for each column, from cells(batch, of, items: array of structs)."""
        entries = cells.groupBy("batch").agg(F.map_from_entries(F.collect_list(F.struct(of, "items"))).alias("m"))
        return entries.select("batch", *[F.map_from_entries(F.array(*[F.struct(F.lit(n), F.coalesce(F.col("m")[n][field], F.array().cast(kind))) for n in names])).alias(out) for out, (field, kind) in columns.items()])

    nodes = drawn.nodes.groupBy("batch", "node_type").agg(F.array_sort(F.collect_list(F.struct("local", "node"))).alias("items"))
    out = maps(nodes, "node_type", list(drawn.node_types), n_id=("node", longs))
    named = drawn.local_edges().withColumn("edge_type", F.concat_ws("__", *hetero.TYPED))
    edges = named.groupBy("batch", "edge_type").agg(F.array_sort(F.collect_list(F.struct("hop", "dst_local", "eid", "src_local"))).alias("items"))
    kinds = ["__".join(t) for t in drawn.edge_types]
    found = maps(edges, "edge_type", kinds, edge_index_0=("src_local", longs), edge_index_1=("dst_local", longs), e_id=("eid", longs))
    places = drawn.seed_indices().groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("pos", "local"))).alias("s"), F.count_distinct("node").cast("int").alias("batch_size"))
    none = F.map_from_entries(F.array(*[F.struct(F.lit(n), F.array().cast(longs)) for n in kinds]))
    rows = out.join(places.select("batch", "batch_size", F.col("s.local").alias("seed_index")), "batch").join(found, "batch", "left")
    rows = rows.select("batch", "batch_size", "seed_index", "n_id", *[F.coalesce(c, none).alias(c) for c in ("edge_index_0", "edge_index_1", "e_id")])
    if features:
        read = None
        for kind, table in features.items():
            one = gather(drawn.nodes.where(F.col("node_type") == kind), table).select("batch", "node_type", "local", "x")
            read = one if read is None else read.unionByName(one)
        kept = read.groupBy("batch", "node_type").agg(F.array_sort(F.collect_list(F.struct("local", "x"))).alias("items"))
        rows = rows.join(maps(kept, "node_type", list(features), x=("x", "array<array<float>>")), "batch", "left")
    return transform(rows) if transform else rows
