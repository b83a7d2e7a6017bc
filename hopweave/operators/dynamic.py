"""A growing graph as an append-only, epoch-stamped set of edges, with snapshots, dirty nodes and stale embeddings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopweave.graph import Graph, from_edges

SCHEMA = "src bigint, dst bigint, epoch bigint"


def checked(batch: DataFrame, num_nodes: int) -> DataFrame:
    """batch(src, dst) with ok: both ends in range."""
    return batch.withColumn("ok", F.coalesce((F.col("src") >= 0) & (F.col("src") < num_nodes) & (F.col("dst") >= 0) & (F.col("dst") < num_nodes), F.lit(False)))


def insert(log: DataFrame, batch: DataFrame, epoch: int, num_nodes: int | None = None) -> DataFrame:
    """The edges of batch that log doesn't hold yet, once each, under `epoch`. With num_nodes, an end out of range fails the whole batch."""
    if num_nodes is not None and (bad := checked(batch, num_nodes).where("not ok").head()):
        raise ValueError(f"edge ({bad['src']}, {bad['dst']}) exceeds num_nodes {num_nodes}")
    return batch.select("src", "dst").distinct().join(log.select("src", "dst"), ["src", "dst"], "left_anti").select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), F.lit(epoch).cast("bigint").alias("epoch"))


def replay(stream: DataFrame) -> DataFrame:
    """stream(src, dst, epoch) with repeats to the log: each edge under the first epoch that brought it."""
    return stream.groupBy("src", "dst").agg(F.min("epoch").cast("bigint").alias("epoch"))


def snapshot(log: DataFrame, epoch: int) -> DataFrame:
    return log.where(F.col("epoch") <= epoch).select("src", "dst")


def has_edges(log: DataFrame, epoch: int, wanted: DataFrame) -> DataFrame:
    """wanted(pos, src, dst) with found: whether the snapshot of an epoch has the edge."""
    there = snapshot(log, epoch).distinct().withColumn("there", F.lit(True))
    return wanted.join(there, ["src", "dst"], "left").select("pos", "src", "dst", F.coalesce("there", F.lit(False)).alias("found"))


def is_dirty(log: DataFrame, drained: int, now: int, wanted: DataFrame) -> DataFrame:
    """wanted(pos, id) with dirty: whether an edge of the epochs after `drained`, up to `now`, touched it."""
    touched = dirty(log, drained, now).select(F.col("node").alias("id"), F.lit(True).alias("touched"))
    return wanted.join(touched, "id", "left").select("pos", "id", F.coalesce("touched", F.lit(False)).alias("dirty"))


def to_static(log: DataFrame, epoch: int, num_nodes: int) -> Graph:
    """A snapshot as a graph; rows rise by destination."""
    return from_edges(snapshot(log, epoch), num_nodes, ["dst"])


def dirty(log: DataFrame, drained: int, now: int) -> DataFrame:
    """node: both ends of the edges that came after epoch `drained`, up to `now`."""
    return log.where((F.col("epoch") > drained) & (F.col("epoch") <= now)).select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def ingest_stats(stream: DataFrame, num_nodes: int) -> DataFrame:
    """Per epoch: edges received, inserted, duplicates (of this epoch or an earlier one) and errors (out of range)."""
    rows = checked(stream, num_nodes)
    first = replay(rows.where("ok").select("src", "dst", "epoch")).groupBy("epoch").agg(F.count("*").alias("inserted"))
    seen = rows.groupBy("epoch").agg(F.count("*").cast("bigint").alias("received"), F.sum((~F.col("ok")).cast("bigint")).alias("errors"))
    both = seen.join(first, "epoch", "left").withColumn("inserted", F.coalesce("inserted", F.lit(0)).cast("bigint"))
    return both.select(F.col("epoch").cast("bigint").alias("epoch"), "received", "inserted", (F.col("received") - F.col("inserted") - F.col("errors")).alias("duplicates"), "errors")


@dataclass(frozen=True)
class EmbeddingCache:
    """rows(id, gen, emb); gen counts from 1 and 0 is never computed. current: the generation that counts as fresh."""

    rows: DataFrame
    current: int

    def stale(self, wanted: DataFrame, dirty_nodes: DataFrame | None = None) -> DataFrame:
        """wanted(pos, id) with stale: never computed, of an older generation, or dirty."""
        found = wanted.join(self.rows.select("id", "gen"), "id", "left")
        old = F.col("gen").isNull() | (F.col("gen") < self.current)
        if dirty_nodes is not None:
            found = found.join(dirty_nodes.select(F.col("node").alias("id"), F.lit(True).alias("dirty")), "id", "left")
            old = old | F.coalesce("dirty", F.lit(False))
        return found.select("pos", "id", old.alias("stale"))

    def get(self, wanted: DataFrame) -> DataFrame:
        """Whatever was computed, of any generation."""
        return wanted.join(self.rows.where("gen != 0"), "id").select("pos", "id", "gen", "emb")

    def update(self, fresh: DataFrame) -> EmbeddingCache:
        """fresh(id, emb) takes the place of what there was, under the current generation."""
        kept = self.rows.join(fresh.select("id"), "id", "left_anti")
        return EmbeddingCache(kept.unionByName(fresh.select("id", F.lit(self.current).cast("bigint").alias("gen"), "emb")), self.current)

    def invalidate(self, nodes: DataFrame) -> EmbeddingCache:
        gone = nodes.select(F.col("node").alias("id"), F.lit(True).alias("gone"))
        rows = self.rows.join(gone, "id", "left").select("id", F.when(F.coalesce("gone", F.lit(False)), F.lit(0)).otherwise(F.col("gen")).cast("bigint").alias("gen"), "emb")
        return EmbeddingCache(rows, self.current)

    def advance(self) -> EmbeddingCache:
        return EmbeddingCache(self.rows, self.current + 1)


def prepare_batch(cache: EmbeddingCache, wanted: DataFrame, dirty_nodes: DataFrame) -> DataFrame:
    """wanted(pos, id) with action: "recompute" where stale or dirty, else "cached"."""
    return cache.stale(wanted, dirty_nodes).select("pos", "id", F.when(F.col("stale"), "recompute").otherwise("cached").alias("action"))


def commit_batch(cache: EmbeddingCache, dirty_nodes: DataFrame, fresh: DataFrame) -> tuple[EmbeddingCache, DataFrame]:
    """The cache with what was recomputed, and the nodes that stay dirty."""
    return cache.update(fresh), dirty_nodes.join(fresh.select(F.col("id").alias("node")), "node", "left_anti")
