"""Communities, community-aligned batches and counter-based reservoirs."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopweave.graph import Graph

#: The multipliers and key steps of Philox 4x32, ten rounds.
PHILOX_M, PHILOX_W = (0xD2511F53, 0xCD9E8D57), (0x9E3779B9, 0xBB67AE85)
#: The multiplier of the batch shuffle's congruential generator, whose increment is 1.
LCG = 0x517CC1B727220A95


def communities(n: int, near: Iterable[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Merges in rising degree order into the neighboring community of greatest positive modularity gain, ties to the smaller id.

    near: each node with its neighbors, one for each edge in either direction, loops left out. Gives perm, where perm[new] = old along the
    merge trees (children newest first), and each node's community, numbered by their least members. Gains are compared exactly.
    Neighbors stay in the arrays they came in; of a community only what its members had left is added.
    """
    links: dict[int, list[tuple[np.ndarray, np.ndarray | None]]] = {}
    strength = np.zeros(n, np.int64)
    for v, to in near:
        links.setdefault(v, []).append((to, None))
        strength[v] += len(to)
    total = int(strength.sum())
    number = np.int64 if total < 1 << 31 else object  # a product of two sums of weights
    owner, done = np.arange(n), np.zeros(n, bool)

    def top(x: np.ndarray) -> np.ndarray:
        at = owner[x]
        while (up := owner[at]).tobytes() != at.tobytes():
            at = up
        owner[x] = at
        return at

    children: dict[int, list[int]] = {}
    for v in np.argsort(strength, kind="stable").tolist():
        done[v] = True
        if not (parts := links.pop(v, None)):
            continue
        at, where = np.unique(top(np.concatenate([t for t, _ in parts])), return_inverse=True)
        # sums of weights up to 2^53 are exact as doubles
        weight = np.bincount(where, np.concatenate([np.ones(len(t)) if w is None else w for t, w in parts])).astype(np.int64)
        at, weight = at[at != v], weight[at != v]
        if not len(at):
            continue
        gain = weight.astype(number) * total - int(strength[v]) * strength[at].astype(number)
        i = int(gain.argmax())
        if gain[i] <= 0:
            continue
        best = int(at[i])
        owner[v] = best
        children.setdefault(best, []).append(v)
        strength[best] += strength[v]
        if not done[best] and len(at) > 1:
            links.setdefault(best, []).append((np.delete(at, i).astype(parts[0][0].dtype), np.delete(weight, i)))
    perm, roots = [], top(np.arange(n))
    _, first, part = np.unique(roots, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    for root in np.flatnonzero(owner == np.arange(n)).tolist():
        stack = [root]
        while stack:
            v = stack.pop()
            perm.append(v)
            stack += children.get(v, ())
    return np.array(perm, np.int64), rank[part]


def rabbit(graph: Graph) -> DataFrame:
    """id, old, partition: the node `old` becomes `id`, and its community. The merge is sequential, so all nodes' neighbors go to one
    task, as arrays of 4 bytes for each; label_propagation() is the distributed alternative."""
    n = graph.num_nodes

    def run(batches):
        def near():
            for b in batches:
                cells = b.column(1)
                to, ends = cells.values.to_numpy(), cells.offsets.to_numpy()
                for v, i, j in zip(b.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    yield v, to[i:j]

        perm, part = communities(n, near())
        for i in range(0, n, 100_000):
            old = perm[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(old))), pa.array(old), pa.array(part[old])], ["id", "old", "partition"])

    if not n:
        return graph.edges.sparkSession.createDataFrame([], "id bigint, old bigint, partition bigint")
    edges, kind = graph.edges.where("src != dst"), "int" if n < 1 << 31 else "bigint"
    if edges.isEmpty():
        return graph.nodes.select("id", F.col("id").alias("old"), F.col("id").alias("partition"))
    end = lambda a, b: edges.select(F.col(a).alias("v"), F.col(b).cast(kind).alias("to"))
    lists = end("src", "dst").unionByName(end("dst", "src")).groupBy("v").agg(F.collect_list("to").alias("to"))
    return lists.repartition(1).mapInArrow(run, "id bigint, old bigint, partition bigint")


def label_propagation(graph: Graph, rounds: int = 5) -> DataFrame:
    """id, partition by a few synchronous rounds of most frequent neighboring labels, ties to the smaller: for graphs of any size."""
    both = graph.edges.select("src", "dst").union(graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src != dst").persist()
    labels = graph.nodes.select("id", F.col("id").alias("label"))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src", "label").count()
        best = votes.groupBy("src").agg(F.min(F.struct(-F.col("count"), "label")).getField("label").alias("best"))
        labels = labels.join(best, F.col("id") == F.col("src"), "left").select("id", F.coalesce("best", "label").alias("label")).persist()
    return labels.select("id", F.col("label").alias("partition"))


def partition_batches(parts: DataFrame, seeds: DataFrame, size: int, shuffle_seed: int | None = None) -> DataFrame:
    """parts(id, partition), seeds(pos, node) to (batch, pos, node, partition): stable by partition, equal `pos` by node, cut every `size`; batches may straddle
    partitions. With a seed, the partitions' order is shuffled; their number is that of communities, the only thing the driver
    sees. A seed without a partition is an error when the batches are read."""
    if size <= 0:
        raise ValueError("the batch size must be positive")
    rows = seeds.join(parts.select(F.col("id").alias("node"), "partition"), "node", "left")
    missing = F.raise_error(F.concat(F.lit("no partition for seed "), F.coalesce(F.col("node").cast("string"), F.lit("null")))).cast(parts.schema["partition"].dataType)
    rows = rows.withColumn("partition", F.when(F.col("partition").isNull(), missing).otherwise(F.col("partition")))
    counts = rows.groupBy("partition").agg(F.count("*").alias("n"))
    if shuffle_seed is None:
        upto = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select("partition", F.coalesce(F.sum("n").over(upto), F.lit(0)).cast("bigint").alias("start"))
    else:
        order, at, table = [(r["partition"], r["n"]) for r in counts.orderBy("partition").collect()], 0, []
        for p, n in shuffled(order, shuffle_seed):
            table.append((p, at))
            at += n
        starts = seeds.sparkSession.createDataFrame(table, "partition bigint, start bigint")
    rank = F.row_number().over(Window.partitionBy("partition").orderBy("pos", "node")) - 1
    placed = rows.withColumn("rank", rank).join(starts, "partition").withColumn("place", (F.col("start") + F.col("rank")).cast("bigint"))
    return placed.select(F.floor(F.col("place") / size).cast("bigint").alias("batch"), (F.col("place") % size).alias("pos"), "node", "partition")


def shuffled(items: list, seed: int) -> list:
    """Fisher-Yates from the end, by the high bits of a 64-bit congruential generator."""
    out, wide = list(items), (1 << 64) - 1
    state = (seed * LCG + 1) & wide
    for i in range(len(out) - 1, 0, -1):
        state = (state * LCG + 1) & wide
        j = (state >> 33) % (i + 1)
        out[i], out[j] = out[j], out[i]
    return out


def philox(counter: np.ndarray, key: tuple[int, int]) -> np.ndarray:
    """Philox 4x32-10 of counters (n, 4) as uint32 words."""
    c = counter.astype(np.uint64)
    k0, k1 = key
    low = np.uint64(0xFFFFFFFF)
    for _ in range(10):
        a, b = c[:, 0] * np.uint64(PHILOX_M[0]), c[:, 2] * np.uint64(PHILOX_M[1])
        c = np.stack([(b >> np.uint64(32)) ^ c[:, 1] ^ np.uint64(k0), b & low, (a >> np.uint64(32)) ^ c[:, 3] ^ np.uint64(k1), a & low], 1)
        k0, k1 = (k0 + PHILOX_W[0]) & 0xFFFFFFFF, (k1 + PHILOX_W[1]) & 0xFFFFFFFF
    return c.astype(np.uint32)


def reservoir(row: np.ndarray, fanout: int, seed: int, layer: int, node: int) -> np.ndarray:
    """Algorithm R: candidate t takes slot r mod (t + 1) where that is one of the first `fanout`; r is word t mod 4 of draw group t // 4."""
    if fanout >= len(row) or not fanout:
        return row[: max(fanout, 0)] if not fanout else row
    t = np.arange(fanout, len(row))
    groups = np.arange(t[0] // 4, t[-1] // 4 + 1)
    words = philox(np.stack([np.full(len(groups), node & 0xFFFFFFFF), np.full(len(groups), node >> 32), np.full(len(groups), layer), groups], 1), (seed & 0xFFFFFFFF, seed >> 32)).ravel()
    slots = words[t - 4 * groups[0]].astype(np.int64) % (t + 1)
    kept = row[:fanout].copy()
    for s, v in zip(slots[slots < fanout], row[fanout:][slots < fanout], strict=True):
        kept[s] = v
    return kept


def philox_reservoir(lists: DataFrame, fanout: int, seed: int, layer: int = 0) -> DataFrame:
    """lists(pos, id, neighbors) to pos, id, slot, dst: bit for bit the same on any cluster."""

    def run(batches):
        for pdf in batches:
            rows = [(p, i, s, int(v)) for p, i, r in zip(pdf["pos"], pdf["id"], pdf["neighbors"], strict=True) for s, v in enumerate(reservoir(np.asarray(r, np.int64), fanout, seed, layer, int(i)))]
            yield pd.DataFrame(rows, columns=["pos", "id", "slot", "dst"])

    return lists.select("pos", "id", "neighbors").mapInPandas(run, "pos bigint, id bigint, slot bigint, dst bigint")
