"""Byte-balanced shards of indivisible groups by k-way Karmarkar-Karp differencing.

A partial partition is a vector of `shards` sums. The two of largest spread are combined again and again, one in
descending and the other in ascending order, until one is left; walking the combinations back names each group's
shard. Groups are dealt by hash into buckets that are differenced in parallel, each giving one partial partition with
nearly equal sums. FAN of these are differenced in turn in a task, level by level, until the driver can combine the
last few. Groups never split, and copies of a text are summed before the shuffle, so a group of any number of rows is
one item.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopweave.llm.common import if_small, materialize

#: Groups of one bucket; partial partitions combined at once, in a task or on the driver; rows of one slot window.
BUCKET_GROUPS, FAN, WINDOW_ROWS = 50_000, 4096, 50_000


def difference(vectors: np.ndarray) -> np.ndarray:
    """For n vectors of k sums, where each sum of each vector goes: an array n x k of part numbers 0..k-1, each row a permutation.

    Equal spreads combine in the order given. No vector: an empty array.
    """
    n, k = vectors.shape
    if not n:
        return np.zeros((0, k), np.int64)
    order = np.argsort(-vectors, axis=1, kind="stable")
    nodes = [*np.take_along_axis(vectors, order, 1).astype(np.int64)]
    heap = [(int(v[-1] - v[0]), i) for i, v in enumerate(nodes)]
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        total = nodes[a] + nodes[b][::-1]
        p = np.argsort(-total, kind="stable")
        total = total[p]
        nodes[a] = nodes[b] = None
        heapq.heappush(heap, (int(total[-1] - total[0]), len(nodes)))
        nodes.append(total)
        made.append((a, b, p))
    labels: list = [None] * len(nodes)
    labels[-1] = np.arange(k)
    for i in range(len(made) - 1, -1, -1):
        a, b, p = made[i]
        own = labels[n + i]
        labels[n + i] = None
        labels[a], labels[b] = np.empty(k, np.int64), np.empty(k, np.int64)
        labels[a][p] = own
        labels[b][k - 1 - p] = own
    out = np.empty((n, k), np.int64)
    np.put_along_axis(out, order, np.stack(labels[:n]), 1)
    return out


def combine(sums: DataFrame, buckets: int, shards: int, fan: int) -> DataFrame:
    """From sums(bucket, part, bytes) of the buckets' partial partitions to places(bucket, part, shard) for every bucket and part.

    More than `fan` buckets are combined in tasks to one for each `fan` of them, whose places are found in the same way.
    """
    spark = sums.sparkSession
    if buckets <= fan:
        table = np.zeros((buckets, shards), np.int64)
        for r in sums.collect():  # at most fan * shards rows
            table[r["bucket"], r["part"]] = r["bytes"]
        to = difference(table)
        return spark.createDataFrame([(b, p, int(to[b, p])) for b in range(buckets) for p in range(shards)], "bucket int, part int, shard int")

    def level(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own, at = np.unique(pdf["bucket"].to_numpy(), return_inverse=True)
        table = np.zeros((len(own), shards), np.int64)
        table[at, pdf["part"].to_numpy()] = pdf["bytes"].to_numpy()
        to = difference(table)
        parts = np.tile(np.arange(shards, dtype=np.int32), len(own))
        return pd.DataFrame({"bucket": np.repeat(own, shards), "part": parts, "upper": key[0], "upper_part": to.ravel().astype(np.int32), "bytes": table.ravel()})

    grouped = sums.groupBy((F.col("bucket") / fan).cast("int").alias("upper")).applyInPandas(level, "bucket int, part int, upper int, upper_part int, bytes long")
    grouped = materialize(grouped, "level")
    upper = grouped.groupBy(F.col("upper").alias("bucket"), F.col("upper_part").alias("part")).agg(F.sum("bytes").alias("bytes"))
    above = combine(upper, -(-buckets // fan), shards, fan).withColumnsRenamed({"bucket": "upper", "part": "upper_part"})
    return materialize(grouped.join(above, ["upper", "upper_part"]).select("bucket", "part", "shard"), "places")


def shard(docs: DataFrame, shards: int = 16, bucket_groups: int = BUCKET_GROUPS, window_rows: int = WINDOW_ROWS, fan: int = FAN) -> DataFrame:
    """doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null) of every row of docs.

    Sizes are UTF-8 bytes plus 1, and equal texts share a shard; a null text counts as an empty one. Repeated rows and null
    doc_ids take slots of their own. An empty table gives an empty table. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"))
    base = materialize(base, "rows")
    key = ["size", "text_crc32", "k1", "k2"]
    groups = materialize(base.groupBy(*key).agg(F.sum("size").alias("bytes")), "groups")
    n_groups, n_rows = groups.count(), base.count()
    buckets = max(1, -(-n_groups // bucket_groups))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "k1", "k2"], ascending=[False, True, True], kind="stable")
        vectors = np.zeros((len(pdf), shards), np.int64)
        vectors[:, 0] = pdf["bytes"]
        return pdf.assign(part=difference(vectors)[:, 0].astype(np.int32))

    dealt = groups.withColumn("bucket", F.pmod("k1", F.lit(buckets)).cast("int")).groupBy("bucket").applyInPandas(deal, "size long, text_crc32 long, k1 long, k2 long, bytes long, bucket int, part int")
    dealt = materialize(dealt, "parts")
    places = combine(dealt.groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes")), buckets, shards, fan)
    placed = base.join(dealt.join(if_small(places, buckets * shards), ["bucket", "part"]).select(*key, "shard"), key)
    # slots without a window over a whole shard: small windows, and their offsets
    subs = max(1, -(-n_rows // (shards * window_rows)))
    placed = materialize(placed.withColumn("sub", F.pmod(F.xxhash64("doc_id", "k1"), F.lit(subs)).cast("int")), "placed")
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "sub").count().withColumn("from", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    rank = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("doc_id", "k1", "k2"))
    slotted = placed.withColumn("rank", rank).join(offsets, ["shard", "sub"])
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("from") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
