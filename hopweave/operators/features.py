"""Feature codecs and storage arithmetic: block-scaled int8, half precisions, spans, delta lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 32


def int8_encode(features: DataFrame, block: int = BLOCK) -> DataFrame:
    """features(id, x) to id, block, scale (float: greatest magnitude / 127), codes (tinyint, half away from zero). One row per block;
    a block of zeros has scale 0 and the last block may be short. Empty rows and non-finite values are errors."""
    x = F.col("x")
    wrong = (F.size(x) == 0) | F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fine = features.withColumn("x", F.when(wrong, F.raise_error(F.concat(F.lit("row can't be encoded: "), F.col("id").cast("string"))).cast("array<float>")).otherwise(x.cast("array<float>")))
    cut = fine.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), (F.ceil(F.size("x") / block) - 1).cast("int")), lambda b: F.slice("x", b * block + 1, F.lit(block)))).alias("block", "v"))
    scaled = cut.withColumn("scale", (F.array_max(F.transform("v", F.abs)) / F.lit(127.0).cast("float")).cast("float"))
    code = lambda v: F.when(F.col("scale") == 0, F.lit(0)).otherwise(F.least(F.lit(127), F.greatest(F.lit(-127), F.round((v / F.col("scale")).cast("float"))))).cast("tinyint")
    return scaled.select("id", F.col("block").cast("bigint").alias("block"), "scale", F.transform("v", code).alias("codes"))


def int8_decode(blocks: DataFrame) -> DataFrame:
    """id, x: codes times scale, in single precision."""
    values = blocks.select("id", "block", F.transform("codes", lambda c: (c.cast("float") * F.col("scale")).cast("float")).alias("v"))
    return values.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "v"))), lambda s: s["v"])).alias("x"))


def _rounded(features: DataFrame, convert) -> DataFrame:
    def step(batches):
        for pdf in batches:
            pdf["x"] = [convert(np.asarray(v, np.float32)).tolist() for v in pdf["x"]]
            yield pdf

    return features.select("id", F.col("x").cast("array<float>").alias("x")).mapInPandas(step, "id bigint, x array<float>")


def f16_roundtrip(features: DataFrame) -> DataFrame:
    """x as IEEE half precision holds it."""
    return _rounded(features, lambda v: v.astype(np.float16).astype(np.float32))


def bf16(v: np.ndarray) -> np.ndarray:
    """Nearest bfloat16, ties to even; a NaN stays a quiet NaN."""
    bits = v.astype(np.float32).view(np.uint32)
    up = bits + np.uint32(0x7FFF) + ((bits >> np.uint32(16)) & np.uint32(1))
    kept = np.where(np.isnan(v), bits | np.uint32(0x00400000), up) & np.uint32(0xFFFF0000)
    return kept.view(np.float32)


def bf16_roundtrip(features: DataFrame) -> DataFrame:
    return _rounded(features, bf16)


def coalesce_spans(spans: DataFrame, per: list[str], row_bytes: int, granule: int, most: int) -> DataFrame:
    """spans(per..., start) of row_bytes each, rounded out to `granule` and cut at `most`: merged spans lo, hi and how many each holds."""
    rounded = spans.select(*per, (F.floor(F.col("start") / granule) * granule).cast("bigint").alias("lo"), F.least(F.ceil((F.col("start") + row_bytes) / granule) * granule, F.lit(most)).cast("bigint").alias("hi"))
    rounded = rounded.groupBy(*per, "lo", "hi").agg(F.count("*").alias("n"))  # no ties for the windows
    order = Window.partitionBy(*per).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = rounded.withColumn("new", F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0)).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*per, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").cast("bigint").alias("rows")).drop("island")


def delta_lengths(edges: DataFrame) -> DataFrame:
    """edges(src, eid, dst) with delta: to the row's previous destination, wrapping at 32 bits, and the bytes (1 to 4) it takes."""
    before = F.lag("dst").over(Window.partitionBy("src").orderBy("eid"))
    delta = F.pmod(F.col("dst") - F.coalesce(before, F.lit(0)), F.lit(1 << 32)).cast("bigint")
    length = F.when(F.col("delta") < 1 << 8, 1).when(F.col("delta") < 1 << 16, 2).when(F.col("delta") < 1 << 24, 3).otherwise(4).cast("bigint")
    return edges.select("src", "eid", "dst", delta.alias("delta")).withColumn("bytes", length)


def undo_deltas(deltas: DataFrame) -> DataFrame:
    """delta back to dst: a running sum, wrapping at 32 bits."""
    upto = Window.partitionBy("src").orderBy("eid").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.select("src", "eid", F.pmod(F.sum("delta").over(upto), F.lit(1 << 32)).cast("bigint").alias("dst"))


def offset_gaps(offsets: DataFrame) -> DataFrame:
    """offsets(id, start) with gap: to the previous offset; what a monotone code stores."""
    ranged = offsets.withColumn("part", F.floor(F.col("id") / 65_536))
    within = F.lag("start").over(Window.partitionBy("part").orderBy("id"))
    last = offsets.groupBy((F.floor(F.col("id") / 65_536) + 1).alias("part")).agg(F.max("start").alias("before"))
    return ranged.withColumn("prev", within).join(last, "part", "left").select("id", "start", (F.col("start") - F.coalesce("prev", "before", F.lit(0))).cast("bigint").alias("gap"))


class Sieve:
    """A cache of `capacity` slots with one visited bit each; a hand moves from the oldest to the newest and evicts the first
    slot whose bit is clear, clearing bits on its way and passing over pinned ids."""

    def __init__(self, capacity: int, pinned: frozenset[int] = frozenset()):
        self.capacity, self.pinned = capacity, pinned
        self.order: list[int] = []  # oldest first
        self.visited: dict[int, bool] = {}
        self.hand = 0

    def get(self, item: int) -> bool:
        if item in self.visited:
            self.visited[item] = True
            return True
        if len(self.order) >= self.capacity and not self._evict():
            return False
        self.order.append(item)
        self.visited[item] = False
        return False

    def _evict(self) -> bool:
        for _ in range(2 * len(self.order) + 1):
            self.hand %= len(self.order)
            item = self.order[self.hand]
            if item in self.pinned:
                self.hand += 1
            elif self.visited[item]:
                self.visited[item] = False
                self.hand += 1
            else:
                del self.order[self.hand], self.visited[item]
                return True
        return False


def sieve_cache(accesses: DataFrame, capacity: int, pinned: frozenset[int] = frozenset()) -> DataFrame:
    """accesses(stream, pos, id) to stream, hits, misses: each stream is a sequential simulation of its own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cache = Sieve(capacity, pinned)
        hits = sum(cache.get(int(i)) for i in pdf.sort_values("pos")["id"])
        return pd.DataFrame({"stream": [pdf["stream"].iloc[0]], "hits": [hits], "misses": [len(pdf) - hits]})

    return accesses.groupBy("stream").applyInPandas(run, "stream bigint, hits bigint, misses bigint")
