"""Nearest neighbours by inverted lists and an adaptive scan of rotated dimensions.

Vectors are scaled to length 1 and rotated by a fixed random rotation, so that the first columns of a difference are
a random sample of it. A bounded sample gives the list centres; every vector goes to its nearest centre's list, and
lists are cut into blocks by a digest, so one very common vector fills many blocks. A query visits the blocks of its
nearest lists. Within a block, distances grow by blocks of columns, and a hypothesis test abandons a candidate as
soon as its partial distance, scaled up, is beyond the fifth best by more than chance allows. The fifth best is at
first that among some sampled vectors, which all lists and blocks share; each block brings it down by its first rows
and by those that look nearest after one step. Survivors are scored on the original vectors in double precision.

Of rows with equal vectors only those of the smallest vec_ids can be found, so no more are stored. Queries that visit
a list are cut into parts, each of which reads the list's blocks. How many lists a query visits is fitted on the
sample: the fewest that find GOAL of the true neighbours there. Lists grow in number with the root of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopweave.llm.common import if_small, materialize

#: Rows of the sample, and at most, where many lists need more; rows of a list on average, at least; the most lists.
SAMPLE_ROWS, SAMPLE_MOST, LIST_ROWS, MOST_LISTS = 16_384, 131_072, 500, 16_384
#: Rows of a block; queries of a part; sampled vectors that give a query its first bound.
BLOCK_ROWS, QUERY_ROWS, BOUND_ROWS = 4096, 16_384, 2048
#: Squared distances that differ by no more may be equal but for rounding.
EQUAL = 1e-11
#: Columns of a step, the tests' width in standard errors, recall on the sample.
STEP, WIDTH, GOAL = 16, 2.1, 0.97


@dataclass(frozen=True)
class Index:
    rotation: np.ndarray
    centres: np.ndarray
    probes: int
    visits: np.ndarray  # of each list, the share of the sample that visits it


def valid(vector: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre of each row, a few rows at a time."""
    return np.concatenate([np.argmax(x[at : at + 1024] @ centres.T, axis=1) for at in range(0, max(1, len(x)), 1024)])


def wanted_lists(rows: int) -> int:
    return int(max(1, min(MOST_LISTS, round(rows**0.5 / 2), rows // LIST_ROWS)))


def fit(sample: np.ndarray, rows: int, k: int, seed: int = 11) -> Index:
    """From sampled vectors and the count of all: rotation, centres by Lloyd steps, and the number of lists to visit."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    x = unit(sample)
    lists = max(1, min(len(x) // 8, wanted_lists(rows)))
    centres = x[rng.permutation(len(x))[:lists]]
    for _ in range(10 if lists > 1 else 0):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = np.linalg.norm(sums, axis=1) > 1e-9
        centres[full] = unit(sums[full])
    if lists == 1:
        return Index(rotation, centres, 1, np.ones(1))
    tests = x[rng.permutation(len(x))[:256]]
    order = np.argsort(-(tests @ centres.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of each list in the order of each test
    near = nearest(x, centres)
    best = np.argsort(-(tests @ x.T), axis=1, kind="stable")[:, 1 : k + 1]
    needed = np.sort(np.take_along_axis(place, near[best], 1).ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(GOAL * len(needed))))]) + 1
    return Index(rotation, centres, probes, (place < probes).mean(0))


def scan(query: np.ndarray, block: np.ndarray, k: int, kept: float = np.inf, lead: np.ndarray | None = None) -> np.ndarray:
    """Rows of block (rotated, unit) that can be among the k nearest to query, if those are no further than kept
    (a squared distance): the adaptive scan itself. lead: the squared lengths of the rows' first STEP columns."""
    d = block.shape[1]
    rows = np.arange(len(block))
    first = rows[: max(64, 4 * k)]
    exact = ((block[first] - query) ** 2).sum(1)

    def least(kept: float) -> float:
        return min(kept, np.partition(exact, k - 1)[k - 1] + EQUAL) if len(exact) >= k else kept

    limit = least(kept)
    alive = rows[len(first) :]
    partial = np.zeros(len(alive))
    for at in range(0, d, STEP):
        if not len(alive):
            break
        to = min(d, at + STEP)
        if at == 0 and lead is not None:
            partial = np.maximum(lead[len(first) :] + (query[:to] ** 2).sum() - 2 * (block[len(first) :, :to] @ query[:to]), 0)
        else:
            partial = partial + ((block[alive, at:to] - query[at:to]) ** 2).sum(1)
        if at == 0 and len(alive) > 4 * k:
            # what looks nearest is measured at once, and tightens the bound
            likely = np.argpartition(partial, k - 1)[:k]
            exact = np.append(exact, ((block[alive[likely]] - query) ** 2).sum(1))
            limit = least(limit)
        bound = limit * (1 + (WIDTH / to**0.5 if to < d else 0)) ** 2 + EQUAL
        stay = partial * (d / to) <= bound
        alive, partial = alive[stay], partial[stay]
    return np.concatenate([first[exact[: len(first)] <= limit + EQUAL], alive])


def first_bounds(asked: np.ndarray, some: np.ndarray, k: int) -> np.ndarray:
    """For each unit vector, a squared distance within which k of the unit vectors `some` lie."""
    if len(some) < k:
        return np.full(len(asked), np.inf)
    nearness = np.concatenate([np.partition(asked[at : at + 1024] @ some.T, len(some) - k, axis=1)[:, len(some) - k] for at in range(0, max(1, len(asked)), 1024)])
    return 2 - 2 * nearness + EQUAL


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of one vector with each row of b, in double precision; each row by itself, so equal rows score the same."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (b * a).sum(1) / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum(1)))


def search(vectors: DataFrame, every: int = 50, k: int = 5, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose vec_id is divisible by `every`, its k nearest other rows by cosine.

    Vectors that are null, zero, of another length than most of the sample, or hold null or non-finite components take
    no part, nor do null vec_ids. A row that repeats a vec_id and its vector is the query itself, not its candidate;
    other repeated vectors tie, and smaller vec_ids come first. Fewer than k candidates: all of them. An empty table
    gives an empty table. Other columns are ignored, whatever they are called.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("v")).where(valid(F.col("v")) & F.col("vec_id").isNotNull())
    rows = rows.withColumns({"h": F.xxhash64("vec_id", "v"), "hv": F.xxhash64("v")})
    out = "query_id long, rank int, vec_id long, score double"
    is_query = F.col("vec_id") % every == 0
    total, asking = rows.agg(F.count("*"), F.count_if(is_query)).head()
    # the rows of least digest: a sample that doesn't depend on partitions
    sample_rows = max(sample_rows, min(SAMPLE_MOST, 8 * wanted_lists(total)))
    sample = rows.orderBy("h", "vec_id").limit(sample_rows).select("vec_id", "h", "v").toPandas()
    if not len(sample):
        return spark.createDataFrame([], out)
    dims = int(np.bincount([len(x) for x in sample["v"]]).argmax())
    rows = rows.where(F.size("v") == dims)
    sample = sample[[len(x) == dims for x in sample["v"]]]
    index = fit(np.stack(sample["v"]).astype(np.float64), total, k)
    some = np.stack(sample.drop_duplicates(["vec_id", "h"])["v"][:BOUND_ROWS])
    parts = np.maximum(1, np.ceil(asking * index.visits / query_rows)).astype(int).tolist()

    def units(column: pa.Array) -> np.ndarray:
        return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("list", pa.array(nearest(units(batch.column("v")), index.centres).astype(np.int32)))

    # rows whose vector occurs once are stored as they are; of others the k + 1 smallest vec_ids, with up to k repeats each
    repeated = materialize(rows.groupBy("hv").count().where("count > 1").select("hv", F.lit(True).alias("repeated")), "repeated")
    marked = rows.join(if_small(repeated, repeated.count()), "hv", "left").select("vec_id", "v", "h", "repeated")
    marked = materialize(marked.mapInArrow(assign, "vec_id long, v array<float>, h long, repeated boolean, list int"), "lists")
    copies = marked.where("repeated").groupBy("vec_id", "v", "h", "list").agg(F.count("*").alias("n"))
    least = copies.withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("at") <= k + 1)
    once = marked.where("repeated is null").select("vec_id", "v", "h", "list", F.lit(1).cast("long").alias("n"))
    placed = materialize(once.union(least.select("vec_id", "v", "h", "list", F.least("n", F.lit(k)))), "stored")

    sizes = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}  # at most MOST_LISTS rows
    blocks = {c: -(-n // block_rows) for c, n in sizes.items()}
    cuts = spark.createDataFrame([(c, b, parts[c]) for c, b in blocks.items()], "list int, blocks int, parts int")
    stored = placed.join(F.broadcast(cuts), "list").select("list", F.pmod("h", "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "v", "h", "n")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = unit(some.astype(np.float64))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                x = units(batch.column("v"))
                bounds = first_bounds(x, near, k + 1)
                own = batch.column("h").to_numpy().view(np.uint64)
                for i, order in enumerate(np.argsort(-(x @ index.centres.T), axis=1, kind="stable")):
                    keys, seen, limits = [], 0, []
                    for n, c in enumerate(order.tolist()):
                        if n >= index.probes and seen > 2 * k:
                            break
                        # the first lists have no bound, so that k rows come from them however far they are
                        limits += [bounds[i] if seen > 2 * k else np.inf] * blocks.get(c, 0)
                        seen += sizes.get(c, 0)
                        keys += [(c, b, int(own[i] % np.uint64(parts[c]))) for b in range(blocks.get(c, 0))]
                    one = batch.slice(i, 1).take(pa.array(np.zeros(len(keys), np.int32)))
                    names = ["list", "block", "part", "query_id", "q", "qh", "bound"]
                    yield pa.RecordBatch.from_arrays([*(pa.array([key[j] for key in keys], pa.int32()) for j in range(3)), *one.columns, pa.array(limits, pa.float64())], names)

    queries = rows.where(is_query).dropDuplicates(["vec_id", "h"]).select("vec_id", "v", "h")
    asked = queries.mapInArrow(visit, "list int, block int, part int, query_id long, q array<float>, qh long, bound double")

    def look(key: tuple, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found: list = []
        if len(queries) and len(block):
            block = block.sort_values(["vec_id", "h"], kind="stable")
            v, ids, h, copies = np.stack(block["v"]), block["vec_id"].to_numpy(), block["h"].to_numpy(), block["n"].to_numpy()
            turned = unit(v.astype(np.float64)) @ index.rotation
            lead = (turned[:, :STEP] ** 2).sum(1)
            q = np.stack(queries["q"])
            asked = unit(q.astype(np.float64)) @ index.rotation
            for i, (query, qh, bound) in enumerate(zip(queries["query_id"], queries["qh"], queries["bound"], strict=True)):
                near = scan(asked[i], turned, k + 1, bound, lead)
                near = near[(ids[near] != query) | (h[near] != qh)]
                if not len(near):
                    continue
                score = cosine(q[i], v[near])
                best = np.lexsort((ids[near], -score))[:k]
                best = np.repeat(best, copies[near[best]])[:k]
                found += [(query, qh, int(ids[near[j]]), float(score[j])) for j in best]
        return pd.DataFrame(found, columns=["query_id", "qh", "vec_id", "score"])

    place = ["list", "block", "part"]
    partial = asked.groupBy(*place).cogroup(stored.groupBy(*place)).applyInPandas(look, "query_id long, qh long, vec_id long, score double")
    order = Window.partitionBy("query_id", "qh").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
