"""k-hop neighborhood samples of many seed batches in one job.

Batches are a column, never a loop: every table carries (batch, block), where block is the seed's position when
samples are disjoint and 0 otherwise. A hop is an equi-join of the frontier with the edges, a ranked cut of each
row, a grouped first discovery and an anti-join with the nodes seen before. Draws are digests of (seed, batch, block, hop,
source, edge), so equal inputs give equal samples at any parallelism. Where orders leave a choice: nodes of
a hop are numbered by their discoverer's number, then by edge; bounds of a temporal sample are those at the hop's start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopweave.functions.draws import below, distinct, key, pair, unit, weighted
from hopweave.graph import LIST, Graph

#: Rows of a frontier, or of the places drawn from it, that are broadcast to the edges; beyond, both are shuffled.
BROADCAST_ROWS = 250_000
GROUP = ["batch", "block"]
#: Edges of a stretch that induced() reads in one task.
STRETCH = 16_000_000


@dataclass(frozen=True)
class Config:
    """What to draw. fanout -1 takes whole rows."""

    fanout: tuple[int, ...]
    seed: int = 42
    replace: bool = False
    weighted: bool = False
    cumulative: bool = False
    disjoint: bool = False
    max_degree: int | None = None
    subgraph: str = "directional"
    temporal: str | None = None

    def __post_init__(self):
        if not self.fanout or any(k < -1 for k in self.fanout):
            raise ValueError("fanout must be non-empty, each -1 or more")
        if self.max_degree is not None and self.max_degree <= 0:
            raise ValueError("max_degree must be positive")
        if self.subgraph not in ("directional", "induced", "bidirectional"):
            raise ValueError(f"unknown subgraph type {self.subgraph}")
        if self.temporal not in (None, "uniform", "last"):
            raise ValueError(f"unknown temporal strategy {self.temporal}")


@dataclass(frozen=True)
class Sample:
    """nodes(batch, block, local, node, hop), edges(batch, block, hop, src, dst, eid), seeds(batch, block, pos, node).
    An edge's src is the node that was expanded and dst the neighbor drawn."""

    nodes: DataFrame
    edges: DataFrame
    seeds: DataFrame
    held: tuple[DataFrame, ...] = ()
    #: edges with src_local, where they are those drawn
    located: DataFrame | None = None

    def release(self) -> None:
        """Gives back what was kept in memory while hops were drawn; frames that are read again are drawn again."""
        for frame in self.held:
            frame.unpersist()

    def local_edges(self) -> DataFrame:
        """edges with src_local and dst_local, the ends' places in nodes."""
        to = self.nodes.select(*GROUP, F.col("node").alias("dst"), F.col("local").alias("dst_local"))
        edges = self.located
        if edges is None:
            edges = self.edges.join(self.nodes.select(*GROUP, F.col("node").alias("src"), F.col("local").alias("src_local")), [*GROUP, "src"])
        return edges.join(to, [*GROUP, "dst"]).select(*GROUP, "hop", "src", "dst", "eid", "src_local", "dst_local")

    def edge_index(self) -> DataFrame:
        """As message passing reads it: row 0 the neighbor, row 1 the expanded node, both local."""
        return self.local_edges().select(*GROUP, F.col("dst_local").alias("edge_index_0"), F.col("src_local").alias("edge_index_1"), F.col("eid").alias("e_id"), "hop")

    def seed_indices(self) -> DataFrame:
        return self.seeds.join(self.nodes.select(*GROUP, "node", "local"), [*GROUP, "node"]).select(*GROUP, "pos", "node", "local")

    def counts(self) -> DataFrame:
        """batch, block, hop, num_nodes, num_edges; hop 0 are the seeds."""
        n = self.nodes.groupBy(*GROUP, "hop").agg(F.count("*").cast("bigint").alias("num_nodes"))
        e = self.edges.groupBy(*GROUP, "hop").agg(F.count("*").cast("bigint").alias("num_edges"))
        return n.join(e, [*GROUP, "hop"], "full").select(*GROUP, "hop", F.coalesce("num_nodes", F.lit(0)).alias("num_nodes"), F.coalesce("num_edges", F.lit(0)).alias("num_edges"))

    def to_dict(self, batch: int = 0) -> dict:
        """Of one batch, collected: nodes in discovery order, edges by hop (src and dst as local places), ids, seeds' places and
        counts by hop."""
        of = lambda frame: frame.where(F.col("batch") == batch)
        one = Sample(of(self.nodes), of(self.edges), of(self.seeds), located=None if self.located is None else of(self.located))
        edges = one.local_edges().orderBy("block", "hop", "src_local", "eid").collect()
        counts = one.counts().groupBy("hop").agg(F.sum("num_nodes").alias("n"), F.sum("num_edges").alias("e")).orderBy("hop").collect()
        return {
            "nodes": [r["node"] for r in one.nodes.orderBy("block", "local").collect()], "src": [r["src_local"] for r in edges], "dst": [r["dst_local"] for r in edges], "edge_ids": [r["eid"] for r in edges],
            "seeds": [r["local"] for r in one.seed_indices().orderBy("pos").collect()], "num_nodes": [r["n"] for r in counts], "num_edges": [r["e"] for r in counts][1:],
        }

    def arrow_tables(self) -> dict:
        return {"edges": self.edges.select(F.col("dst").alias("edge_src"), F.col("src").alias("edge_dst"), F.col("eid").alias("edge_id")).toArrow(), "nodes": self.nodes.orderBy(*GROUP, "local").select(F.col("node").alias("nodes")).toArrow(), "seeds": self.seeds.orderBy("batch", "pos").select(F.col("node").alias("seeds")).toArrow()}


def _ranked(rows: DataFrame, by: list[Column | str], k: int, per: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*per).orderBy(*by))
    return rows.withColumn("rk", rank).where(F.col("rk") <= k).drop("rk")


def _hint(side: DataFrame, rows: int) -> DataFrame:
    """Sent to every executor while it is small, so that edges stay where they are."""
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side


def draw(frontier: DataFrame, graph: Graph, config: Config, hop: int, n: int) -> DataFrame:
    """frontier(batch, block, node, local[, bound]) of n rows to the hop's edges: batch, block, hop, src, dst, eid, parent[, ts]."""
    k, seed, per = config.fanout[hop - 1], config.seed, [*GROUP, "src"]
    rows = frontier.select(*GROUP, F.col("node").alias("src"), F.col("local").alias("parent"), *(["bound"] if config.temporal else []))
    digest = lambda *extra: key(seed, F.col("batch"), F.col("block"), hop, F.col("src"), *extra)
    columns = [*GROUP, F.lit(hop).cast("bigint").alias("hop"), "src", "dst", "eid", "parent", *(["ts"] if config.temporal else [])]
    if config.temporal and config.max_degree is not None and config.temporal == "uniform":
        found = graph.edges.join(_hint(rows, n), "src").where(F.col("bound").isNull() | (F.col("ts") < F.col("bound")))
        found = _capped(found, config, digest, per)
        return (_ranked(found, [digest(F.col("eid")), "eid"], k, per) if k >= 0 else found).select(*columns)
    if k == 0:
        return graph.edges.join(rows, "src").select(*columns).limit(0)
    lists = graph.adjacency()

    def at(places: Column, *more: str) -> DataFrame:
        """The edges at given places of each row, picked from its lists: a hub costs no more than any node, and no edge is shuffled alone."""
        here = F.filter(places, lambda i: (i >= F.col("first")) & (i < F.col("first") + F.size("dst")))
        placed = lists.select("src", "start", "degree", "first", "dst", *more).join(_hint(rows, n), "src").select("*", F.explode(here).alias("place"))
        spot = (F.col("place") - F.col("first")).cast("int")
        return placed.select(*GROUP, "src", "parent", (F.col("start") + F.col("place")).alias("eid"), *[F.get(c, spot).alias(c) for c in ("dst", *more)])

    eid = lambda i: F.col("start") + F.col("first") + i
    every = F.sequence(F.lit(0), F.size("dst") - 1)
    #: the same text as digest(eid), its first part made once for a row of the frontier
    stem = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in GROUP], F.lit(str(hop)), F.col("src").cast("string"), F.lit(""))
    hashed = lambda i: F.md5(F.concat(F.col("stem"), eid(i).cast("string")).cast("binary"))

    def best(of: DataFrame, order: Callable[[Column], list[Column]], among: Column, pick: Callable | None = None) -> DataFrame:
        """The first k edges of each row by order(i), with i among the places of a list. Lists are cut where they are; only of a
        row of several lists are the rests ranked again."""
        names = [f"o{j}" for j in range(len(order(F.lit(0))))]
        ranked = lambda places: F.slice(F.array_sort(F.transform(places, lambda i: F.struct(*[o.alias(c) for o, c in zip(order(i), names, strict=True)], eid(i).alias("eid"), i.alias("i")))), 1, k)
        found = of.withColumn("r", F.explode(ranked(among) if pick is None else pick(ranked, among)))
        found = found.select(*GROUP, "src", "parent", "degree", *[F.col(f"r.{c}").alias(c) for c in names], F.col("r.eid").alias("eid"), *[F.get(c, F.col("r.i")).alias(c) for c in ("dst", *(["ts"] if config.temporal else []))])
        few = found.where(F.col("degree") <= LIST)
        if (lists.agg(F.max("degree").alias("most")).head()["most"] or 0) <= LIST:
            return few
        return few.unionByName(_ranked(found.where(F.col("degree") > LIST), [*names, "eid"], k, per))

    if k < 0 or config.temporal:
        used = ["src", "start", "degree", "first", "dst", *(["ts"] if config.temporal else [])]
        met = lists.select(*used).join(_hint(rows, n), "src").withColumn("stem", stem)
        fine = F.filter(every, lambda i: F.col("bound").isNull() | (F.get("ts", i) < F.col("bound"))) if config.temporal else every
        if k < 0:
            return met.withColumn("i", F.explode(fine)).select(*GROUP, "src", "parent", eid(F.col("i")).alias("eid"), *[F.get(c, F.col("i")).alias(c) for c in used[4:]]).select(*columns)
        if config.temporal == "last":
            ts = lambda i: F.coalesce(F.when(F.isnan(F.get("ts", i)), float("-inf")).otherwise(-F.get("ts", i)), F.lit(float("inf")))
            return best(met, lambda i: [ts(i), -eid(i)], fine).select(*columns)
        return best(met, lambda i: [hashed(i)], fine).select(*columns)

    def some(most: int, *extra) -> Column:
        whole = F.sequence(F.lit(0).cast("bigint"), F.col("degree") - 1)
        return F.when(F.col("degree") <= most, whole).otherwise(distinct(lambda i: digest(*extra, i), F.col("degree"), most))

    if not config.replace:
        if not config.weighted:
            return at(some(k)).select(*columns)
        if config.max_degree is not None:
            # the cap first: of a row beyond it only so many places are looked at
            found = at(some(config.max_degree, "cap"), "weight")
            return _ranked(found, [weighted(digest(F.col("eid")), F.col("weight")), digest(F.col("eid")), "eid"], k, per).select(*columns)
        # with k or more than the row has, all are taken whatever their weights
        weights = F.transform("weight", lambda w: F.when((w > 0) & ~F.isnan(w) & (w < float("inf")), w.cast("double")))
        total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + F.coalesce(w, F.lit(0.0)))
        bounded = lists.select("src", "start", "degree", "first", "dst", "weight", F.array_max(weights).alias("top"), total.alias("total"))
        # about `near` edges have a rank of at most `limit`; an edge whose draw is below `least` has a greater one whatever its weight
        near = k + 4.0 * k**0.5 + 8
        bounded = bounded.withColumn("limit", F.when((F.col("total") > 0) & (F.size("dst") > near), near / F.col("total")).otherwise(F.lit(float("inf"))))
        floor = F.floor(F.exp(-F.col("top") * F.col("limit")) * (float(1 << 52) * (1 - 1e-9))) - 2
        bounded = bounded.withColumn("least", F.when((F.col("limit") < float("inf")) & (floor > 0), F.lpad(F.lower(F.hex(floor.cast("bigint"))), 13, "0")).otherwise(F.lit("")))
        met = bounded.join(_hint(rows, n), "src").withColumn("stem", stem)

        def pick(ranked, among: Column) -> Column:
            """Those above `least`, where k of them are within the limit; else all are looked at."""
            some = F.array(ranked(F.filter(among, lambda i: hashed(i) >= F.col("least"))))
            return F.element_at(F.transform(some, lambda t: F.when((F.size(t) == k) & (F.get(t, F.lit(k - 1))["o0"] <= F.col("limit")), t).otherwise(ranked(among))), 1)

        return best(met, lambda i: [weighted(hashed(i), F.get("weight", i)), hashed(i)], every, pick).select(*columns)
    each = F.sequence(F.lit(0), F.lit(k - 1))
    if not config.weighted:
        return at(F.transform(each, lambda i: below(digest(i), F.col("degree")))).select(*columns)
    curve = graph.running_weights()
    totals = curve.where("last").select("src", F.col("high").alias("total"))
    aimed = totals.join(_hint(rows, n), "src").withColumn("i", F.explode(each)).withColumn("x", (F.lit(1.0) - unit(digest(F.col("i")))) * F.col("total"))
    hit = ((F.col("x") >= F.col("low")) & (F.col("x") < F.col("high"))) | (F.col("last") & (F.col("x") >= F.col("high")))
    return curve.join(_hint(aimed, n * k), "src").where(hit).select(*columns)


def _capped(found: DataFrame, config: Config, digest, per: list[str]) -> DataFrame:
    if config.max_degree is None:
        return found
    return _ranked(found, [digest("cap", F.col("eid")), "eid"], config.max_degree, per)


def sample(graph: Graph, seeds: DataFrame, config: Config) -> Sample:
    """seeds(batch, pos, node[, time]): order and repeats count. The samples of all batches at once. Seeds out of range, and
    times without a strategy that reads them, are errors."""
    if config.weighted and not graph.has_weights:
        raise ValueError("weighted sampling needs weights")
    if config.temporal and not graph.has_timestamps:
        raise ValueError("temporal sampling needs timestamps")
    timed = F.col("time").isNotNull() if "time" in seeds.columns and not config.temporal else F.lit(False)
    beyond = F.col("node").isNull() | (F.col("node") < 0) | (F.col("node") >= graph.num_nodes)
    given = seeds.agg(F.count("*").alias("n"), F.count_if(beyond).alias("bad"), F.max(F.when(beyond, F.col("node"))).alias("node"), F.count_if(timed).alias("timed")).head()
    if given["bad"]:
        raise ValueError(f"seed {given['node']} is not in 0..{graph.num_nodes - 1}")
    if given["timed"]:
        raise ValueError("times are given, but no temporal strategy")
    times = ["bound"] if config.temporal else []
    seeds = seeds.withColumn("block", F.col("pos") if config.disjoint else F.lit(0)).withColumns({c: F.col(c).cast("bigint") for c in ("batch", "block", "pos", "node")})
    if config.temporal:
        # of a seed's times the earliest counts; no time is no bound, and later than any
        seeds = seeds.withColumn("bound", F.col("time").cast("double") if "time" in seeds.columns else F.lit(None).cast("double"))
    earliest = F.min(F.coalesce("bound", F.lit(float("inf")))) if config.temporal else None
    firsts = seeds.groupBy(*GROUP, "node").agg(F.min("pos").alias("at"), *([earliest.alias("bound")] if config.temporal else []))
    local = F.row_number().over(Window.partitionBy(*GROUP).orderBy("at")).cast("bigint") - 1
    nodes = firsts.select(*GROUP, local.alias("local"), "node", F.lit(0).cast("bigint").alias("hop"), *times).persist()
    held = [nodes]
    # n, total: rows of the frontier and of all nodes, at most; counted only where the bound is too large to broadcast
    frontier, drawn, n = nodes, None, given["n"]
    total = n
    for hop in range(1, len(config.fanout) + 1):
        found = draw(frontier, graph, config, hop, n)
        if config.cumulative and drawn is not None:
            found = found.join(drawn.select(*GROUP, "eid"), [*GROUP, "eid"], "left_anti")
        last = hop == len(config.fanout)
        if not last:
            found = found.persist()
            held.append(found)
        drawn = found if drawn is None else drawn.unionByName(found)
        # a node's place is that of its first discovery: by its discoverer, then by edge
        order = F.min(pair(F.col("parent"), F.col("eid"))).alias("ord")
        new = found.groupBy(*GROUP, F.col("dst").alias("node")).agg(order, *([F.min("ts").alias("bound")] if config.temporal else []))
        fresh = new.join(_hint(nodes.select(*GROUP, "node"), total), [*GROUP, "node"], "left_anti")
        seen = nodes.groupBy(*GROUP).agg(F.count("*").alias("seen"))
        rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy("ord")).cast("bigint") - 1
        fresh = fresh.withColumn("rank", rank).join(seen, GROUP).select(*GROUP, (F.col("seen") + F.col("rank")).alias("local"), "node", F.lit(hop).cast("bigint").alias("hop"), *times)
        if config.cumulative and config.temporal:
            lower = new.select(*GROUP, "node", F.col("bound").alias("other"))
            nodes = nodes.join(lower, [*GROUP, "node"], "left").withColumn("bound", F.least("bound", F.coalesce("other", "bound"))).select(*GROUP, "local", "node", "hop", "bound")
        fresh = fresh.persist()
        held.append(fresh)
        nodes = nodes.unionByName(fresh)
        k = config.fanout[hop - 1]
        n = n * k if 0 <= k and n * k <= BROADCAST_ROWS else 0 if last else fresh.count()
        total += n
        frontier, n = (nodes, total) if config.cumulative else (fresh, n)
    edges, located = drawn.select(*GROUP, "hop", "src", "dst", "eid"), None
    if config.subgraph == "induced":
        edges = induced(graph, nodes, bool(config.temporal))
    elif config.subgraph == "bidirectional":
        edges = edges.unionByName(missing_reverses(edges))
    else:
        located = drawn.select(*GROUP, "hop", "src", "dst", "eid", F.col("parent").alias("src_local"))
    return Sample(nodes.select(*GROUP, "local", "node", "hop"), edges, seeds.select(*GROUP, "pos", "node"), tuple(held), located)


def induced(graph: Graph, nodes: DataFrame, temporal: bool = False) -> DataFrame:
    """Every stored edge between sampled nodes of a group; hop is 0. A temporal bound holds at the source.

    Edges are dealt into stretches by eid, and the nodes of a group are sent to each stretch that has a row of one of them. There
    the rows are read against the group's nodes, so that no edge is shuffled for a group it isn't in."""
    lists, rows = graph.adjacency(), graph.row_index()
    m = rows.agg(F.sum("degree").alias("m")).head()["m"] or 0
    spark = nodes.sparkSession
    wide = max(1, -(-m // max(2 * spark.sparkContext.defaultParallelism, -(-m // STRETCH))))
    kind = "int" if max(graph.num_nodes, graph.num_dst) < 1 << 31 else "bigint"
    homes = nodes.join(rows, F.col("node") == F.col("src"), "left")
    stretches = F.when(F.col("start").isNotNull(), F.sequence(F.expr(f"start div {wide}"), F.expr(f"(start + degree - 1) div {wide}")))
    bound = [F.coalesce("bound", F.lit(float("inf"))).alias("bound")] if temporal else []
    groups = homes.groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct(F.col("node").cast(kind).alias("node"), *bound))).alias("m"), F.array_distinct(F.flatten(F.collect_list(stretches))).alias("at"))
    none = lambda *names: [F.lit(None).cast(t).alias(c) for c, t in names]
    nums, times = f"array<{kind}>", "array<double>"
    sets = groups.select(F.explode("at").alias("stretch"), *GROUP, F.col("m.node").alias("nodes"), F.col("m.bound").alias("times") if temporal else none(("times", times))[0], *none(("src", "bigint"), ("eid", "bigint")))
    dealt = lists.select(F.expr(f"(start + first) div {wide}").alias("stretch"), *none(("batch", "bigint"), ("block", "bigint")), F.col("dst").cast(nums).alias("nodes"), F.col("ts").cast(times).alias("times") if temporal else none(("times", times))[0], "src", (F.col("start") + F.col("first")).alias("eid"))
    found = dealt.unionByName(sets).groupBy("stretch").applyInArrow(_within, "batch bigint, block bigint, src bigint, dst bigint, eid bigint")
    return found.select(*GROUP, F.lit(0).cast("bigint").alias("hop"), "src", "dst", "eid")


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one stretch: lists (src, eid of the first edge, nodes they lead to, times) and groups' nodes (with bounds), in any order."""
    parts, groups = [], []
    flat = lambda column: column.flatten().to_numpy(zero_copy_only=False)
    for b in batches:
        row = {c: b.column(i) for i, c in enumerate(b.schema.names)}
        own = pc.is_valid(row["src"])
        for keep, to in ((own, parts), (pc.invert(own), groups)):
            one = {c: v.filter(keep) for c, v in row.items()}
            if len(one["src"]):
                to.append((one, pc.list_value_length(one["nodes"]).to_numpy(zero_copy_only=False).astype(np.int64)))
    if not parts or not groups:
        return
    src, eid, size = (np.concatenate(x) for x in zip(*[(p["src"].to_numpy(), p["eid"].to_numpy(), n) for p, n in parts], strict=True))
    dst = np.concatenate([flat(p["nodes"]) for p, _ in parts])
    ts = np.concatenate([flat(p["times"]) for p, _ in parts]) if parts[0][0]["times"].null_count == 0 else None
    del parts
    begin = np.cumsum(size) - size
    order = np.argsort(src, kind="stable")
    ranked = src[order]
    out, rows = [], 0
    for one, n in groups:
        nodes, ends = flat(one["nodes"]), np.cumsum(n)
        bounds = flat(one["times"]) if ts is not None else None
        for j, (batch, block) in enumerate(zip(one["batch"].to_pylist(), one["block"].to_pylist(), strict=True)):
            mine = nodes[ends[j] - n[j] : ends[j]]
            # the lists of the group's nodes
            low, high = np.searchsorted(ranked, mine, "left"), np.searchsorted(ranked, mine, "right")
            many = high - low
            at = order[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())]
            length = size[at]
            step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            edge = np.repeat(begin[at], length) + step
            to = dst[edge]
            spot = np.searchsorted(mine, to)
            spot[spot == len(mine)] = 0
            fine = mine[spot] == to
            if ts is not None:
                upper = bounds[ends[j] - n[j] : ends[j]]
                fine &= ts[edge] < np.repeat(np.repeat(upper, many), length)
            whose = np.repeat(at, length)[fine]
            made = len(whose)
            out.append((np.full(made, batch), np.full(made, block), src[whose], to[fine].astype(np.int64), eid[whose] + step[fine]))
            rows += made
            if rows >= 200_000:
                yield _edges(out)
                out, rows = [], 0
    if rows:
        yield _edges(out)


def _edges(parts: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True)], ["batch", "block", "src", "dst", "eid"])


def missing_reverses(edges: DataFrame) -> DataFrame:
    """For each ordered pair without its reverse, the reverse under the first edge's id; loops gain nothing."""
    pairs = edges.where("src != dst").groupBy(*GROUP, "src", "dst").agg(F.min("eid").alias("eid"), F.min("hop").alias("hop"))
    turned = pairs.select(*GROUP, "hop", F.col("dst").alias("src"), F.col("src").alias("dst"), "eid")
    return turned.join(edges.select(*GROUP, "src", "dst").distinct(), [*GROUP, "src", "dst"], "left_anti").select(*GROUP, "hop", "src", "dst", "eid")


def node_frequencies(sampled: Sample) -> DataFrame:
    """node, num_batches: in how many batches' samples it occurs."""
    return sampled.nodes.groupBy("node").agg(F.count_distinct("batch").cast("bigint").alias("num_batches"))
