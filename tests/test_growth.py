"""What is shuffled follows the edges and nodes, not a group's rows times its edges; results against plain Python."""

import math
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from hopweave import graph as graphs
from hopweave.graph import from_edges, validation
from hopweave.operators import hetero, reorder, sampling, structure
from hopweave.operators.sampling import Config


def shuffled(spark, run):
    """What run() returns, and the rows that its stages shuffled."""
    context = spark.sparkContext
    store = context._jsc.sc().statusStore()

    def rows():
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = rows()
    got = run()
    return got, sum(n for k, n in rows().items() if k not in before)


def test_validation_counts_eids_by_words(spark):
    edges = spark.range(20_000).select((F.col("id") % 90).alias("src"), (F.col("id") % 101).alias("dst"), F.when(F.col("id") == 77, 5).otherwise(F.col("id")).alias("eid"))
    row, n = shuffled(spark, lambda: validation(graphs.Graph(spark.range(100), edges, 100, 100)).head())
    assert (row["num_edges"], row["bad_src"], row["bad_dst"], row["nulls"], row["repeated_eids"], row["eid_gaps"]) == (20_000, 0, 198, 0, 1, 0)
    assert n < 2_000


@pytest.fixture
def large(spark):
    """Joins as of tables that are too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def hubs(spark, n=300, hubs=10):
    """Each node to each hub and back, of unlike weights, some of them 0."""
    raw = spark.range(n * hubs).select((F.col("id") % n + hubs).alias("a"), (F.col("id") % hubs).alias("b"), "id")
    both = raw.select(F.col("a").alias("src"), F.col("b").alias("dst"), "id").unionByName(raw.select(F.col("b").alias("src"), F.col("a").alias("dst"), (F.col("id") + n * hubs).alias("id")))
    return from_edges(both.select("src", "dst", (F.col("id") * 7 % 11).cast("double").alias("weight"), (F.col("id") % 97).cast("double").alias("ts"), "id"), n + hubs, ["id"])


def test_reversed_rows_move_without_a_shuffle(spark):
    g = hubs(spark).settle()
    order = g.nodes.select("id", (F.lit(g.num_nodes - 1) - F.col("id")).alias("old"))
    want = sorted(map(tuple, structure.permute(g, order).edges.select("src", "dst", "eid", "weight", "ts").collect()))
    turned = structure.reversed_ids(g)
    got, n = shuffled(spark, lambda: turned.edges.select("src", "dst", "eid", "weight", "ts").collect())
    assert sorted(map(tuple, got)) == want and len(want) == 6000 and n == 0


def test_induced_edges_are_read_where_they_are(spark, large, monkeypatch):
    monkeypatch.setattr(sampling, "BROADCAST_ROWS", 0)
    g = hubs(spark).settle()
    nodes = spark.range(40 * 60).select((F.col("id") % 40).alias("batch"), F.lit(0).cast("bigint").alias("block"), (F.when(F.col("id") < 400, F.col("id") / 40).otherwise(F.col("id") * 13 % 300 + 10)).cast("bigint").alias("node")).distinct()
    stored, groups = [(r["src"], r["dst"], r["eid"]) for r in g.edges.collect()], {}
    for r in nodes.collect():
        groups.setdefault(r["batch"], set()).add(r["node"])
    want = sorted((b, s, d, e) for b, of in groups.items() for s, d, e in stored if s in of and d in of)
    got, n = shuffled(spark, lambda: sampling.induced(g, nodes).select("batch", "src", "dst", "eid").collect())
    assert sorted(map(tuple, got)) == want and len(want) == 12_000
    assert n < 10_000


def drawn(seed, batch, hop, src, *parts):
    return md5("|".join(map(str, (seed, batch, 0, hop, src, *parts))).encode()).hexdigest()


@pytest.mark.parametrize("longest", [65_536, 64])
def test_weighted_rows_are_cut_where_they_are(spark, large, monkeypatch, longest):
    monkeypatch.setattr(graphs, "LIST", longest)
    monkeypatch.setattr(sampling, "LIST", longest, raising=False)
    monkeypatch.setattr(sampling, "BROADCAST_ROWS", 0)
    g = hubs(spark, 2000).settle()
    seeds = spark.range(4 * 100).select((F.col("id") % 4).alias("batch"), F.floor(F.col("id") / 4).alias("pos"), F.floor(F.col("id") / 4).alias("node"))
    rows = {}
    for r in g.edges.collect():
        rows.setdefault(r["src"], []).append((r["eid"], r["weight"]))
    rank = lambda b, s, e, w: (-math.log((int(drawn(42, b, 1, s, e)[:13], 16) + 1) / (1 << 52)) / w if w > 0 else math.inf, drawn(42, b, 1, s, e), e)
    want = sorted((b, s, e) for b in range(4) for s in range(100) for _, _, e in sorted(rank(b, s, e, w) for e, w in rows[s])[:3])
    edges = sampling.sample(g, seeds, Config((3,), weighted=True)).edges
    got, n = shuffled(spark, lambda: edges.select("batch", "src", "eid").collect())
    assert sorted(map(tuple, got)) == want
    assert n < 10_000  # the graph has 40,000 edges


def merged(n, edges):
    """Rabbit communities by plain dictionaries."""
    links, strength, owner, children = [{} for _ in range(n)], [0] * n, list(range(n)), [[] for _ in range(n)]
    for a, b in edges:
        if a != b:
            for x, y in ((a, b), (b, a)):
                strength[x] += 1
                links[x][y] = links[x].get(y, 0) + 1
    total = sum(strength)

    def top(x):
        return x if owner[x] == x else top(owner[x])

    for v in sorted(range(n), key=lambda x: (strength[x], x)):
        near = {}
        for u, w in links[v].items():
            if (t := top(u)) != v:
                near[t] = near.get(t, 0) + w
        gains = [(near[t] * total - strength[v] * strength[t], -t) for t in near]
        if gains and max(gains)[0] > 0:
            best = -max(gains)[1]
            owner[v] = best
            children[best].append(v)
            strength[best] += strength[v]
            for t, w in near.items():
                if t != best:
                    links[best][t] = links[best].get(t, 0) + w
    perm, numbers = [], {}
    part = [numbers.setdefault(top(v), len(numbers)) for v in range(n)]
    for root in (v for v in range(n) if owner[v] == v):
        stack = [root]
        while stack:
            perm.append(v := stack.pop())
            stack += children[v]
    return [(i, old, part[old]) for i, old in enumerate(perm)]


@pytest.mark.parametrize("n, m", [(40, 70), (120, 150), (200, 2000)])
def test_communities_equal_plain_ones(spark, n, m):
    pairs = [(int(md5(f"{n}a{i}".encode()).hexdigest(), 16) % n, int(md5(f"{n}b{i}".encode()).hexdigest(), 16) ** 2 % n) for i in range(m)]
    g = from_edges(spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "src bigint, dst bigint, i bigint"), n, ["i"])
    assert sorted(map(tuple, reorder.rabbit(g).collect())) == merged(n, pairs)


def test_communities_hold_few_bytes_for_an_edge():
    import tracemalloc

    import numpy as np

    n, per = 20_000, 50
    def near():
        for v in range(n):
            yield v, ((v + 1 + np.arange(per) ** 2) % n).astype(np.int32)
            yield v, ((v - 1 - np.arange(per) ** 2) % n).astype(np.int32)

    tracemalloc.start()
    perm, _ = reorder.communities(n, near())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(perm) == list(range(n)) and most < n * per * 40


def votes(spark, n=2000, per=20):
    likes = spark.range(n * per).select((F.col("id") % n).alias("src"), F.floor(F.col("id") / n).alias("dst"))
    return hetero.from_tables({"user": n, "post": per}, {("user", "likes", "post"): likes, ("post", "liked_by", "user"): likes.select(F.col("dst").alias("src"), F.col("src").alias("dst"))}, {("user", "likes", "post"): ["dst"], ("post", "liked_by", "user"): ["dst"]})


def test_typed_edges_are_counted_without_a_graph(spark):
    got, n = shuffled(spark, lambda: votes(spark).edge_counts().collect())
    assert {tuple(r) for r in got} == {("user", "likes", "post", 40_000), ("post", "liked_by", "user", 40_000)} and n < 1_000


def test_typed_draws_leave_edges_where_they_are(spark, large, monkeypatch):
    monkeypatch.setattr(hetero, "BROADCAST_ROWS", 0)
    g = votes(spark).persist()
    seeds = spark.range(20).select(F.floor(F.col("id") / 5).alias("batch"), (F.col("id") % 5).alias("pos"), F.col("id").alias("node"))
    s = hetero.sample(g, "user", seeds, {("post", "liked_by", "user"): [3, 2], ("user", "likes", "post"): [3, 3]})
    got, n = shuffled(spark, lambda: s.edges.collect())
    stored = {tuple(r) for r in g.edges.select("rel", "src", "dst", "eid").collect()}
    assert {(r["rel"], r["src"], r["dst"], r["eid"]) for r in got} <= stored and len(stored) == 80_000
    assert sum(r["hop"] == 1 for r in got) == 60 and n < 10_000
