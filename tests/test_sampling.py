import pytest

from hopweave.graph import from_edges
from hopweave.operators import hetero, loading, sampling
from hopweave.operators.sampling import Config

SAMPLER5 = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (2, 4), (3, 4)]


def graph(spark, edges, n):
    """edges: (src, dst[, ts[, weight]])."""
    data = [(e[0], e[1], float(e[2]) if len(e) > 2 else float(i + 1), float(e[3]) if len(e) > 3 else 1.0, i) for i, e in enumerate(edges)]
    return from_edges(spark.createDataFrame(data, "src bigint, dst bigint, ts double, weight float, pos bigint"), n, ["pos"])


def seeds(spark, nodes, times=None):
    return spark.createDataFrame([(0, i, v, times[i] if times else None) for i, v in enumerate(nodes)], "batch bigint, pos bigint, node bigint, time double")


def ring(spark):
    return graph(spark, [(i, (i + 7 * j) % 200) for i in range(200) for j in range(1, 7)], 200)


def nodes(sample):
    return [r["node"] for r in sample.nodes.orderBy("block", "local").collect()]


def edges(sample):
    return sorted((r["src"], r["dst"]) for r in sample.edges.collect())


def test_take_all_in_discovery_order(spark):
    s = sampling.sample(graph(spark, SAMPLER5, 5), seeds(spark, [0]), Config((-1, -1)))
    assert nodes(s) == [0, 1, 2, 3, 4]
    assert [(r["hop"], r["num_nodes"], r["num_edges"]) for r in s.counts().orderBy("hop").collect()] == [(0, 1, 0), (1, 3, 3), (2, 1, 5)]


def test_draws_are_distinct_bounded_and_repeatable(spark):
    g, config = ring(spark), Config((3, 2))
    s = sampling.sample(g, seeds(spark, [0, 50]), config)
    got = s.edges.collect()
    assert len({r["eid"] for r in got}) == len(got)
    per = {}
    for r in got:
        assert (r["dst"] - r["src"]) % 200 in {7 * j for j in range(1, 7)}
        per.setdefault((r["hop"], r["src"]), []).append(r["dst"])
    assert all(len(v) == (3, 2)[hop - 1] for (hop, _), v in per.items())
    assert edges(sampling.sample(g, seeds(spark, [0, 50]), config)) == edges(s)
    assert edges(sampling.sample(g, seeds(spark, [0, 50]), Config((3, 2), seed=1))) != edges(s)


def test_equal_batches_draw_apart(spark):
    both = spark.createDataFrame([(0, 0, 5), (1, 0, 5)], "batch bigint, pos bigint, node bigint")
    got = sampling.sample(ring(spark), both, Config((2, 2))).edges.collect()
    assert {r["dst"] for r in got if r["batch"] == 0} != {r["dst"] for r in got if r["batch"] == 1}


def test_replacement_draws_exactly_k(spark):
    g = graph(spark, SAMPLER5, 5)
    assert sampling.sample(g, seeds(spark, [3, 4]), Config((4,), replace=True)).edges.count() == 4
    assert sampling.sample(g, seeds(spark, [3]), Config((4,), replace=True, weighted=True)).edges.count() == 4


def test_weights(spark):
    heavy = graph(spark, [(0, i, 0.0, 1e9 if i == 3 else 1e-9) for i in range(1, 6)], 6)
    assert edges(sampling.sample(heavy, seeds(spark, [0]), Config((1,), weighted=True))) == [(0, 3)]
    zero = graph(spark, [(0, i, 0.0, 0.0) for i in range(1, 4)], 4)
    assert sampling.sample(zero, seeds(spark, [0]), Config((5,), weighted=True)).edges.count() == 3
    # with replacement and no weight at all, every draw lands on the last neighbor
    assert edges(sampling.sample(zero, seeds(spark, [0]), Config((3,), weighted=True, replace=True))) == [(0, 3)] * 3
    some = graph(spark, [(0, 1, 0.0, 0.0), (0, 2, 0.0, 1.0), (0, 3, 0.0, 1.0)], 4)
    assert edges(sampling.sample(some, seeds(spark, [0]), Config((2,), weighted=True))) == [(0, 2), (0, 3)]


def test_hub_cap(spark):
    hub = graph(spark, [(0, i) for i in range(1, 50)], 50)
    assert sampling.sample(hub, seeds(spark, [0]), Config((10,), weighted=True, max_degree=4)).edges.count() == 4
    assert sampling.sample(hub, seeds(spark, [0]), Config((10,), max_degree=4)).edges.count() == 10


@pytest.mark.parametrize(("strategy", "k", "time", "found"), [("uniform", 5, 2.5, {1, 2}), ("last", 2, 3.5, {2, 3}), ("last", 2, 0.5, set())])
def test_temporal_bound_is_strict(spark, strategy, k, time, found):
    s = sampling.sample(graph(spark, SAMPLER5, 5), seeds(spark, [0], [time]), Config((k,), temporal=strategy))
    assert {d for _, d in edges(s)} == found


def test_time_goes_down_the_path(spark):
    g = graph(spark, [(0, 1, 10), (0, 2, 20), (1, 3, 5), (1, 4, 15)], 5)
    got = nodes(sampling.sample(g, seeds(spark, [0], [25.0]), Config((10, 10), temporal="uniform")))
    assert 3 in got and 4 not in got


def test_no_time_is_no_bound(spark):
    g = graph(spark, [(0, 2, 1), (0, 3, 2), (1, 4, 100), (1, 5, 200)], 6)
    assert set(nodes(sampling.sample(g, seeds(spark, [0, 1]), Config((9,), temporal="uniform")))) == set(range(6))
    assert set(nodes(sampling.sample(g, seeds(spark, [0, 1], [1.5, 150.0]), Config((9,), temporal="uniform")))) == {0, 1, 2, 4}


def test_repeated_seeds(spark):
    g = graph(spark, SAMPLER5, 5)
    shared = sampling.sample(g, seeds(spark, [2, 2, 0]), Config((-1,)))
    assert [(r["pos"], r["local"]) for r in shared.seed_indices().orderBy("pos").collect()] == [(0, 0), (1, 0), (2, 1)]
    apart = sampling.sample(g, seeds(spark, [2, 2, 0]), Config((-1,), disjoint=True))
    assert sorted(r["block"] for r in apart.nodes.where("hop = 0").collect()) == [0, 1, 2]
    assert apart.edges.count() == 2 + 2 + 3
    early = sampling.sample(g, seeds(spark, [0, 0], [9.0, 1.5]), Config((9,), temporal="uniform"))
    assert edges(early) == [(0, 1)]


def test_cumulative_never_repeats_an_earlier_edge(spark):
    got = sampling.sample(ring(spark), seeds(spark, [0]), Config((2, 2, 2), cumulative=True)).edges.collect()
    assert len({r["eid"] for r in got}) == len(got) and {r["src"] for r in got if r["hop"] == 2} >= {0}


def test_induced_and_bidirectional(spark):
    g = graph(spark, [*SAMPLER5, (0, 1), (1, 0)], 5)
    inside = sampling.sample(g, seeds(spark, [0]), Config((-1,), subgraph="induced"))
    assert edges(inside) == sorted((s, d) for s, d in [*SAMPLER5, (0, 1), (1, 0)] if d != 4)
    both = sampling.sample(g, seeds(spark, [0]), Config((-1,), subgraph="bidirectional"))
    assert edges(both) == sorted([(0, 1), (0, 1), (0, 2), (0, 3), (1, 0), (2, 0), (3, 0)])


def test_local_edges_read_neighbor_to_expanded(spark):
    s = sampling.sample(graph(spark, SAMPLER5, 5), seeds(spark, [0]), Config((-1,)))
    assert sorted((r["edge_index_0"], r["edge_index_1"]) for r in s.edge_index().collect()) == [(1, 0), (2, 0), (3, 0)]
    assert s.arrow_tables()["nodes"].column("nodes").to_pylist() == [0, 1, 2, 3]


def test_seeds_and_times_are_checked(spark):
    g = graph(spark, SAMPLER5, 5)
    for bad in (99, -1, 5, None):
        with pytest.raises(ValueError, match=r"not in 0\.\.4"):
            sampling.sample(g, seeds(spark, [0, bad]), Config((2,)))
    with pytest.raises(ValueError, match="no temporal strategy"):
        sampling.sample(g, seeds(spark, [0], [1.0]), Config((2,)))


@pytest.mark.parametrize("config", [Config((3, 2)), Config((2, 2), weighted=True, max_degree=4), Config((2,), weighted=True, replace=True, subgraph="induced")])
def test_broadcast_and_shuffled_frontiers_draw_alike(spark, monkeypatch, config):
    g, at = ring(spark), spark.createDataFrame([(b, i, 31 * b + 7 * i) for b in range(4) for i in range(5)], "batch bigint, pos bigint, node bigint")
    all_rows = lambda s: (sorted(map(tuple, s.edges.collect())), sorted(map(tuple, s.nodes.collect())))
    want = all_rows(sampling.sample(g, at, config))
    monkeypatch.setattr(sampling, "BROADCAST_ROWS", 0)
    assert all_rows(sampling.sample(g.settle().persist(), at, config)) == want


def test_to_dict(spark):
    got = sampling.sample(graph(spark, SAMPLER5, 5), seeds(spark, [3, 0]), Config((-1, -1))).to_dict()
    assert got["nodes"][:2] == [3, 0] and got["seeds"] == [0, 1] and got["num_nodes"] == [2, 3, 0] and got["num_edges"] == [4, 4]
    assert [got["nodes"][i] for i in got["src"][:1]] == [3] and sorted(got["edge_ids"]) == list(range(8))


@pytest.mark.parametrize("bad", [{"fanout": ()}, {"fanout": (-2,)}, {"fanout": (1,), "max_degree": 0}, {"fanout": (1,), "subgraph": "x"}, {"fanout": (1,), "temporal": "x"}])
def test_bad_configs(bad):
    with pytest.raises(ValueError, match="."):
        Config(**bad)


def test_batch_rows(spark):
    g = graph(spark, SAMPLER5, 5)
    x = spark.range(5).selectExpr("id", "array(float(id), float(id) * 2) as x")
    y = spark.range(5).selectExpr("id", "int(id) as label")
    row = loading.batch_rows(sampling.sample(g, seeds(spark, [0, 4]), Config((-1,))), x, y).head()
    assert row["n_id"] == [0, 4, 1, 2, 3] and row["batch_size"] == 2 and row["y"] == [0, 4, 1, 2, 3]
    assert row["x"][:4] == [0.0, 0.0, 4.0, 8.0] and (row["x_shape_0"], row["x_shape_1"]) == (5, 2)
    assert list(zip(row["edge_index_0"], row["edge_index_1"], row["e_id"], strict=True)) == [(2, 0, 0), (3, 0, 1), (4, 0, 2)]


def test_node_frequencies(spark):
    two = spark.createDataFrame([(0, 0, 0), (1, 0, 3)], "batch bigint, pos bigint, node bigint")
    got = {r["node"]: r["num_batches"] for r in sampling.node_frequencies(sampling.sample(graph(spark, SAMPLER5, 5), two, Config((-1,)))).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2, 4: 1}


def shop(spark):
    votes = spark.createDataFrame([(u, p) for u in range(6) for p in range(3)], "src bigint, dst bigint")
    holds = spark.createDataFrame([(p, p % 2) for p in range(3)], "src bigint, dst bigint")
    tables = {("user", "votes", "post"): votes, ("post", "in", "sub"): holds}
    return hetero.from_tables({"user": 6, "post": 3, "sub": 2}, tables, {t: ["dst"] for t in tables})


@pytest.mark.parametrize("replace", [False, True])
def test_hetero_follows_incoming_relations(spark, replace):
    g = shop(spark)
    hetero.validate(g)
    s = hetero.sample(g, "sub", seeds(spark, [0]).drop("time"), {("post", "in", "sub"): [5, 5], ("user", "votes", "post"): [2, 2]}, replace=replace)
    got = s.edges.collect()
    first = [r for r in got if r["hop"] == 1]
    assert {r["rel"] for r in first} == {"in"} and {r["src"] for r in first} <= {0, 2} and len(first) == (5 if replace else 2)
    posts = {r["src"] for r in first}
    assert sum(r["rel"] == "votes" for r in got) == 2 * len(posts)
    assert s.local_edges().count() == len(got)


def test_hetero_metadata_and_empty_types(spark):
    g = shop(spark)
    assert (g.total_nodes, g.total_edges(), g.type_id("post"), g.type_id(("post", "in", "sub"))) == (11, 21, 1, 1)
    assert sorted(tuple(r) for r in g.in_adjacency(("post", "in", "sub")).collect()) == [(0, 0, 0, 0), (0, 1, 2, 2), (1, 0, 1, 1)]
    both = spark.createDataFrame([(0, 0, 1), (0, 1, 0), (0, 2, 1), (1, 0, 0)], "batch bigint, pos bigint, node bigint")
    s = hetero.sample(g, "sub", both, {("post", "in", "sub"): [1]})
    assert sorted(tuple(r) for r in s.seed_indices().select("batch", "pos", "local").collect()) == [(0, 0, 0), (0, 1, 1), (0, 2, 0), (1, 0, 0)]
    assert sorted(tuple(r) for r in s.counts().collect()) == [(0, "post", 2), (0, "sub", 2), (0, "user", 0), (1, "post", 1), (1, "sub", 1), (1, "user", 0)]
    assert sorted(tuple(r) for r in hetero.from_edge_indices(spark, {"a": 2, "b": 3}, {("a", "to", "b"): ([1, 0, 1], [2, 2, 0])}).edges.select("src", "dst", "eid", "place").collect()) == [(0, 2, 0, 0), (1, 0, 2, 0), (1, 2, 1, 1)]


def test_hetero_ends_are_checked(spark):
    bad = spark.createDataFrame([(0, 0), (1, 9)], "src bigint, dst bigint")
    with pytest.raises(Exception, match=r"dst 9 isn't in 0\.\.2"):
        hetero.from_tables({"a": 2, "b": 3}, {("a", "to", "b"): bad}, {("a", "to", "b"): ["dst"]})
    with pytest.raises(ValueError, match=r"not in 0\.\.1"):
        hetero.sample(shop(spark), "sub", seeds(spark, [0, 2]), {("post", "in", "sub"): [1]})


def test_hetero_errors(spark):
    g = shop(spark)
    with pytest.raises(ValueError, match="unknown edge type"):
        hetero.sample(g, "sub", seeds(spark, [0]), {("a", "b", "c"): [1]})
    with pytest.raises(ValueError, match="same number of hops"):
        hetero.sample(g, "sub", seeds(spark, [0]), {("post", "in", "sub"): [1], ("user", "votes", "post"): [1, 1]})
    assert {tuple(r) for r in g.edge_counts().collect()} == {("user", "votes", "post", 18), ("post", "in", "sub", 3)}
