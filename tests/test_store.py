import pytest

from hopweave.graph import from_edges
from hopweave.operators import hetero
from hopweave.sources import store, tables


def test_graph_roundtrip_and_views(spark, tmp_path):
    raw = spark.createDataFrame([(0, 1, 0.5, 0), (0, 2, 1.5, 1), (2, 0, 1.0, 2)], "src bigint, dst bigint, weight double, pos bigint")
    g = from_edges(raw, 3, ["pos"])
    store.save_graph(g, str(tmp_path / "g"))
    back = store.load_graph(spark, str(tmp_path / "g"))
    assert sorted(back.edges.collect()) == sorted(g.edges.collect()) and back.has_weights and back.num_nodes == 3
    with pytest.raises(Exception, match="(?i)exists"):
        store.save_graph(g, str(tmp_path / "g"))
    store.register(back, "t")
    assert spark.sql("SELECT count(*) FROM t_nodes LEFT ANTI JOIN t_edges ON id = src").head()[0] == 1


def test_hetero_roundtrip(spark, tmp_path):
    raw = {("a", "r", "b"): spark.createDataFrame([(0, 1), (1, 0)], "src bigint, dst bigint"), ("b", "s", "a"): spark.createDataFrame([(1, 1)], "src bigint, dst bigint")}
    g = hetero.from_tables({"a": 2, "b": 2}, raw, {t: ["dst"] for t in raw})
    store.save_hetero(g, str(tmp_path / "h"))
    back = store.load_hetero(spark, str(tmp_path / "h"))
    assert back.counts == g.counts and back.types == g.types and sorted(back.edges.collect()) == sorted(g.edges.collect())


def test_feature_dtypes(spark, tmp_path):
    rows = spark.createDataFrame([(0, [0.1, -2.0]), (1, [0.0, 0.0])], "id bigint, x array<float>")
    for dtype, most in (("f32", 1e-9), ("f16", 1e-3), ("bf16", 1e-2), ("int8", 2e-2)):
        store.save_features(rows, str(tmp_path / dtype), dtype)
        got = {r["id"]: r["x"] for r in store.load_features(spark, str(tmp_path / dtype)).collect()}
        assert abs(got[0][0] - 0.1) <= most + 1e-8 and got[0][1] == -2.0 and got[1] == [0.0, 0.0]
    with pytest.raises(ValueError, match="dtype"):
        store.save_features(rows, str(tmp_path / "x"), "f8")


def test_parquet_edges_are_checked(spark, tmp_path):
    spark.createDataFrame([(0, 1, "x")], "a int, b bigint, c string").write.parquet(str(tmp_path / "e"))
    assert tables.edges_from_parquet(spark, str(tmp_path / "e"), "a", "b").dtypes == [("src", "bigint"), ("dst", "bigint")]
    with pytest.raises(ValueError, match="not an integer"):
        tables.edges_from_parquet(spark, str(tmp_path / "e"), "a", "c")
    spark.createDataFrame([(0, None)], "a int, b bigint").write.parquet(str(tmp_path / "n"))
    with pytest.raises(ValueError, match="null or out of range"):
        tables.edges_from_parquet(spark, str(tmp_path / "n"), "a", "b")
