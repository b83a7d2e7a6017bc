from hopweave.operators import dynamic
from hopweave.streaming import ingest


def test_ingest_dedups_counts_and_survives_a_restart(spark, tmp_path):
    source, log, mark = (str(tmp_path / x) for x in ("in", "log", "mark"))
    batches = [[(0, 1), (0, 1), (1, 2), (9, 0)], [(0, 1), (2, 3)], [(3, 4)]]
    said = []

    def feed(i):
        spark.createDataFrame(batches[i], "src bigint, dst bigint").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema("src bigint, dst bigint").option("maxFilesPerTrigger", 1).parquet(source)
        query = ingest.ingest(stream, log, mark, 5, {"availableNow": True}, said.append)
        assert query.awaitTermination(120) and query.exception() is None

    feed(0)
    run()
    feed(1)
    run()  # a new query on the same checkpoint goes on where the first one ended
    feed(2)
    run()
    assert [(s["received"], s["inserted"], s["duplicates"], s["errors"]) for s in said] == [(4, 2, 1, 1), (2, 1, 1, 0), (1, 1, 0, 0)]
    rows = ingest.read_log(spark, log)
    assert {tuple(r) for r in rows.collect()} == {(0, 1, 1), (1, 2, 1), (2, 3, 2), (3, 4, 3)}
    assert {tuple(r) for r in dynamic.snapshot(rows, 2).collect()} == {(0, 1), (1, 2), (2, 3)}


def test_absent_log_is_empty_and_last_update_wins(spark, tmp_path):
    assert ingest.read_log(spark, str(tmp_path / "none")).count() == 0
    updates = spark.createDataFrame([(1, 1, [1.0]), (1, 2, [2.0]), (2, 1, [3.0])], "id bigint, version bigint, x array<double>")
    assert {(r["id"], r["x"][0]) for r in ingest.latest_features(updates).collect()} == {(1, 2.0), (2, 3.0)}
