"""Live edges: a streaming query that grows the edge log by one epoch per micro-batch.

The log is Parquet under `path`/epoch=N, a batch's edges under its own epoch, so a batch that runs again after a failure
overwrites what it wrote and nothing else; the query's checkpoint takes the place of a write-ahead log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hopweave.operators.dynamic import SCHEMA, checked, insert


def read_log(spark: SparkSession, path: str, below: int | None = None) -> DataFrame:
    """The committed edges of epochs under `below`; an absent log is empty."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where) or not [s for s in fs.listStatus(where) if s.getPath().getName().startswith("epoch=")]:
        return spark.createDataFrame([], SCHEMA)
    log = spark.read.schema("src bigint, dst bigint").option("basePath", path).parquet(f"{path}/epoch=*")
    log = log.select("src", "dst", F.col("epoch").cast("bigint").alias("epoch"))
    return log if below is None else log.where(F.col("epoch") < below)


def ingest(edges: DataFrame, path: str, checkpoint: str, num_nodes: int, trigger: dict | None = None, on_commit=None) -> StreamingQuery:
    """edges: a streaming frame with src and dst. Out-of-range edges are counted and left out, duplicates ignored. on_commit gets
    a dict of epoch, received, inserted, duplicates and errors after each commit."""

    def commit(batch: DataFrame, batch_id: int) -> None:
        spark, epoch = batch.sparkSession, batch_id + 1
        rows = checked(batch.select("src", "dst"), num_nodes).persist()
        new = insert(read_log(spark, path, epoch), rows.where("ok"), epoch)
        target = f"{path}/epoch={epoch}"
        new.select("src", "dst").write.mode("overwrite").parquet(target)
        if on_commit:
            seen = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum((~F.col("ok")).cast("bigint")), F.lit(0)).alias("bad")).head()
            inserted = spark.read.schema("src bigint, dst bigint").parquet(target).count()
            on_commit({"epoch": epoch, "received": seen["n"], "inserted": inserted, "duplicates": seen["n"] - seen["bad"] - inserted, "errors": seen["bad"]})
        rows.unpersist()

    return edges.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "100 milliseconds"})).start()


def latest_features(updates: DataFrame) -> DataFrame:
    """A stream or table of (id, version, x) to the last x of each id; a node without an update isn't there."""
    return updates.groupBy("id").agg(F.max_by("x", "version").alias("x"), F.max("version").alias("version"))


def deduplicated(edges: DataFrame, event_time: str, late: str) -> DataFrame:
    """Bounds the state of deduplication by a watermark, for streams that have an event time."""
    return edges.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["src", "dst"])
