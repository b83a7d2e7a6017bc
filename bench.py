"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

queries: seconds of each query, its result counted. Samples are drawn from a graph that is built once, as in the throughput
they are held against: build_s has the builds. The samples timed under queries take every 20th part (batches of 16) and every
10th customer (batches of 8) as seeds, in every round alike; whole_s has the registered queries, whose seeds are all parts and
all customers; throughput has all parts in batches of 128, fanout 15 and 10.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("csr_edges", "degrees", "degree_percentiles", "transpose", "permute_reverse", "sample_uniform_1hop", "sample_uniform_2hop", "sample_weighted", "sample_replace", "sample_temporal_last", "sample_induced", "local_edge_index", "hetero_2hop", "batches_shuffled", "dyn_insert", "int8_encode", "delta_lengths")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from pyspark.sql import functions as F

    from hopweave.operators import hetero, sampling
    from hopweave.operators.sampling import Config
    from hopweave.plans import queries as q
    from hopweave.sources.tables import table

    shift = table(spark, SF_DIR, "customer").count()
    at, start = F.floor(F.col("p_partkey") / 20), F.unix_micros(F.lit("1996-06-01 00:00:00").cast("timestamp")).cast("double")
    parts = table(spark, SF_DIR, "part").where("p_partkey % 20 = 0").select(F.floor(at / 16).alias("batch"), (at % 16).alias("pos"), F.col("p_partkey").alias("node"), (start + at * 1_000_000).alias("time"))
    traded = parts.withColumn("node", F.col("node") + shift)
    buyer = F.floor(F.col("c_custkey") / 10)
    buyers = table(spark, SF_DIR, "customer").where("c_custkey % 10 = 0").select(F.floor(buyer / 8).alias("batch"), (buyer % 8).alias("pos"), F.col("c_custkey").alias("node"))
    configs = {
        "sample_uniform_2hop": Config((4, 3)), "sample_weighted": Config((4, 3), weighted=True), "sample_replace": Config((6, 2), replace=True),
        "sample_temporal_last": Config((4, 3), temporal="last"), "sample_induced": Config((4, 3), subgraph="induced"), "local_edge_index": Config((4, 3)),
    }

    def run(name: str):
        if name == "sample_uniform_1hop":
            return sampling.sample(q.part_supp(spark, SF_DIR), parts.drop("time"), Config((5,))).edges
        if name == "hetero_2hop":
            return hetero.sample(q.shop(spark, SF_DIR), "customer", buyers, q._SHOP_FANOUT).edges
        if name in configs:
            drawn = sampling.sample(q.trade(spark, SF_DIR), traded if configs[name].temporal else traded.drop("time"), configs[name])
            return drawn.edge_index() if name == "local_edge_index" else drawn.edges
        return q.QUERIES[name](spark, SF_DIR)

    build, seconds = {}, {}
    for name, make in (("part_supp", q.part_supp), ("trade", q.trade), ("shop", q.shop)):
        t = time.time()
        make(spark, SF_DIR).edges.count()
        build[name] = round(time.time() - t, 3)
    for name in HEADLINE:
        t = time.time()
        run(name).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - t, 3)
    whole = {}
    for name in ("sample_uniform_2hop", "sample_weighted", "hetero_2hop"):
        t = time.time()
        q.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        whole[name] = round(time.time() - t, 3)
    # throughput of many batches in one job: every part a seed, fanout 15 and 10, batches of 128
    seeds = table(spark, SF_DIR, "part").select(F.floor(F.col("p_partkey") / 128).alias("batch"), (F.col("p_partkey") % 128).alias("pos"), (F.col("p_partkey") + shift).alias("node")).persist()
    n_batches, t = seeds.select("batch").distinct().count(), time.time()
    n_edges = sampling.sample(q.trade(spark, SF_DIR), seeds, sampling.Config((15, 10))).edges.count()
    took = time.time() - t
    rates = {"batches": n_batches, "sampled_edges": n_edges, "sec": round(took, 3), "ms_per_batch": round(1000 * took / max(1, n_batches), 3), "edges_per_sec": round(n_edges / took)}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")), "build_s": build, "whole_s": whole, "throughput": rates}))


if __name__ == "__main__":
    main()
