"""convert, info and stats of graphs kept as Parquet: python -m hopweave.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from hopweave.graph import Graph, from_edges
from hopweave.operators import structure
from hopweave.sources.store import load_graph, save_graph
from hopweave.sources.tables import edge_list


def convert(spark: SparkSession, source: str, target: str, delimiter: str | None = None, skip_lines: int = 0, num_nodes: int | None = None, force: bool = False) -> Graph:
    rows = edge_list(spark, source, delimiter, skip_lines, num_nodes).persist()
    n = num_nodes if num_nodes is not None else (rows.agg(F.max(F.greatest("src", "dst"))).head()[0] or -1) + 1
    save_graph(from_edges(rows, n, ["line"]), target, force)
    return load_graph(spark, target)


def info(graph: Graph) -> dict:
    row = structure.stats(graph).head().asDict()
    return {k: row[k] for k in ("num_nodes", "num_edges", "avg_degree")} | {"has_weights": graph.has_weights}


def stats(graph: Graph) -> dict:
    row = structure.stats(graph).head().asDict()
    shares = structure.degree_percentiles(graph).head().asDict() if row["num_nodes"] else {}
    return row | shares | {"isolated_percent": 100 * row["isolated"] / row["num_nodes"] if row["num_nodes"] else 0.0, "has_weights": graph.has_weights}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="hopweave")
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("convert")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--delimiter")
    c.add_argument("--skip-lines", type=int, default=0)
    c.add_argument("--num-nodes", type=int)
    c.add_argument("--force", action="store_true")
    for name in ("info", "stats"):
        commands.add_parser(name).add_argument("path")
    given = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    try:
        if given.command == "convert":
            out = info(convert(spark, given.source, given.target, given.delimiter, given.skip_lines, given.num_nodes, given.force))
        else:
            out = {"info": info, "stats": stats}[given.command](load_graph(spark, given.path))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    print(json.dumps(out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
