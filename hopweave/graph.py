"""Graphs as DataFrames: nodes(id), edges(src, dst, eid, weight, ts) with eid dense in row order of the sources."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopweave.sources.shared import materialize

#: Node ids are unsigned 32-bit with the last one reserved.
MOST_NODES = (1 << 32) - 1
#: Spans that the ids of sources are cut into: edges are numbered within spans, and the driver sends one row for each.
SPANS = 4096
#: Edges of one list; the row of a hub is several.
LIST = 65_536


@dataclass(frozen=True)
class Graph:
    """A homogeneous graph, or a bipartite one where num_dst differs from num_nodes. lists(src, start, degree, first, dst[, weight][, ts]):
    rows of edges as arrays of up to LIST of them, from place `first` of the row on; rows(src, start, degree): where the row of
    each node with edges begins; curve (see running_weights()); as far as they were made with the graph."""

    nodes: DataFrame
    edges: DataFrame
    num_nodes: int
    num_dst: int
    rows: DataFrame | None = None
    curve: DataFrame | None = None
    lists: DataFrame | None = None

    @property
    def is_homogeneous(self) -> bool:
        return self.num_nodes == self.num_dst

    @property
    def has_weights(self) -> bool:
        return "weight" in self.edges.columns

    @property
    def has_timestamps(self) -> bool:
        return "ts" in self.edges.columns

    def num_edges(self) -> int:
        return self.edges.count()

    def row_index(self) -> DataFrame:
        """src, start, degree of each node with edges."""
        if self.rows is not None:
            return self.rows
        if self.lists is not None:
            return self.lists.where("first = 0").select("src", "start", "degree")
        return self.edges.groupBy("src").agg(F.min("eid").alias("start"), F.count("*").alias("degree"))

    def adjacency(self) -> DataFrame:
        """src, start, degree, first, dst[, weight][, ts]: the rows of edges as arrays."""
        if self.lists is not None:
            return self.lists
        own = Window.partitionBy("src")
        rows = self.edges.withColumns({"start": F.min("eid").over(own), "degree": F.count("*").over(own)})
        return in_lists(rows.withColumn("place", F.col("eid") - F.col("start")), self.kept())

    def kept(self) -> list[str]:
        return [c for c in ("weight", "ts") if c in self.edges.columns]

    def running_weights(self) -> DataFrame:
        """src, eid, dst, low, high, last: each edge's stretch of its row's running weight, and whether it is the row's last edge."""
        if self.curve is not None:
            return self.curve
        row = Window.partitionBy("src").orderBy("eid")
        weight = F.col("weight").cast("double")
        high = self.edges.withColumn("high", F.sum(weight).over(row.rowsBetween(Window.unboundedPreceding, 0)))
        return high.select("src", "eid", "dst", F.coalesce(F.lag("high").over(row), F.lit(0.0)).alias("low"), "high", F.lead("eid").over(row).isNull().alias("last"))

    def settle(self) -> Graph:
        """The same graph, read back from tables in the shared folder: it is built once, whatever reads it, and plans stay short."""
        lists = materialize(self.adjacency(), "lists")
        return replace(self, edges=out_of_lists(lists), rows=None, curve=None, lists=lists)

    def persist(self) -> Graph:
        """The running weights are kept, from their first use on; lists that settle() wrote are read as they are, others kept."""
        kept = self if self.lists is not None else replace(self, nodes=self.nodes.persist(), edges=self.edges.persist())
        return replace(kept, curve=kept.running_weights().persist()) if kept.has_weights else kept

    def validate(self) -> None:
        """Raises ValueError naming what is out of range; one aggregate over the edges."""
        row = validation(self).head()
        for name in ("bad_src", "bad_dst", "nulls"):
            if row[name]:
                raise ValueError(f"{row[name]} edges with {name.replace('_', ' ')} (num_nodes {self.num_nodes}, num_dst {self.num_dst})")

    def set_timestamps(self, ts: DataFrame) -> Graph:
        """ts(eid, ts) must have one row for each edge."""
        joined = self.edges.drop("ts").join(ts.select("eid", F.col("ts").cast("double").alias("ts")), "eid")
        if ts.count() != self.num_edges() or joined.count() != self.num_edges():
            raise ValueError("timestamps must match the edges one to one")
        return replace(self, edges=joined.select(*[c for c in self.edges.columns if c != "ts"], "ts"), lists=None)


def in_lists(edges: DataFrame, kept: list[str], per: tuple[str, ...] = ()) -> DataFrame:
    """edges(*per, src, start, degree, place, dst, *kept) as lists, in order of place. Edges that are dealt by `per` stay where they are."""
    cut = edges.withColumn("first", F.floor(F.col("place") / LIST).cast("bigint") * LIST)
    lists = cut.groupBy(*per, "src", "start", "degree", "first").agg(F.array_sort(F.collect_list(F.struct("place", "dst", *kept))).alias("e"))
    # a field of an array of structs is the array of that field
    return lists.select("src", "start", "degree", "first", *[F.col(f"e.{c}").alias(c) for c in ("dst", *kept)])


def out_of_lists(lists: DataFrame) -> DataFrame:
    """src, dst, eid[, weight][, ts]; arrays that aren't asked for aren't read."""
    kept = [c for c in ("weight", "ts") if c in lists.columns]
    rows = lists.select("src", (F.col("start") + F.col("first")).alias("from"), F.posexplode("dst").alias("at", "dst"), *kept)
    return rows.select("src", "dst", (F.col("from") + F.col("at")).alias("eid"), *[F.get(c, F.col("at")).alias(c) for c in kept])


def span(num_nodes: int, column: str = "src") -> Column:
    return F.expr(f"{column} div {max(1, -(-num_nodes // SPANS))}")


def bases(counts: DataFrame) -> DataFrame:
    """counts(span, n) to span, base: the edges of smaller spans. At most SPANS rows."""
    upto = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    return counts.groupBy("span").agg(F.sum("n").alias("n")).select("span", F.coalesce(F.sum("n").over(upto), F.lit(0)).cast("bigint").alias("base"))


def from_edges(raw: DataFrame, num_nodes: int, order: list[str | Column], num_dst: int | None = None) -> Graph:
    """raw(src, dst[, weight][, ts]) to a Graph; `order` is the input order of a source's row and has to be total. An edge whose
    source is null or out of range is an error when the edges are read; destinations are checked by validate()."""
    spark = raw.sparkSession
    if not 0 <= num_nodes < MOST_NODES:
        raise ValueError(f"num_nodes {num_nodes} is out of range")
    nodes = spark.range(num_nodes).select(F.col("id").cast("bigint").alias("id"))
    kept = [c for c in ("weight", "ts") if c in raw.columns]
    inside = F.col("src").between(0, num_nodes - 1)
    dealt = raw.withColumn("span", span(num_nodes))
    starts = bases(dealt.where(inside).groupBy("span").agg(F.count("*").alias("n")))
    # numbered within spans of sources: edges are shuffled and sorted once
    rank = F.row_number().over(Window.partitionBy("span").orderBy("src", *order)).cast("bigint") - 1
    placed = dealt.withColumn("rank", rank).join(F.broadcast(starts), "span", "left")
    end = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    beyond = F.raise_error(F.concat(F.lit("edge ("), end("src"), F.lit(", "), end("dst"), F.lit(f"): the source isn't in 0..{num_nodes - 1}"))).cast("bigint")
    numbered = placed.select("span", F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), F.when(inside, F.col("base") + F.col("rank")).otherwise(beyond).alias("eid"), *kept)
    own = Window.partitionBy("span", "src")
    rows = numbered.withColumns({"start": F.min("eid").over(own), "degree": F.count("*").over(own)})
    lists = in_lists(rows.withColumn("place", F.col("eid") - F.col("start")), kept, ("span",))
    return Graph(nodes, numbered.drop("span"), num_nodes, num_nodes if num_dst is None else num_dst, lists=lists)


def empty(spark) -> Graph:
    return Graph(spark.range(0), spark.createDataFrame([], "src bigint, dst bigint, eid bigint"), 0, 0)


def from_csr_arrays(spark, offsets: list[int], targets: list[int]) -> Graph:
    """From the arrays themselves, checked: monotone offsets from 0 to the number of targets."""
    if not offsets or offsets[0] != 0 or offsets[-1] != len(targets) or any(a > b for a, b in zip(offsets, offsets[1:], strict=False)):
        raise ValueError("offsets must rise from 0 to the number of targets")
    n = len(offsets) - 1
    rows = [(s, targets[e], e) for s in range(n) for e in range(offsets[s], offsets[s + 1])]
    graph = Graph(spark.range(n), spark.createDataFrame(rows, "src bigint, dst bigint, eid bigint"), n, n)
    graph.validate()
    return graph


def validation(graph: Graph) -> DataFrame:
    out = lambda c, n: F.sum(((F.col(c) < 0) | (F.col(c) >= n)).cast("bigint"))
    # eids as bits of words, which lie together where edges do
    bit = F.expr("shiftleft(1L, cast(eid & 63 AS INT))")
    words = graph.edges.groupBy(F.shiftright("eid", 6).alias("word")).agg(
        F.count("*").alias("n"), out("src", graph.num_nodes).alias("bad_src"), out("dst", graph.num_dst).alias("bad_dst"),
        F.sum((F.col("src").isNull() | F.col("dst").isNull()).cast("bigint")).alias("nulls"), F.bit_count(F.bit_or(bit)).alias("eids"), F.max("eid").alias("last"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return words.agg(
        total("n").alias("num_edges"), total("bad_src").alias("bad_src"), total("bad_dst").alias("bad_dst"), total("nulls").alias("nulls"),
        (total("n") - total("eids")).alias("repeated_eids"), F.coalesce(F.max("last") + 1 - F.sum("n"), F.lit(0)).cast("bigint").alias("eid_gaps"),
    )
