"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions alone.

Within a source a document's expected copies fall with the square root of its size, so that the mix doesn't repeat very
long documents as often as short ones: c / sqrt(size), MOST at most, where c is such that the expected words are the
source's target. Whole copies are taken for certain. What is left of a document's expected copies is its inclusion
probability p for one more; these differ from document to document. It draws u, and is ranked by the odds u/(1-u) over the
odds p/(1-p): the documents of least rank are the sample. Its fixed size is measured in words: documents are taken in order
while they fit into what is left of the target, and the last place goes to that document, of all others, whose size is nearest
to the words still missing.

No source is ever sorted as a whole. c comes from sums by size; ranks fall into buckets that are summed before the shuffle, a
running sum over the buckets finds the one in which the target is met, and only that bucket's documents are ordered. Ranks
near the cut are as dense as if they were uniform or less, so a bucket there holds no more than its share of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopweave.llm.common import WORD, if_small, materialize

#: Documents that one bucket of ranks should hold.
BUCKET_ROWS = 20_000
#: A target stops at so many times its source's size, and a document's copies too.
MOST = 3
#: Square roots of sizes are summed as whole numbers, of so many to one: sums are the same in any order.
ROOT_SCALE = 1024


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = MOST) -> DataFrame:
    """source, source_size to the same with target: the sources in code-point order, null last, weigh `weights` over
    and over and share the sum of all sizes; what a target has above `most` times its source's size is shared again
    by weight among the others, until none is above. One row per source; the shares come from one running sum.

    A source is full when most * size / weight is below the final share per weight. In ascending order of that
    ratio, those before the first that isn't full are the full ones, so the fixed point needs no loop.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights)).cast("int") + 1).cast("double").alias("w"))
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source")
    total, all_w = F.sum("source_size").over(Window.partitionBy()), F.sum("w").over(Window.partitionBy())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = ranked.withColumns({"left": total - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)), "left_w": all_w - F.coalesce(F.sum("w").over(before), F.lit(0.0)), "at": F.row_number().over(order)})
    rest = rest.withColumn("open", F.col("left") * F.col("w") / F.col("left_w") <= most * F.col("source_size"))
    first = F.min(F.when(F.col("open"), F.col("at"))).over(Window.partitionBy())
    share = F.max(F.when(F.col("at") == F.col("first"), F.col("left") / F.col("left_w"))).over(Window.partitionBy())
    found = rest.withColumn("first", first).withColumn("share", share)
    full = F.col("first").isNull() | (F.col("at") < F.col("first"))
    return found.select("source", "source_size", F.when(full, F.lit(float(most)) * F.col("source_size")).otherwise(F.col("share") * F.col("w")).alias("target"))


def draw(docs: DataFrame, seed: int) -> F.Column:
    """A number in (0, 1) from a digest of seed, doc_id and text."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _by_source(rows: DataFrame, side: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """rows joined with side, which has one row per source (null too); side's source is dropped."""
    side = side.withColumnRenamed("source", "s")
    return rows.join(if_small(side, n), F.col("source").eqNullSafe(F.col("s")), how).drop("s")


def root(size: str = "size") -> F.Column:
    return F.floor(F.sqrt(F.col(size).cast("double")) * ROOT_SCALE).cast("long")


def expected(most: int = MOST) -> F.Column:
    """Copies expected of a row of size > 0, given its source's c."""
    return F.when(F.col("size") > 0, F.least(F.lit(float(most)), F.col("c") * root() / F.col("size"))).otherwise(F.lit(0.0))


def whole(most: int = MOST) -> F.Column:
    return F.floor(expected(most) + 1e-9).cast("long")


def inclusion(most: int = MOST) -> F.Column:
    """The probability of one copy more."""
    return F.greatest(F.lit(0.0), expected(most) - whole(most))


def rank(u: F.Column, p: F.Column) -> F.Column:
    """Of Pareto sampling: the odds of the draw over the odds of inclusion. Null where a document can't have one copy more."""
    return F.when(p > 1e-9, (u / (1 - u)) / (p / (1 - p)))


def copies_scale(by_size: DataFrame, wanted: DataFrame, n: int, most: int = MOST) -> DataFrame:
    """by_size(source, size, rows), wanted(source, target) to source, c. The short documents of a source reach `most` first:
    c is what the others share once those before the first that doesn't reach it are taken. Null: all reach it."""
    sized = _by_source(by_size.where("size > 0"), wanted.select("source", "target"), n).withColumns({"words": F.col("size") * F.col("rows"), "roots": root() * F.col("rows")})
    order = Window.partitionBy("source").orderBy("size")
    before, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    c = (F.col("target") - most * F.coalesce(F.sum("words").over(before), F.lit(0))) / F.sum("roots").over(on)
    return sized.withColumn("c", c).where(F.col("c") * root() <= most * F.col("size")).groupBy("source").agg(F.min_by("c", "size").alias("c"))


def plan(drawn: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = MOST, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, int]:
    """From drawn(source, size, u), materialized: one row per source with source_size, target, c (see expected()), buckets,
    cut_bucket and cut_rank, cut_u (the last that fits, by rank and draw) and last_u, last_size (the last place's); and their number.
    Rows that repeat both size and draw count as one document."""
    by_size = materialize(drawn.groupBy("source", "size").agg(F.count("*").alias("rows")), "sizes-of-sources")
    by_source = materialize(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("rows")), "sources")
    n = by_source.count()
    wanted = materialize(targets(by_source.select("source", "source_size"), weights, most), "targets")
    scale = copies_scale(by_size, wanted, n, most)
    per = _by_source(wanted, by_source.select("source", F.greatest(F.lit(1), F.ceil(F.col("rows") / bucket_rows)).cast("long").alias("buckets")), n)
    per = _by_source(per, scale, n, "left").withColumn("c", F.coalesce("c", F.lit(float("inf"))))
    # what certain copies leave of the target: by size, as documents of a size are alike
    certain = _by_source(by_size, per.select("source", "c"), n).groupBy("source").agg(F.sum(whole(most) * F.col("size") * F.col("rows")).alias("certain"))
    per = materialize(_by_source(per, certain, n).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("certain"))).drop("certain"), "rest")
    ranked = _by_source(drawn.where("size > 0"), per.select("source", "c", "buckets", "rest"), n).withColumn("rank", rank(F.col("u"), inclusion(most))).where("rank is not null and rest > 0")
    ranked = ranked.withColumn("bucket", bucket())
    sums = ranked.groupBy("source", "bucket", "rest").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))).where("before <= rest and before + words > rest")
    cut = materialize(cut.groupBy("source").agg(F.min("bucket").alias("cut_bucket"), F.min_by("before", "bucket").alias("before")), "cuts")
    inner = _by_source(ranked, cut, n).where("bucket = cut_bucket")
    tied = inner.groupBy("source", "rank", "u", "rest", "before").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("rank", "u").rowsBetween(Window.unboundedPreceding, 0)
    taken = tied.withColumn("upto", F.col("before") + F.sum("words").over(order)).where("upto <= rest").groupBy("source").agg(F.max_by(F.struct("rank", "u", "upto"), F.struct("rank", "u")).alias("t"))
    cut = _by_source(cut, taken, n, "left").select("source", "cut_bucket", F.coalesce("t.rank", F.lit(-1.0)).alias("cut_rank"), F.coalesce("t.u", F.lit(-1.0)).alias("cut_u"), F.coalesce("t.upto", "before").alias("got"))
    cut = materialize(cut, "cut")
    # the last place: of all documents behind the cut, that which brings the words nearest to the target
    others = _by_source(ranked, cut, n).where(~taken_by_rank()).groupBy("source", "rank", "u", "size", "rest", "got").agg(F.count("*").alias("n"))
    missing = F.col("rest") - F.col("got")
    others = others.withColumn("off", F.abs(F.col("n") * F.col("size") - missing)).where(F.col("off") < missing)
    last = others.groupBy("source").agg(F.min(F.struct("off", "rank", "u", "size")).alias("l")).select("source", F.col("l.u").alias("last_u"), F.col("l.size").alias("last_size"))
    full = _by_source(_by_source(per, cut.drop("got"), n, "left"), last, n, "left")
    return materialize(full, "plan"), n


def bucket() -> F.Column:
    """Of a rank among its source's buckets: rank / (1 + rank) is even around the cut."""
    return F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * F.col("buckets")), F.col("buckets") - 1)


def taken_by_rank() -> F.Column:
    here = (F.col("rank") < F.col("cut_rank")) | ((F.col("rank") == F.col("cut_rank")) & (F.col("u") <= F.col("cut_u")))
    return F.col("cut_bucket").isNull() | (F.col("bucket") < F.col("cut_bucket")) | ((F.col("bucket") == F.col("cut_bucket")) & here)


def with_copies(drawn: DataFrame, per: DataFrame, n: int, most: int = MOST) -> DataFrame:
    """drawn and its source's source_size, target, and the copies that the mix takes of each row."""
    rows = _by_source(drawn, per, n).withColumns({"rank": rank(F.col("u"), inclusion(most)), "whole": whole(most)}).withColumn("bucket", bucket())
    last = F.coalesce((F.col("u") == F.col("last_u")) & (F.col("size") == F.col("last_size")), F.lit(False))
    more = F.col("rank").isNotNull() & (F.col("rest") > 0) & (taken_by_rank() | last)
    return rows.withColumn("copies", F.col("whole") + F.when(more, 1).otherwise(0)).select(*drawn.columns, "source_size", "target", "copies")


def sized(docs: DataFrame, seed: int) -> DataFrame:
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), draw(docs, seed).alias("u")), "sizes")


def mix_plan(docs: DataFrame, seed: int = 17, **params) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of docs.

    Whole texts are counted, however long; null texts and texts without words have size 0 and so take 0; null sources are one
    source, the last. Rows that repeat both doc_id and text draw alike and are taken together; other ties in rank go by the
    draw. Draws come from a digest, so reruns agree on any cluster. An empty table, or one without words, takes nothing. Other
    columns are ignored, whatever they are called.
    """
    drawn = sized(docs, seed)
    out = with_copies(drawn, *plan(drawn, **params))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 17, **params) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs. See mix_plan()."""
    per, n = plan(sized(docs, seed), **params)
    names = [f"c{i}" for i in range(len(docs.columns))]
    row = docs.select(F.struct(*[F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, names, strict=True)]).alias("row"), "source", word_count(F.col("text")).alias("size"), draw(docs, seed).alias("u"))
    many = with_copies(row, per, n).select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
    return many.select(*[F.col("row")[k].alias(c) for c, k in zip(docs.columns, names, strict=True)])
