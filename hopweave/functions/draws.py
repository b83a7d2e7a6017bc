"""Random draws as pure functions of a seed and row keys: the same at any partitioning and cluster size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(*parts: Column | int | str) -> Column:
    """md5 of the parts joined by |, as 32 hex digits; ordering by it is a uniform shuffle."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *cols).cast("binary"))


def unit(digest: Column) -> Column:
    """A number in (0, 1] from the first 52 bits of a digest."""
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / float(1 << 52)


def below(digest: Column, n: Column) -> Column:
    """A number in 0..n-1 from the first 48 bits of a digest."""
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") % n


def weighted(digest: Column, weight: Column) -> Column:
    """The rank of weighted sampling without replacement: -ln(u) / w, and infinity for weights that aren't positive and finite."""
    fine = weight.isNotNull() & (weight > 0) & ~F.isnan(weight) & (weight < float("inf"))
    return F.when(fine, -F.log(unit(digest)) / weight).otherwise(F.lit(float("inf")))


def distinct(digest, n: Column, k: int | Column) -> Column:
    """k different numbers in 0..n-1 (n > k), by Floyd's method: step i draws t in 0..n-k+i and takes n-k+i where t is taken.
    digest(i) gives the draw of step i. The cost is k, whatever n."""
    k = (k if isinstance(k, Column) else F.lit(k)).cast("bigint")

    def step(taken: Column, i: Column) -> Column:
        top = n - k + i
        drawn = F.transform(F.array(below(digest(i), top + 1)), lambda t: F.array_append(taken, F.when(F.array_contains(taken, t), top).otherwise(t)))
        return F.element_at(drawn, 1)

    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), k - 1), F.array().cast("array<bigint>"), step)


def pair(first: Column, second: Column) -> Column:
    """Two numbers, of at most 15 and 18 digits, as one that orders like them: unlike a struct, hash aggregation can take its minimum."""
    return first.cast("decimal(15,0)") * F.lit(10**18).cast("decimal(19,0)") + second.cast("decimal(18,0)")
