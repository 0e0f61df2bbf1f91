"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: A second key of the joins below. What a node's least neighbour is was grouped by the node alone; with two keys both sides
#: of a join are dealt for the join itself, so that Spark's skew handling may split a hub with many neighbours.
PARTS = 64


def components(links: DataFrame, work: Workspace | None = None) -> DataFrame:
    """(node, label): the least node of the component, for every node that has a link ``a``-``b`` to another.

    Each round hangs neighbours on the least node known around them; rounds are few (logarithmic), each is a table in
    the shared folder that replaces the one before, and nothing but a count and a checksum comes to the driver. Links of a
    node to itself are left out.
    """
    a, b = F.col("a"), F.col("b")
    work = work or Workspace(links.sparkSession)

    def tidy(e: DataFrame) -> DataFrame:
        return e.filter(a != b).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def beside(e: DataFrame, least: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64("a"), F.lit(PARTS)).alias("part")
        return e.select("*", part).join(least.select("*", part), ["a", "part"])

    def large(e: DataFrame) -> DataFrame:
        both = e.union(e.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return tidy(beside(both, least).filter(b > a).select(b.alias("a"), F.col("m").alias("b")))

    def small(e: DataFrame) -> DataFrame:
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        hung = beside(e, least).filter(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        return tidy(hung.union(least.select("a", F.col("m").alias("b"))))

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = work.keep(tidy(links.select("a", "b")), "links")
    seen = mark(now)
    while seen[0]:
        last, now = now, work.keep(small(large(now)), "links")
        work.drop(last)
        if (new := mark(now)) == seen:
            break
        seen = new
    return now.select(a.alias("node"), b.alias("label")).union(now.select(b.alias("node"), b.alias("label")).distinct())
