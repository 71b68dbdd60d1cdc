"""Connected components by alternating large-star and small-star steps: a distributed union-find.

Each step is a join and an aggregation over edges; the state between rounds is a written table in
the shared folder, never on the driver. A hub's rows are spread by the engine's skew-join handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.lineage import drop, written


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("b", "a"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    rest = e.join(low, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(low).filter(F.col("a") != F.col("b")).distinct()


def _settled(e: DataFrame) -> bool:
    """Whether every node has one root and no root has one itself."""
    ends = e.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
    odd = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))
    return odd.isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link, root itself left out; root is the smallest node reachable.

    links: columns a and b, of one orderable type. Loops, repeats and either direction are fine;
    links with a NULL end are left out. No links give an empty table.
    """
    e = links.dropna().filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, "links")
    while not _settled(e):
        new = written(_small_star(_large_star(e)), "links")
        drop(e)
        e = new
    out = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out._gneiss_path = e._gneiss_path
    return out
