"""Graphs: edge lists, adjacency text and PageRank."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.lineage import drop, size_of, written
from gneiss.operators.dataset import Dataset

START, DAMPING = 0.15, 0.85
#: Edges of so few bytes are cheaper to read again than to keep.
SMALL = 8 << 20


def adjacency_edges(lines: DataFrame, column: str = "value") -> DataFrame:
    """Edges of lines ``id n nb1 nb2 ...``; short or empty lines give none."""
    fields = F.filter(F.split(F.trim(F.col(column)), "[ \\t]+"), lambda x: x != "")
    return (
        lines.select(fields.alias("f"))
        .filter(F.size("f") > 2)
        .select(F.element_at("f", 1).cast("bigint").alias("src"), F.explode(F.slice("f", F.lit(3), F.size("f"))).alias("dst"))
        .withColumn("dst", F.col("dst").cast("bigint"))
    )


def pagerank(edges: DataFrame, iterations: int, every: int = 4) -> DataFrame:
    """(id, pr) after iterations - 1 updates of pr = 0.85 * incoming + 0.15, from 0.15.

    Ranks aren't normalised, dangling mass is lost and parallel edges count each time. Edges with a
    NULL end are left out. Edges with their shares are written once. Those of more than SMALL bytes are then dealt by src
    and kept that way, so that an update shuffles ranks and combined contributions but never the edges; every few updates
    the ranks are written too, which bounds the plan. Lost parts of the kept edges are computed again from the written table.
    """
    if iterations < 1:
        raise ValueError("one iteration is needed at least")
    plain = edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")).dropna()
    weighted = plain.groupBy("src", "dst").agg(F.count("*").alias("n"))
    out = plain.groupBy("src").agg(F.count("*").alias("deg"))
    links = written(weighted.join(out, "src").select("src", "dst", (F.col("n") / F.col("deg")).alias("share")), "links")
    ids = written(links.select(F.col("src").alias("id")).union(links.select("dst")).distinct(), "vertices")
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored, kept = links, size_of(links) > SMALL
    if kept:
        links = links.repartition(parts, "src").persist(StorageLevel.MEMORY_AND_DISK)
    ranks, last = ids.withColumn("pr", F.lit(START)), None
    for i in range(1, iterations):
        incoming = links.join(ranks.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("pr") * F.col("share")).alias("in"))
        ranks = ids.join(incoming, "id", "left").select("id", (DAMPING * F.coalesce("in", F.lit(0.0)) + START).alias("pr"))
        if i % every == 0 or (kept and i == iterations - 1):
            ranks = written(ranks, "ranks")
            if last is not None:
                drop(last)
            last = ranks
    if kept:
        links.unpersist()
        drop(stored)
    return ranks


class Graph:
    """Load edges once, compute ranks, read the largest."""

    def __init__(self):
        self.edges: DataFrame | None = None
        self.ranks: DataFrame | None = None

    def _load(self, edges: DataFrame) -> Graph:
        if self.edges is not None:
            raise RuntimeError("a graph is already loaded")
        self.edges = edges
        return self

    def from_edges(self, data: Dataset) -> Graph:
        if len(data.df.columns) != 2:
            raise TypeError("edges are pairs")
        return self._load(data.df.toDF("src", "dst"))

    def from_adjacency_text(self, spark: SparkSession, url: str) -> Graph:
        return self._load(adjacency_edges(spark.read.text(url)))

    def compute_pagerank(self, iterations: int) -> Graph:
        if self.edges is None:
            raise RuntimeError("no graph is loaded")
        self.ranks = written(pagerank(self.edges, iterations), "ranks")
        return self

    def topk_pagerank(self, k: int, digits: int | None = None) -> list[tuple[int, float]]:
        """The k vertices with the largest (pr, id), in ascending order. digits: round first, so that the order of sums settles no tie."""
        if self.ranks is None:
            raise RuntimeError("compute_pagerank() has not been called")
        ranks = self.ranks if digits is None else self.ranks.withColumn("pr", F.round("pr", digits))
        rows = ranks.orderBy(F.desc("pr"), F.desc("id")).limit(k).collect()
        return sorted(((r["id"], r["pr"]) for r in rows), key=lambda x: (x[1], x[0]))


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dst").agg(F.count("*").alias("indegree"))


def in_degree_histogram(edges: DataFrame) -> DataFrame:
    """How many vertices have each in-degree."""
    return in_degrees(edges).groupBy("indegree").agg(F.count("*").alias("n"))
