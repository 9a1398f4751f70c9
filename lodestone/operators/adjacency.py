"""Stored adjacency: a graph's edges in both directions, in a table bucketed and sorted by
node. A hop of an expansion reads the buckets of a small frontier, whose ids reach the scan
as a filter, and joins a large one bucket by bucket: the edges are never shuffled again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.sources import store

#: Most ids of a frontier that go to the scan as a filter.
LOOKUP = 100


def directed(edges: DataFrame) -> DataFrame:
    """(id, to, step) of edges (src, dst, type) in both directions; step is TYPE:direction.
    Loops and edges with a blank end have none."""
    step = edges.select(F.col("src").alias("id"), F.col("dst").alias("to"), F.concat("type", F.lit(":outgoing")).alias("step"))
    step = step.unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("to"), F.concat("type", F.lit(":incoming")).alias("step")))
    return step.where("id <> to and id <> '' and to <> ''")


class Adjacency:
    """A stored graph, by the name of its table."""

    def __init__(self, spark: SparkSession, table: str):
        self.spark, self.table = spark, table

    @classmethod
    def build(cls, edges: DataFrame, table: str, buckets: int | None = None, path: str | None = None) -> Adjacency:
        """Stores edges (src, dst, type). A node's edges of one kind to one other node are
        one row. A node of very many edges fills one bucket's file; readers split files."""
        spark = edges.sparkSession
        store.bucketed(directed(edges).distinct(), table, "id", buckets, path)
        return cls(spark, table)

    def steps(self, front: DataFrame, ids: list | None) -> DataFrame:
        """Steps of the nodes of a frontier; of ``ids`` alone if they are known and few."""
        rows = self.spark.table(self.table)
        return rows.where(F.col("id").isin(ids)) if ids is not None and len(ids) <= LOOKUP else rows


class Steps:
    """The same of edges that are not stored."""

    def __init__(self, edges: DataFrame):
        self.rows = directed(edges)

    def steps(self, front: DataFrame, ids: list | None) -> DataFrame:
        return self.rows
