"""Composed searches: vector-first hybrid retrieval, and named stores with health checks."""

from __future__ import annotations

import concurrent.futures
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.operators import graph, rendering, vectors

SEARCH_SECONDS = 30.0


def hybrid_search(points: DataFrame, edges: DataFrame, nodes: DataFrame, query: list[float], top_k: int = 3, hops: int = 2, limit: int | None = 50, mode: str = "cosine") -> DataFrame:
    """Nodes of a search: the top_k of highest score, then those within ``hops`` of them.
    Columns: pos, id, score (0 for the latter), hops, chain, and the columns of nodes (id,
    ...). The plan is a top-k scan, one equi-join a hop, and a join for the fields."""
    if not 1 <= top_k <= 50:
        raise ValueError("top_k must be between 1 and 50")
    found = graph.bounded(vectors.top_k(points.select("id", "embedding"), query, top_k, mode=mode))
    near = graph.expand(edges, found.select("id"), hops, limit)
    rows = found.select("id", "score", F.lit(0).alias("hops"), F.lit("").alias("chain")).unionByName(near.select("id", F.lit(0.0).alias("score"), "hops", "chain"))
    return rows.join(nodes, "id", "left")


def search_context(rows: DataFrame, query: str | Column = "") -> DataFrame:
    """One row: query, context_block and total_nodes of hybrid_search's rows. Where nothing
    was found, or nothing that has an id, the block says so."""
    asked = F.lit(query) if isinstance(query, str) else query
    rows = rows.withColumn("query", F.lit(0)).withColumn("pos", F.struct("hops", "id"))
    first = rows.where("score > 0 or hops = 0").withColumn("hops", F.lit(None).cast("int"))
    told = rendering.context_block(first, rows.where("hops > 0"))
    seeds = rows.where("hops = 0").agg(F.count("*").alias("seeds"))
    one = seeds.withColumn("query", F.lit(0)).join(told, "query", "left")
    empty = F.when(F.col("seeds") == 0, rendering.no_results(asked)).otherwise(rendering.no_valid_nodes(asked))
    return one.select(asked.alias("query"), F.coalesce("context_block", empty).alias("context_block"), F.coalesce("total_nodes", F.lit(0)).cast("long").alias("total_nodes"))


def run_tool(spark: SparkSession, search: Callable[[str], DataFrame], query: str | bytes, seconds: float = SEARCH_SECONDS) -> str:
    """A search tool's answer: ``search(query)`` gives search_context's row. Never raises: a
    blank query, one that takes longer than ``seconds``, and a failing one are told so."""
    text = (query.decode("utf-8", "replace") if isinstance(query, bytes) else query).strip()
    if not text:
        return rendering.EMPTY_RESPONSE
    pool = concurrent.futures.ThreadPoolExecutor(1)
    tag = f"lodestone-search-{id(pool)}"

    def work():
        spark.addTag(tag)
        try:
            return search(text).first()
        finally:
            spark.removeTag(tag)

    try:
        row = pool.submit(work).result(timeout=seconds)
        return rendering.tool_text(text, row["total_nodes"], row["context_block"])
    except concurrent.futures.TimeoutError:
        spark.interruptTag(tag)
        return rendering.tool_timeout(text, seconds)
    except Exception as e:
        return rendering.tool_error(text, str(e))
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def execute_tool(spark: SparkSession, name: str, arguments: dict, search: Callable[[str], DataFrame]) -> str:
    """Answers a call of the search tool by its name; an unknown name is told so."""
    if name != rendering.TOOL:
        return rendering.unknown_tool(name)
    return run_tool(spark, search, arguments.get("search_query", ""))


class Stores:
    """Named vector stores (tables of id, embedding); an unhealthy one falls back."""

    def __init__(self, stores: dict[str, DataFrame], default: str, dimensions: int | None = None):
        if default not in stores:
            raise ValueError(f"no store {default}")
        self.stores, self.default, self.active, self.dimensions = stores, default, default, dimensions

    def healthy(self, name: str) -> bool:
        """It exists, has an id and an embedding, and its vectors have the dimension."""
        df = self.stores.get(name)
        if df is None or not {"id", "embedding"} <= set(df.columns):
            return False
        return self.dimensions is None or df.where(F.size("embedding") != self.dimensions).isEmpty()

    def switch(self, name: str) -> bool:
        if not self.healthy(name):
            return False
        self.active = name
        return True

    def current(self) -> DataFrame:
        return self.stores[self.active if self.healthy(self.active) else self.default]

    def search(self, query: list[float], top_k: int = 3, mode: str = "cosine") -> DataFrame:
        return vectors.top_k(self.current().select("id", "embedding"), query, top_k, mode=mode)
