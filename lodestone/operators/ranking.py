"""Dedupe, rank and fusion of result rows. Ties always end with the smaller id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def present(id_col: str = "id") -> Column:
    return F.col(id_col).isNotNull() & (F.col(id_col).cast("string") != "")


def best(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__rank = 1").drop("__rank")


def combine(df: DataFrame, id_col: str = "id", score_col: str = "score", pos_col: str = "pos") -> DataFrame:
    """One row an id, of the highest score (the first of equals), by falling score."""
    return best(df.where(present(id_col)), [id_col], [F.col(score_col).desc_nulls_last(), F.col(pos_col)]).orderBy(F.col(score_col).desc_nulls_last(), id_col)


def first_of_each(df: DataFrame, id_col: str = "id", pos_col: str = "pos") -> DataFrame:
    return best(df.where(present(id_col)), [id_col], [F.col(pos_col)])


def display_order(score_col: str = "score", pos_col: str = "pos") -> list[Column]:
    """Scored rows by falling score, then the others as they came."""
    scored = F.coalesce(F.col(score_col) > 0, F.lit(False))
    return [scored.desc(), F.when(scored, F.col(score_col)).desc_nulls_last(), F.col(pos_col)]


def fuse(vectors: DataFrame, graph: DataFrame, graph_weight: float = 0.5, vector_weight: float = 0.5, limit: int = 10) -> DataFrame:
    """Weighted fusion of vector rows (doc_id, content, score; several a document) and
    graph rows (doc_id, score): graph scores over their maximum, vector scores as they
    are, a missing side 0. Columns: doc_id, content, vector_score, graph_score, score. Of
    contents with equal scores the first by ``pos`` stays, where vectors have it."""
    first = -F.col("pos") if "pos" in vectors.columns else F.col("content")
    v = vectors.groupBy("doc_id").agg(F.max("score").alias("vector_score"), F.max_by("content", F.struct(F.col("score"), first.alias("first"))).alias("content"))
    g = graph.groupBy("doc_id").agg(F.max("score").cast("double").alias("graph_score"))
    top = g.where("graph_score > 0").agg(F.coalesce(F.max("graph_score"), F.lit(1.0)).alias("top"))  # one row
    both = v.join(g, "doc_id", "full_outer").join(F.broadcast(top))
    score = graph_weight * F.coalesce("graph_score", F.lit(0.0)) / F.col("top") + vector_weight * F.coalesce("vector_score", F.lit(0.0))
    both = both.select("doc_id", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), F.coalesce("graph_score", F.lit(0.0)).alias("graph_score"), score.alias("score"))
    return both.orderBy(F.col("score").desc(), "doc_id").limit(limit)


def merge_backends(first: DataFrame, second: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows (id, score, ...) of two stores, one an id, or one for each of ``keys``: the
    higher score, the first store's of equals; by falling score, not cut."""
    rows = first.withColumn("backend", F.lit(0)).unionByName(second.withColumn("backend", F.lit(1)))
    return best(rows.where(present()), keys or ["id"], [F.col("score").desc(), F.col("backend")])


def parity(first: DataFrame, second: DataFrame) -> DataFrame:
    """Differences of scores of the ids that two stores share: query, id, both scores, delta."""
    a = first.select("query", "id", F.col("score").alias("first_score"))
    b = second.select("query", "id", F.col("score").alias("second_score"))
    return a.join(b, ["query", "id"]).withColumn("delta", F.abs(F.col("first_score") - F.col("second_score")))


def parity_counts(first: DataFrame, second: DataFrame) -> DataFrame:
    """For each query: ids of either store, and how many they share."""
    rows = first.select("query", "id", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(second.select("query", "id", F.lit(0).alias("a"), F.lit(1).alias("b")))
    rows = rows.groupBy("query", "id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return rows.groupBy("query").agg(F.sum("a").alias("first_count"), F.sum("b").alias("second_count"), F.sum(F.col("a") * F.col("b")).alias("overlap"))
