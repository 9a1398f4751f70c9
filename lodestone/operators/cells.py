"""Joins of every query row with every point row of its key, as a grid of cells: points are
cut into blocks by a hash of their id and so are queries, each block goes to the cells of its
row or column, and a cell is one pair of blocks of bounded size. So a key that holds most of
the rows is many tasks, and the plan has the same size for any number of queries."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


#: Most numbers in the vectors of a block, by the mean.
NUMBERS = 1 << 22


def within(most: int, size: int | Column) -> Column:
    """At most ``most`` vectors of a size to a block, fewer if they are long."""
    return F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(NUMBERS) / size)))


def blocks(points: DataFrame, queries: DataFrame, keys: list[str], most_points: int | Column, most_queries: int | Column) -> DataFrame:
    """(keys, p, q) of the keys that both have: how many blocks points and queries make, of
    at most so many rows by the mean, which may depend on the key."""
    count = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(n))
    size = lambda c, most: F.ceil(F.col(c) / most).cast("int")
    both = count(points, "n").join(count(queries, "m"), keys)
    return both.select(*keys, size("n", most_points).alias("p"), size("m", most_queries).alias("q"))


def matched(points: DataFrame, queries: DataFrame, keys: list[str], cell: Callable[[pa.Table, pa.Table], pa.Table], schema: str, most_points: int | Column, most_queries: int | Column, told: DataFrame | None = None) -> DataFrame:
    """Rows that ``cell(points, queries)`` returns for each cell of blocks of both sides (the
    first column of each is its id). ``told`` are the blocks if they are known already."""
    told = blocks(points, queries, keys, most_points, most_queries) if told is None else told

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        rows = df.join(told, keys).withColumn(f"__{own}", F.pmod(F.xxhash64(df.columns[0]), F.col(own)).cast("int"))
        rows = rows.withColumn(f"__{other}", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return rows.drop("p", "q")

    at = [*keys, "__p", "__q"]
    a, b = dealt(points, "p", "q"), dealt(queries, "q", "p")
    return a.groupBy(*at).cogroup(b.groupBy(*at)).applyInArrow(cell, schema)


def ranked(found: DataFrame, k: int, by: str = "query") -> DataFrame:
    """The k best rows of each query, with their rank: ties go to the smaller id."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
