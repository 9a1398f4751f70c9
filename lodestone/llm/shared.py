"""Helpers that several training-data operators share: scratch tables in the shared
folder, file access by URI, joins on keys that may be hot, and connected components of a
link table."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A key that holds more than this share of the rows is hot: there are at most as many.
HOT = 1024
#: Most bytes of a table that is broadcast; a larger one is joined by a shuffle.
BROADCAST = 32 << 20
#: Bytes of input that a task of a shuffle of fixed width should get, and most such tasks.
TASK, MOST = 256 << 20, 1 << 17


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.
    Where it is unset, a temporary folder is set if all tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh place below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a
    lost executor costs no more than the tasks it was running."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for df in tables:
        if path := df.__dict__.get("scratch"):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def file_system(uri: str):
    """(pyarrow file system, path) of a URI, for files that are not tables."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def make_dirs(uri: str) -> None:
    where, path = file_system(uri)
    where.create_dir(path, recursive=True)


def width(df: DataFrame) -> int:
    """Tasks for a shuffle whose number of partitions an operator fixes itself: Spark's
    setting, or more where the input's size (known of tables) asks for more."""
    plan = df._jdf.queryExecution().optimizedPlan()
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if "Join" in plan.toString():  # Spark multiplies the sizes of a join's sides
        return least
    return max(least, min(MOST, int(str(plan.stats().sizeInBytes())) // TASK))


def looked_up(rows: DataFrame, told: DataFrame, on: str | list[str], total: int, most: int | None = None, count: str = "n") -> DataFrame:
    """rows joined with ``told``, a written table with one row for each key and the number
    ``count`` of rows that have it (``most`` is the largest, if known). A small told is
    broadcast. Else keys of more than total / HOT rows, HOT of them at most, are, so that no
    task gets all rows of one; the others are joined by a shuffle. Rows without a key in
    told go."""
    if small(told):
        return rows.join(F.broadcast(told), on)
    limit = total / HOT
    if most is None:
        most = told.agg(F.max(count)).first()[0] or 0
    if most <= limit:
        return rows.join(told, on)
    hot = told.where(F.col(count) > limit)
    rest = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(told.where(F.col(count) <= limit), on)
    return rows.join(F.broadcast(hot), on).unionByName(rest)


def small(told: DataFrame, rows: int | None = None) -> bool:
    """Whether a table's rows take at most BROADCAST bytes, by their number and a row's
    width; strings and binaries count as 64 bytes."""
    wide = sum(8 if kind in ("bigint", "int", "double", "boolean", "float") else 64 for _, kind in told.dtypes) + 16
    return (told.count() if rows is None else rows) * wide <= BROADCAST


def held(rows: DataFrame, ids: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """rows whose key is (left_semi) or is not (left_anti) in ``ids``, a written table of
    distinct keys; broadcast if it is small."""
    ids = ids.select(on)
    return rows.join(F.broadcast(ids) if small(ids) else ids, on, how)


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``links(a, b)``; component is the smallest
    node that links reach. Alternating large-star and small-star steps, each a grouped
    minimum and a look-up that no hub makes hot, written to the shared folder between
    steps; the driver sees counts. Loops, repeated and null links are harmless: a null end
    drops the link. A node without a link to another one gives no row."""
    ends = links.where("a is not null and b is not null and a <> b")
    edges = written(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        # a node's larger neighbours go to its smallest one, or stay with it if it is that
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        fans = edges.groupBy(F.col("b").alias("a")).agg(F.count("*").alias("n"))
        told = written(fans.join(low, "a", "left").select("a", "n", F.coalesce("m", "a").alias("m")), name)
        total, most, moves = told.agg(F.sum("n"), F.max("n"), F.count(F.when(F.col("m") < F.col("a"), 1))).first()
        if not total or (not moves and edges.select("a").distinct().count() == total):
            dropped(told)
            break  # every node hangs on one that hangs on none
        large = looked_up(edges.select(F.col("a").alias("x"), F.col("b").alias("a")), told, "a", total, most)
        large = written(large.select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), name)
        # a node and its smaller neighbours go to the smallest of them
        lows = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), name)
        moved = looked_up(large, lows.where("n > 1"), "a", total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after = written(moved.unionByName(lows.select("a", F.col("m").alias("b"))).distinct(), name)
        dropped(edges, told, large, lows)
        edges = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def joined(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``size`` places, the smallest place that the links a-b reach."""
    low = np.arange(size)
    while True:
        before = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        low = low[low]
        if (low == before).all():
            return low
