"""Tables in folders by partition that are changed in part: what a change does not touch is
not written again. All through Hadoop's file system, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.sources.tables import scratch

__all__ = ["Buckets", "delete", "exists", "folders", "mark", "move", "replace_parts", "scratch"]


def _folder(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    jpath, where = _folder(spark, path)
    return where.exists(jpath)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a file or folder; one that is not there is no error."""
    jpath, where = _folder(spark, path)
    where.delete(jpath, True)


def move(spark: SparkSession, old: str, new: str) -> None:
    (a, where), (b, _) = _folder(spark, old), _folder(spark, new)
    where.mkdirs(b.getParent())
    if not where.rename(a, b):
        raise OSError(f"cannot move {old} to {new}")


def mark(spark: SparkSession, path: str) -> None:
    """Makes an empty folder, with those above it."""
    jpath, where = _folder(spark, path)
    where.mkdirs(jpath)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders right below a folder, sorted; none if it is not there."""
    jpath, where = _folder(spark, path)
    return sorted(s.getPath().toString() for s in where.listStatus(jpath) if s.isDirectory()) if where.exists(jpath) else []


def replace_parts(spark: SparkSession, rows: DataFrame, path: str, part: str, values: list, staged: str) -> None:
    """Puts rows, which may come from the table itself, in the place of its partitions with
    ``part`` in values; all others stay as they are. Rows are staged first and written by
    dynamic partition overwrite then; partitions that get no row are deleted."""
    if not values:
        return
    rows.write.mode("overwrite").parquet(staged)
    told = spark.read.parquet(staged)
    filled = {r[0] for r in told.select(part).distinct().collect()}  # of values
    if filled:
        told.hint("rebalance", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    for value in values:
        if value not in filled:
            delete(spark, f"{path}/{part}={value}")
    spark.catalog.refreshByPath(path)


class Buckets:
    """A table whose rows lie in folders by a hash of their key. ``replace`` gives keys new
    rows and writes their buckets alone; doing it twice is doing it once."""

    def __init__(self, spark: SparkSession, path: str, key: str, count: int = 64):
        if count < 1:
            raise ValueError("count must be positive")
        self.spark, self.path, self.key, self.count = spark, path.rstrip("/"), key, count

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.count)).cast("int")

    def there(self) -> bool:
        return bool(folders(self.spark, self.path))

    def read(self, schema: DataFrame | None = None) -> DataFrame:
        """The table without bucket numbers; of the columns of ``schema``, in its order, if
        told, which also serves while nothing is stored."""
        if not self.there():
            return schema.limit(0)
        rows = self.spark.read.parquet(self.path).drop("bucket")
        return rows.select(*schema.columns) if schema is not None else rows

    def replace(self, rows: DataFrame, keys: DataFrame) -> list[int]:
        """The rows of ``keys`` (a column named as the key) go and ``rows``, whose keys are
        among them, come. Returns the buckets that were written, at most ``count``."""
        work = scratch(self.spark)
        told = keys.select(self.key).distinct().withColumn("bucket", self.bucket())
        told.write.parquet(f"{work}/keys")
        told = self.spark.read.parquet(f"{work}/keys")
        touched = sorted(r[0] for r in told.select("bucket").distinct().collect())
        new = rows.withColumn("bucket", self.bucket())
        if self.there() and touched:
            held = self.spark.read.parquet(self.path).where(F.col("bucket").isin(*touched))
            new = held.join(told.select(self.key), self.key, "left_anti").select(*new.columns).unionByName(new)
        replace_parts(self.spark, new, self.path, "bucket", touched, f"{work}/staged")
        delete(self.spark, work)
        return touched


def bucketed(df: DataFrame, table: str, by: str, buckets: int | None = None, path: str | None = None, sort: tuple[str, ...] = ()) -> None:
    """Saves df as a table of the catalogue, replacing one of that name: in ``buckets`` files
    by a hash of ``by`` (as many as a shuffle has partitions if not told), sorted by it, so
    that joins and filters by it move no row and read no other bucket. Its files lie at
    ``path``, by default below the folder that all executors share."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path or scratch(spark)
    spark.sql(f"drop table if exists `{table}`")
    rows = df.repartition(buckets, by)
    rows.write.mode("overwrite").bucketBy(buckets, by).sortBy(by, *sort).option("path", path).saveAsTable(f"`{table}`")


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Tells files from later ones: of the names, sizes and times of all files below paths."""
    import hashlib

    told = []
    for path in paths:
        jpath, where = _folder(spark, path)
        if not where.exists(jpath):
            continue
        files = where.listFiles(jpath, True)
        while files.hasNext():
            f = files.next()
            told.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.md5(repr(sorted(told)).encode()).hexdigest()
