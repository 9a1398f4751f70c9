import datetime as dt
import random

from pyspark.sql import functions as F

from lodestone.operators import limiter, mutation
from lodestone.streaming import twins


def requests(spark, tmp_path):
    random.seed(4)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, i % 3, start + dt.timedelta(seconds=random.randrange(300)), "e", 200 if i % 2 else 500) for i in range(120)]
    df = spark.createDataFrame(rows, "request_id long, client_id long, ts timestamp, endpoint string, status int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def run(stream, spark, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_limiter_stream_is_the_batch(spark, tmp_path):
    batch, stream = requests(spark, tmp_path)
    want = {r["request_id"]: r["allowed"] for r in limiter.log_limit(batch, 4, 60).collect()}
    found = {r["request_id"]: r["allowed"] for r in run(twins.limit_stream(stream, 4, 60), spark, "limits", tmp_path).collect()}
    assert found == want and 0 < sum(want.values()) < 120


def test_metrics_stream(spark, tmp_path):
    batch, stream = requests(spark, tmp_path)
    found = run(twins.metrics_stream(stream), spark, "mets", tmp_path, "complete")
    assert found.agg(F.sum("requests"), F.sum("failed")).first() == (120, 60)


def test_upsert_stream(spark, tmp_path):
    changes = spark.createDataFrame([(1, "a"), (2, "b")], "point_id long, content string")
    changes.write.parquet(str(tmp_path / "chg"))
    held = {"df": spark.createDataFrame([(2, "old"), (3, "c")], "point_id long, content string")}

    def write(df, n):
        held["df"] = spark.createDataFrame(df.collect(), df.schema)

    twins.upsert_stream(spark.readStream.schema(changes.schema).parquet(str(tmp_path / "chg")), lambda: held["df"], mutation.upsert_points, write, str(tmp_path / "ck")).awaitTermination()
    assert sorted(map(tuple, held["df"].collect())) == [(1, "a"), (2, "b"), (3, "c")]
