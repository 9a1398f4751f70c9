"""Limiters, loads and order statistics where one key has most of the rows."""

import random
from collections import Counter, deque

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lodestone.operators import limiter, metrics

ROWS = "client_id string, ts timestamp_ntz, request_id long"


def requests(spark, rows):
    """rows: client, microseconds, id."""
    df = spark.createDataFrame(rows, "client_id string, us long, request_id long")
    return df.select("client_id", F.timestamp_micros("us").alias("ts"), "request_id")


def bursts(seed, n, span):
    r = random.Random(seed)
    out, now = [], 0
    for i in range(n):
        now += r.choice([0, 1, span // 50, span // 50, span // 50, span - 1, span, span + 1, 5 * span])
        out.append(("hot" if r.random() < 0.9 else f"c{r.randrange(3)}", now, i))
    r.shuffle(out)
    return out


def by_client(rows):
    out = {}
    for c, us, i in sorted(rows, key=lambda x: (x[1], x[2])):
        out.setdefault(c, []).append((us, i))
    return out


def test_log_limit_by_sessions(spark):
    span, rows = 10_000_000, bursts(1, 3000, 10_000_000)
    want = {}
    for _, log in by_client(rows).items():
        held = deque()
        for us, i in log:
            while held and held[0] <= us - span:
                held.popleft()
            ok = len(held) < 4
            if ok:
                held.append(us)
            want[i] = (ok, len(held))
    out = limiter.log_limit(requests(spark, rows), 4, 10)
    assert {r["request_id"]: (r["allowed"], r["count"]) for r in out.collect()} == want
    assert len(set(want.values())) > 4


def test_counter_limit_by_sessions(spark):
    rows, sub = bursts(2, 3000, 10_000_000), 1_000_000
    want = {}
    for _, log in by_client(rows).items():
        index = now = last = 0
        for us, i in log:
            k = us // sub
            if k != index:
                last, now, index = (now if k == index + 1 else 0), 0, k
            weighted = last * (1 - (us % sub) / sub) + now
            want[i] = (weighted < 3, weighted)
            now += weighted < 3
    out = limiter.counter_limit(requests(spark, rows), 3, 10, 10)
    got = {r["request_id"]: (r["allowed"], r["count"]) for r in out.collect()}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-9 for i in want)


def test_a_hot_client_is_many_tasks(spark):
    span = 60_000_000
    rows = spark.range(0, 20000, 1, 4).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string")).alias("client"), (F.floor(F.col("id") / 20) * 3 * span + F.col("id") % 20).alias("us"), F.col("id").alias("tie"))
    parts = limiter.sessions(rows, span, F.col("first") - F.col("last_before") >= span).repartition(8, "client", "session").groupBy(F.spark_partition_id()).count().collect()
    sizes = sorted(r["count"] for r in parts)
    assert len(sizes) == 8 and sizes[-1] < 2 * sizes[0]


def test_offered_load(spark):
    rows = bursts(3, 2000, 10_000_000)
    rows += [(None, 5, 9000)]
    want = {}
    for c, log in by_client([r for r in rows if r[0]]).items():
        for us, i in log:
            want[i] = sum(us - 10_000_000 < x <= us for x, _ in log)
    out = limiter.offered_load(requests(spark, rows), 10)
    assert {r["request_id"]: r["offered"] for r in out.collect()} == want
    assert limiter.offered_load(requests(spark, rows).limit(0), 10).count() == 0


@pytest.fixture(scope="module")
def values(spark):
    r = random.Random(5)
    groups = {
        "hot": [r.gauss(0, 1) for _ in range(3000)],
        "equal": [7.0] * 500,
        "heavy": [1.0] * 900 + [r.random() for _ in range(100)],
        "far": [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324, 1e-300] * 40 + [10.0**k for k in range(-300, 300, 5)],
        "one": [3.5],
        "two": [2.0, -2.0],
        "low": [-float("inf"), 1.0, 2.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("nulls", None), ("hot", None)]
    r.shuffle(rows)
    return groups, spark.createDataFrame(rows, "endpoint string, duration double")


@pytest.mark.parametrize("small", [1, 10, 1 << 16])
def test_selection_is_exact(spark, values, monkeypatch, small):
    groups, df = values
    monkeypatch.setattr(metrics, "SMALL", small)
    monkeypatch.setattr(metrics, "PIECES", 8)
    for share in (0.0, 0.5, 0.95):
        got = {r["endpoint"]: r["duration"] for r in metrics.selected(df, "endpoint", "duration", F.floor(F.col("n") * share)).collect()}
        assert got == {g: sorted(v)[int(share * len(v))] for g, v in groups.items()}


def test_latency_of_groups(spark, values):
    groups, df = values
    got = {r["endpoint"]: r for r in metrics.latency(df, "endpoint").collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert (got[g]["least"], got[g]["most"], got[g]["p95"]) == (min(v), max(v), sorted(v)[int(0.95 * len(v))])
    plan = metrics.selected(df, "endpoint", "duration", F.floor(F.col("n") * 0.95))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and Counter(plan)["\n"] < 60
