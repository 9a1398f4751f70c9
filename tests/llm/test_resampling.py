"""Importance resampling against a plain computation."""

import hashlib
import math
import re
import zlib
from collections import Counter

import __spark_entry__ as entry
from lodestone.llm import resampling
from pyspark.sql import functions as F

ROWS = "doc_id long, text string"


def grams(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    every = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(g.encode()) % 10000 for g in every]


def expected(docs, target):
    told = [(i, *grams(t)) for i, t in docs]
    s, t = Counter(b for _, _, x in told for b in x), Counter(b for x in target for b in grams(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (S + 10000.0) / ((s[b] + 1.0) * (T + 10000.0))))
    rows = []
    for i, n, x in told:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, x))
        rows.append([i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: 5 * len(able) // 100])}
    return sorted((tuple(r[:4]) + (ranks.get(id(r)),) for r in rows), key=str)


def test_odd_rows(spark):
    many = [(i, f"Wort{i % 7} der {'aBc' * (i % 3)} é{i % 5}_x-y 0{i % 4} " * 6) for i in range(100)]
    rows = [*many, (1, None), (2, ""), (3, "!? \x00 _"), (7, many[7][1]), (None, many[9][1]), (8, "ÄÖ ß ﬁ 漢字 😀 İ K" * 4), (9, "lone")]
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 as weight", "2 as id", "3 as words", "4 as bucket", "5 as pos")
    target = spark.createDataFrame([("wort1 der é2",), (None,), ("",)], "text string")
    out = resampling.resample(df, target)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, out.collect()), key=str) == expected(rows, ["wort1 der é2"])
    assert resampling.resample(df.limit(0), target).count() == 0
    assert sorted(map(tuple, resampling.resample(df, target.limit(0)).collect()), key=str) == expected(rows, [])


def test_ranks_go_on_from_partition_to_partition(spark):
    rows = spark.range(0, 5000, 1, 8).select("id", (F.col("id") * 7919 % 1000).alias("score"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = resampling.ranked(rows, [F.col("score").desc(), F.col("id")], 3000).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(((r["id"], r["score"]) for r in rows.collect()), key=lambda r: (-r[1], r[0]))
    assert [(r["id"], r["score"]) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == want[:3000]
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 3001)) and len(got) == 5000


def test_no_python_on_the_executors(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = docs.select(resampling.words(F.col("text")).alias("words"))
    plan = resampling.counted(texts)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_registered_query(spark, data):
    read = lambda n: spark.read.parquet(f"{data}/{n}.parquet")
    docs = [(r["doc_id"], r["text"]) for r in read("documents").collect()]
    target = [r["text"] for r in read("benchmark").collect()]
    out = entry.queries()["op13_resample"](spark, data)
    assert dict(out.dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")
    assert sorted(map(tuple, out.collect()), key=str) == expected(docs, target)
