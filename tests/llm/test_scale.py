"""What serves large tables: hot keys, blocks, bounds, shared folders."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import bagminhash, pivots, shared, vectors


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
@pytest.mark.parametrize("hot", [1024, 8])
def test_looked_up(spark, monkeypatch, broadcast, hot):
    monkeypatch.setattr(shared, "BROADCAST", broadcast)
    monkeypatch.setattr(shared, "HOT", hot)
    rows = [(i, i % 7 if i % 3 else 0) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, key long")
    told = shared.written(df.groupBy("key").agg(F.count("*").alias("n")).where("key <> 5"), "told")
    got = shared.looked_up(df, told, "key", len(rows))
    count = {k: sum(x == k for _, x in rows) for k in range(7)}
    assert sorted((r["id"], r["key"], r["n"]) for r in got.collect()) == [(i, k, count[k]) for i, k in rows if k != 5]
    shared.dropped(told)
    with pytest.raises(Exception):  # noqa: B017
        told.collect()


@pytest.mark.parametrize("hot", [1024, 4])
def test_components_with_hubs(spark, monkeypatch, hot):
    monkeypatch.setattr(shared, "BROADCAST", 0)
    monkeypatch.setattr(shared, "HOT", hot)
    rng = random.Random(7)
    links = [(500, i) for i in range(60)] + [(i, 501) for i in range(100, 160)] + [(3, 9), (200, 150), (200, 201)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)]
    found = {r["node"]: r["component"] for r in shared.components(spark.createDataFrame(links, "a long, b long")).collect()}
    low = shared.joined(600, *(np.array(x) for x in zip(*links)))
    assert found == {i: low[i] for i in {x for a, b in links if a != b for x in (a, b)}}


def test_large_groups_by_shuffles(spark, monkeypatch):
    """Classes and links are the same where nothing is small enough to be broadcast."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    rows = [(i, " ".join(base)) for i in range(40)] + [(100 + i, " ".join(base[: 79 - i % 9] + [f"x{i}"])) for i in range(60)] + [(300 + i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(30))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(tuple(r) for r in bagminhash.classes(df).collect())
    vecs = [(i, np.random.default_rng(i % 20).normal(size=16).tolist(), i % 2) for i in range(120)]
    v = spark.createDataFrame(vecs, "vec_id long, embedding array<double>, label int")
    links = sorted(tuple(r) for r in vectors.near_duplicates(v).collect())
    monkeypatch.setattr(shared, "BROADCAST", 0)
    monkeypatch.setattr(shared, "HOT", 8)
    assert sorted(tuple(r) for r in bagminhash.classes(df).collect()) == want
    assert sorted(tuple(r) for r in vectors.near_duplicates(v).collect()) == links


def test_a_very_long_text_and_its_copy(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**5)}" for _ in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-500])), (3, " ".join(words[60_000:])), (4, "é" * 400_000)]
    out = bagminhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in out) == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Session())


def test_recall_at_the_threshold_with_more_rotations():
    rng = np.random.default_rng(3)
    a = vectors.normal(rng.normal(size=(250, 64)))
    r = rng.normal(size=(250, 64))
    r = vectors.normal(r - (r * a).sum(1, keepdims=True) * a)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * r
    for rotations in (4, 5, 6):
        x, y = vectors.codes(a.astype(np.float32), rotations), vectors.codes(b.astype(np.float32), rotations)
        assert ((x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)).any(1).mean() > 0.98


def visited(ids, v, k=5, every=50):
    """The share of pairs that a search of all vectors scores, and its results."""
    some = np.argsort(ids * 2654435761 % 2**32)[: pivots.SAMPLE]
    it = pivots.Index(ids[some], v[some], k)
    d = it.angles(v)
    near, r = d.argmin(1), d.min(1)
    order, rows = np.lexsort((r, near)), []
    for p in np.unique(near):
        at = order[near[order] == p]
        for x in range(0, len(at), pivots.BLOCK):
            b = at[x : x + pivots.BLOCK]
            n = pivots.lengths(v[b])
            rows.append({"pivot": int(p), "inner": r[b].min(), "outer": r[b].max(), "least": n.min(), "most": n.max(), "ids": ids[b].astype("<i8").tobytes(), "vectors": v[b].tobytes()})
    q = np.flatnonzero(ids % every == 0)
    group = pivots.Group(it, np.arange(len(q)), ids[q], v[q], it.first(ids[q], v[q]))
    visits = [0, 0]
    pivots.expand(group, rows, k, visits)
    return visits[0] / visits[1], {int(i): sorted(h, reverse=True) for i, h in zip(group.ids, group.best, strict=True)}


def test_the_index_prunes(data):
    table = pq.read_table(data.replace("sf0.001", "sf0.1") + "/embeddings.parquet")
    ids, v = table.column("vec_id").to_numpy(), np.floor(256 * np.array(table.column("embedding").to_pylist(), float))
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(100, 64))
    near = np.floor(256 * (centres[rng.integers(0, 100, 8000)] + 0.1 * rng.normal(size=(8000, 64))))
    for what, most, i, x in (("test vectors", 0.5, ids, v), ("clusters", 0.02, np.arange(8000), near)):
        share, best = visited(i, x)
        print(f"{what}: {share:.4f} of all pairs are scored")
        assert share < most
        for q, heap in list(best.items())[:20]:
            at = np.flatnonzero(i == q)[0]
            got = (x @ x[at]).astype(np.int64)
            assert heap == sorted(((int(s), -int(j)) for s, j in zip(got, i) if j != q), reverse=True)[:5]


def test_queries_that_repeat_an_id_are_queries_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0])]
    out = pivots.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 2).collect()
    assert sorted(tuple(r) for r in out) == sorted([(0, 1, 1, 2 * 65536), (0, 2, 2, 0), (0, 1, 2, 3 * 65536), (0, 2, 1, 0)])


def test_passes_of_few_queries(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sorted(tuple(r) for r in pivots.top_k(df, 3, "id % 10 = 0").collect())
    monkeypatch.setattr(pivots, "PASS", 8 * 8 * 9)
    monkeypatch.setattr(pivots, "BLOCK", 7)
    assert sorted(tuple(r) for r in pivots.top_k(df, 3, "id % 10 = 0").collect()) == want and len(want) == 150


def test_stages_with_clashing_columns_ties_and_long_texts(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    long = " ".join(word() for _ in range(100_000))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, long), (4, long + " x"), (5, None), (6, ""), (None, "a b c d e f"), (7, 'pwd = "Xk29wQz71Lp"')]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("score", "__score", "kept", "class_id", "key", "id", "part", "ids", "offset", "findings", "words", "component", "node", "label"):
        docs = docs.withColumn(c, F.lit("clash"))
    spark.createDataFrame([(3, 1, 0), (1, 1, 0), (99, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["quality"](spark, docs, str(tmp_path)).columns == docs.columns
    one = stages["near_duplicates"](spark, docs, "")
    assert sorted((r["doc_id"] or 0, r["score"]) for r in one.collect()) == [(i, "clash") for i in (0, 1, 3, 5, 6, 7)]
    clean = stages["secrets"](spark, docs, "")
    assert clean.columns == docs.columns and clean.count() == len(rows) and clean.where("doc_id = 7").first()["text"] == 'pwd = "[SECRET]"'
    assert stages["packing"](spark, docs, "").select("doc_id").distinct().count() == 8
