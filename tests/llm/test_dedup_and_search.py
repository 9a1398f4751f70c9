"""Near-duplicates of texts and vectors, and exact top-k, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import bagminhash, pivots, vectors
from lodestone.llm.shared import components, joined


def roots(n, links):
    return joined(n, *(np.array(x, int) for x in zip(*links))) if links else np.arange(n)


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(rng.randrange(60, 160), rng.randrange(60, 160)) for _ in range(70)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame([*links, (None, 3), (5, 5)], "a long, b long")).collect()}
    low = roots(160, links)
    assert found == {i: low[i] for i in {x for a, b in links if a != b for x in (a, b)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def texts(n=160, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    out = []
    for _ in range(6):
        base = [word() for _ in range(rng.randrange(30, 120))]
        for _ in range(n // 8):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    out += ["one two", "One, two!", "", None, "...", "repeat " * 50, "repeat " * 48, out[0], out[0]]
    rng.shuffle(out)
    return out


def want_classes(rows):
    bags, by = {}, {}
    for i, t in rows:
        s = bagminhash.shingles(t)
        if i is not None and len(s):
            bags[i] = np.unique(s, return_counts=True)
    ids = sorted(bags)
    links = [(x, y) for x in range(len(ids)) for y in range(x) if bagminhash.overlap(bags[ids[x]], bags[ids[y]]) >= 0.8]
    low = roots(len(ids), links)
    by = {ids[k]: ids[low[k]] for k in range(len(ids))}
    return {i: by.get(i, i) for i, _ in rows}


@pytest.mark.parametrize(("small", "block"), [(24, 512), (2, 3)])
def test_classes_are_components_of_all_links(spark, monkeypatch, small, block):
    monkeypatch.setattr(bagminhash, "SMALL", small)
    monkeypatch.setattr(bagminhash, "BLOCK", block)
    rows = [(1000 - i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").withColumn("class_id", F.lit("clash")).withColumn("words", F.lit(0)).repartition(4)
    found = bagminhash.classes(df).collect()
    want = want_classes(rows)
    assert len(found) == len(rows) + 1 and {r["doc_id"]: r["class_id"] for r in found} == want
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in found)


def test_rows_that_repeat_an_id_are_one_document(spark):
    same, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    out = bagminhash.classes(spark.createDataFrame([(1, other), (2, same), (2, other), (2, other)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["class_id"], r["kept"]) for r in out) == [(1, 1, True), (2, 1, False), (2, 1, False), (2, 1, False)]


def test_every_text_of_a_repeated_id_is_compared(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, b), (2, a), (2, b), (3, c), (4, b), (4, d), (4, d), (5, d + " end"), (6, None), (6, a + " end"), (7, None), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["class_id"], r["kept"]) for r in bagminhash.classes(df).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 3, True), (4, 1, False), (5, 1, False), (6, 1, False), (7, 7, True), (None, None, True)}
    left = corpus_pipeline.near_duplicate_stage(spark, df.withColumn("n_chars", F.length("text")), "")
    want = [(1, b), (2, a), (3, c), (4, d), (6, None), (7, None), (None, a)]
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(str((i, t, t and len(t))) for i, t in want)


def test_classes_of_nothing(spark):
    assert bagminhash.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    out = bagminhash.classes(spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, None)], "doc_id long, text string")).collect()
    assert [(r["class_id"], r["kept"]) for r in sorted(out, key=lambda r: str(r["doc_id"]))] == [(1, True), (None, True), (None, True)]


def test_signatures_are_unbiased():
    rng, off = np.random.default_rng(5), []
    for _ in range(150):
        v = np.sort(rng.integers(0, 2**63, 200, dtype=np.uint64))
        a = rng.integers(1, 9, 200)
        b = np.where(rng.random(200) < 0.5, a, rng.integers(1, 9, 200))
        s = bagminhash.signatures([(v, a), (v, b)])
        off.append((s[0] == s[1]).mean() - bagminhash.overlap((v, a), (v, b)))
    assert abs(np.mean(off)) < 4 * np.std(off) / len(off) ** 0.5


def vector_rows(seed=0, d=24):
    rng, out = np.random.default_rng(seed), []
    for k in range(30):
        base = rng.normal(size=d)
        for _ in range(rng.integers(1, 14)):
            out.append(((base + rng.normal(size=d) * rng.uniform(0, 0.45)).astype(np.float32).tolist(), int(k % 3)))
    out += [out[0]] * 4 + [([0.0] * d, 0), (None, 1), ([1.0] * d, None), ([float("nan")] * d, 1), ([None] * d, 1), ([1.0, 2.0], 1), ([2.0, 4.0], 1), ([], 1), ([float("inf")] * d, 2)]
    return [(i, v, y) for i, (v, y) in enumerate(out)]


@pytest.mark.parametrize("block", [512, 3])
def test_vector_links(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1)).withColumn("key", F.lit(1)).repartition(3)
    found = {r["vec_id"]: r for r in vectors.near_duplicates(df).collect()}
    ok = [r for r in rows if r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links = [(a[0], b[0]) for a in ok for b in ok if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1]) and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93]
    low, count = roots(len(rows), links), np.zeros(len(rows), int)
    for a, b in links:
        count[[a, b]] += 1
    assert len(links) > 100 and len(found) == len(rows)
    lost = sum(count) - sum(r["n_links"] for r in found.values())
    assert 0 <= lost <= 0.01 * sum(count)
    assert all(found[i]["n_links"] <= count[i] for i in found)
    if not lost:
        assert {i: r["component_id"] for i, r in found.items()} == dict(enumerate(low))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.values())


def test_vector_links_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vectors.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    out = vectors.near_duplicates(spark.createDataFrame([(None, [1.0], 1), (1, [1.0], 1), (2, [1.0], 1), (2, [1.0], 1)], schema)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in out) == [(0, 0, 0), (1, 2, 1), (2, 2, 1), (2, 2, 1)]


def test_recall_at_the_threshold():
    rng = np.random.default_rng(0)
    a = vectors.normal(rng.normal(size=(1500, 64)))
    r = rng.normal(size=(1500, 64))
    r = vectors.normal(r - (r * a).sum(1, keepdims=True) * a)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * r
    for rotations in (1, 2, 3):
        x, y = vectors.codes(a.astype(np.float32), rotations), vectors.codes(b.astype(np.float32), rotations)
        met = ((x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)).any(1)
        assert met.mean() > 0.98


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_top_k_is_exact(spark, scale):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=6) * scale).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, rows[10][1]) for i in range(30)] + [(430, None), (431, [float("nan")] * 6), (432, [None] * 6), (None, [1.0] * 6), (450, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(0)).withColumn("rank", F.lit(0)).repartition(4)
    found = {}
    for r in pivots.top_k(df, 5, "id % 50 = 0").collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for i, q in ok:
        if i % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(q, v)), j) for j, v in ok if j != i)[:5]
            want[i] = [(k + 1, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for k, (s, j) in enumerate(best)]
    assert {k: sorted(v) for k, v in found.items()} == want


def test_top_k_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert pivots.top_k(spark.createDataFrame([], schema)).count() == 0
    assert pivots.top_k(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    assert [tuple(r) for r in pivots.top_k(spark.createDataFrame([(0, [1.0]), (1, [-1.0])], schema)).collect()] == [(0, 1, 1, -65536)]


def test_top_k_of_many_lengths(spark):
    other = spark.range(3000).select((F.col("id") * 50 + 1).alias("vec_id"), F.expr("array_repeat(float(1), int(id) + 1)").alias("embedding"))
    own = spark.createDataFrame([(50 * n, [0.5] * n) for n in (700, 1400, 2100, 2800)], "vec_id long, embedding array<float>")
    found = {tuple(r) for r in pivots.top_k(other.unionByName(own)).collect()}
    assert found == {(50 * n, 1, 50 * (n - 1) + 1, n * 128 * 256) for n in (700, 1400, 2100, 2800)}


def test_annuli_alone_leave_out_clustered_rows():
    """The share of (query, vector) pairs that whole annuli are left out by at the final
    scores, and that by all bounds."""
    rng, k = np.random.default_rng(0), 5
    centres = rng.normal(size=(100, 64))
    v = np.floor(pivots.SCALE * (centres[rng.integers(0, 100, 12000)] + 0.3 * rng.normal(size=(12000, 64))))
    ids = np.arange(len(v))
    it = pivots.Index(ids[: pivots.SAMPLE], v[: pivots.SAMPLE], k)
    d, size = it.angles(v), pivots.lengths(v)
    near = d.argmin(1)
    r, q = d[ids, near], ids[::50]
    order = np.lexsort((r, near))
    rows = []
    for p in np.unique(near):
        mine = order[near[order] == p]
        for a in range(0, len(mine), pivots.BLOCK):
            some = mine[a : a + pivots.BLOCK]
            rows.append({"pivot": p, "inner": r[some[0]], "outer": r[some[-1]], "least": size[some].min(), "most": size[some].max(), "ids": ids[some].astype("<i8").tobytes(), "vectors": v[some].tobytes()})
    products = v[q] @ v.T
    products[np.arange(len(q)), q] = -np.inf
    best = np.sort(products, 1)[:, -k]
    far = it.angles(v[q])
    alone = sum((pivots.reach(far[:, x["pivot"]], x["inner"], x["outer"], x["least"], x["most"], size[q]) < best).sum() * len(x["ids"]) // 8 for x in rows) / products.size
    group, visits = pivots.Group(it, np.arange(len(q)), q, v[q], it.first(q, v[q])), [0, 0]
    pivots.expand(group, rows, k, visits)
    assert alone >= 0.3 and visits[0] <= 0.02 * visits[1]
    got = {int(i): sorted(((s, -j) for s, j in heap), key=lambda x: (-x[0], x[1])) for i, heap in zip(group.ids, group.best, strict=True)}
    for n, i in enumerate(q):
        top = np.lexsort((ids, -products[n]))[:k]
        assert got[int(i)] == [(int(products[n, j]), int(j)) for j in top]
