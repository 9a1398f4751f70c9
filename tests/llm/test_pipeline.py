"""The pipeline on a small corpus of known documents, and the registered queries."""

import random

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lodestone.llm import bagminhash, quality, queries


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, folder = random.Random(3), tmp_path_factory.mktemp("corpus")
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    good = [" ".join(word() for _ in range(60)) for _ in range(120)]
    junk = [" ".join(word() + "###" for _ in range(60)) for _ in range(60)]
    near = [g.replace(g.split()[30], "changed", 1) for g in good[:10]]
    secret = [good[0][::-1] + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"']
    texts = [*good, *junk, *near, *secret, good[5], None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), texts


def test_stages(spark, corpus):
    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, folder)
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert set(range(120)) <= ids and not ids & set(range(120, 180)) and kept.columns == docs.columns
    one = corpus_pipeline.near_duplicate_stage(spark, docs, folder)
    left = [r["doc_id"] for r in one.select("doc_id").collect()]
    assert len(left) == len(set(left)) and not set(left) & set(range(180, 190)) and 191 not in left and {190, 192, 193} <= set(left)
    clean = corpus_pipeline.secret_stage(spark, docs, folder)
    masked = clean.where("doc_id = 190").first()
    assert clean.count() == docs.count() and masked["text"].endswith('token = "[SECRET]"') and masked["n_chars"] == len(masked["text"])
    pieces = corpus_pipeline.packing_stage(spark, docs, folder)
    assert pieces.where("size(ids) <> length").count() == 0


def test_run_keeps_what_brute_force_keeps(spark, corpus):
    folder, texts = corpus
    model = queries.quality_model(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    alive = [i for i, t in enumerate(texts) if model.score(t) >= corpus_pipeline.KEEP]
    bags = {i: np.unique(bagminhash.shingles(texts[i]), return_counts=True) for i in alive if texts[i]}
    want = [i for i in alive if i not in bags or not any(j < i and bagminhash.overlap(bags[i], bags[j]) >= 0.8 for j in bags)]
    found = corpus_pipeline.run(spark, folder)
    assert sorted({r["doc_id"] for r in found.select("doc_id").collect()}) == want
    assert isinstance(model, quality.Model) and corpus_pipeline.ORACLE_SQL is None


def test_empty_corpus(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus[0]).count() == 0


def test_registered():
    names = entry.queries()
    assert all(sum(q.startswith(f"op{n}_") for q in names) == 1 for n in range(1, 14)) and "pipeline" in names


def test_sql_of_the_operators(spark, data):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got, want = queries.QUERIES[name](spark, data).toPandas(), c.execute(sql).df()[list(queries.QUERIES[name](spark, data).columns)]
        key = list(got.columns)[:2]
        a, b = (x.sort_values(key).astype(object).where(x.notna(), None).values.tolist() for x in (got, want))
        # integers among nulls are floats in pandas
        plain = lambda rows: [[str(int(v)) if isinstance(v, float) else str(v) for v in r] for r in rows]
        assert plain(a) == plain(b), name
