"""The registered quality query against a slow scorer: feature by feature, without hashing
together, caches or runs."""

import math
import zlib

import numpy as np

import __spark_entry__ as entry
from lodestone.llm import quality, queries


def slow(model, text):
    words = (text or "").split()
    total = count = 0.0
    for w in words:
        buckets = [zlib.crc32(f"<{w}>".encode(), 1) & (quality.BUCKETS - 1)]
        codes = [ord(c) for c in f"<{w}>"]
        for n in quality.GRAMS:
            for a in range(len(codes) - n + 1):
                h = n
                for c in codes[a : a + n]:
                    h = (h ^ c) * int(quality.PRIME) % 2**64
                    h ^= h >> 29
                buckets.append(h & (quality.BUCKETS - 1))
        total += sum(float(model.logits[b]) for b in buckets)
        count += len(buckets)
    again = quality.REPEAT * sum(a == b for a, b in zip(words, words[1:]))
    total, count = total + again * float(model.logits[quality.SAME]), count + again
    return 1 / (1 + math.exp(-(total / (count + quality.PRIOR) + model.bias)))


def test_registered_query(spark, data):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in entry.queries()["op7_quality"](spark, data).collect()}
    assert set(got) == set(docs)
    model = queries.quality_model(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{data}/labels.parquet"))
    for i, text in docs.items():
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i]["predicted"] == (got[i]["score"] >= 0.5)
        if i % 7 == 0:
            assert abs(got[i]["score"] - slow(model, text)) < 1e-4


def test_unfolded_model(monkeypatch):
    """Mean of vectors, layer and softmax, of the vectors that training ends with."""
    held = {}
    made = quality.Model

    def kept(logits, bias):
        held["frame"] = (logits, bias)
        return made(logits, bias)

    monkeypatch.setattr(quality, "Model", kept)
    rows = [(*quality.counted(t), k) for k, t in [(0, "junk junk spam"), (1, "good words here"), (0, "spam spam"), (1, "more good text")] * 5]
    model = quality.train(rows)
    for text in ("good text", "spam junk", "", "a new word"):
        buckets, counts = quality.counted(text)
        # softmax of two classes is the logistic function of the difference of their logits
        mean = sum(int(c) * float(held["frame"][0][b]) for b, c in zip(buckets, counts)) / (counts.sum() + quality.PRIOR)
        assert abs(model.score(text) - 1 / (1 + math.exp(-(mean + held["frame"][1])))) < 1e-4
    assert model.score("good text") > 0.5 > model.score("spam junk")


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.score(docs, quality.Model(np.zeros(quality.BUCKETS), 0.0)).count() == 0
