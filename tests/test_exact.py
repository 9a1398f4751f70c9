"""Exact rounding, files in pieces, domains by a model, shared hit rows, legacy labels."""

import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.functions import classify
from lodestone.operators import mutation, vectors
from lodestone.plans import extraction
from lodestone.sources import uploads


def test_half_even_is_pythons_round(spark):
    r = random.Random(1)
    values = [a / b for b in range(1, 120) for a in range(b + 1)]
    values += [k / 1000 for k in range(-3000, 3000)] + [k / 8 for k in range(-80, 80)] + [math.nextafter(k / 200, x) for k in range(400) for x in (-9.0, 9.0)]
    values += [r.uniform(-1e6, 1e6) for _ in range(4000)] + [r.random() * 10.0 ** r.randrange(-300, 12) for _ in range(2000)] + [0.0, 5e-324, 1e9 + 0.125, 4503599627370.495]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 2, 3, 7):
        got = {row["v"]: row["x"] for row in df.select("v", classify.half_even(F.col("v"), digits).alias("x")).collect() if abs(row["v"]) * 10**digits < 2**50}
        assert len(got) > 10000
        for v, x in got.items():
            assert x == round(v, digits), (v, digits)
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (1e300,), (None,)], "v double").select(classify.half_even(F.col("v")).alias("x")).collect()
    assert math.isnan(odd[0]["x"]) and odd[1]["x"] == float("inf") and odd[2]["x"] == 1e300 and odd[3]["x"] is None
    with pytest.raises(ValueError):
        classify.half_even(F.col("v"), 8)
    assert sum(round(v, 2) != math.floor(abs(v) * 100 + 0.5) / 100 for v in values if 0 <= v <= 1) > 50  # it matters


def test_uploads_in_pieces(spark, tmp_path):
    contents = {"a.pdf": b"%PDF" + os.urandom(5000), "b.PDF": b"%PDF", "c.pdf": b"HTML" * 999, "d.pdf": b"", "e.pdf": b"%PDF" + b"x" * 20000, "f.txt": b"%PDFx", "g.pdf": b"%PDF" + b"y" * 9996, "h.pdf": b"%PD"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "folder.pdf").mkdir()
    pieces = uploads.uploads(spark, str(tmp_path), piece=1000, cap=10_000, partition=70_000).cache()
    assert pieces.rdd.getNumPartitions() == 7  # a file a partition, as each costs its opening
    rows = pieces.collect()
    assert all(r["data"] is None or len(r["data"]) <= 1000 for r in rows) and all(n == 1 for n in Counter((r["path"], r["number"]) for r in rows).values())
    told = {os.path.basename(r["path"]): (r["status"], r["bytes"], r["pieces"]) for r in uploads.statuses(pieces).collect()}
    assert told == {"a.pdf": (200, 5004, 6), "b.PDF": (200, 4, 1), "c.pdf": (400, 1000, 0), "d.pdf": (400, 0, 0), "e.pdf": (413, 11000, 10), "g.pdf": (200, 10000, 10), "h.pdf": (400, 3, 0)}
    whole = {}
    for r in sorted(uploads.accepted(pieces).collect(), key=lambda r: r["number"]):
        whole[os.path.basename(r["path"])] = whole.get(os.path.basename(r["path"]), b"") + r["data"]
    assert whole == {n: contents[n] for n in ("a.pdf", "b.PDF", "g.pdf")}
    assert uploads.uploads(spark, str(tmp_path), extensions="none").count() == 0
    assert uploads.uploads(spark, f"file://{tmp_path}", extensions="txt").count() == 2
    with pytest.raises(Exception, match="piece"):
        uploads.uploads(spark, str(tmp_path), piece=2).count()


def test_files_are_written_by_name(spark, tmp_path):
    parts = spark.createDataFrame([(f"n{k % 3}", k, bytes([k]) * 3) for k in range(30)], "name string, id long, data binary")
    assert uploads.write_files(parts, F.lit("%PDF"), f"file://{tmp_path}/out") == 3
    for k in range(3):
        assert (tmp_path / "out" / f"n{k}").read_bytes() == b"%PDF" + b"".join(bytes([i]) * 3 for i in range(k, 30, 3))


def test_domains_by_model(spark):
    def chat(text):
        if "fail" in text:
            raise RuntimeError("no")
        return "This is Mathematics." if "prove" in text else "unsure"

    rows = spark.createDataFrame([(1, "prove it"), (2, "market fail of a stock"), (3, "fail"), (4, " "), (5, None), (6, "other"), (7, "prove it")], "key long, content string")
    got = {r["key"]: (r["domain"], r["confidence"]) for r in extraction.domains(rows, chat).collect()}
    assert got == {1: ("mathematics", 0.8), 2: ("finance", 0.2), 3: ("general", 0.0), 4: ("general", 0.0), 5: ("general", 0.0), 6: ("general", 0.8), 7: ("mathematics", 0.8)}
    with pytest.raises(ValueError):
        classify.domain(F.col("content"), "odd")


def test_hits_have_one_schema(spark):
    bare = vectors.hits(spark.createDataFrame([("a",)], "id string")).first()
    assert bare.asDict(True) == {"id": "a", "content": "", "score": 0.0, "metadata": {"doc_id": "", "chunk_id": 0}}
    full = vectors.hits(spark.createDataFrame([("a", 0.5, "x", 7, None, "more")], "id string, score double, content string, doc_id long, chunk_id int, other string")).first()
    assert full.asDict(True) == {"id": "a", "content": "x", "score": 0.5, "metadata": {"doc_id": "7", "chunk_id": 0}}


def test_legacy_labels(spark):
    rows = [(1, ["Document", "ContentAsset"], True), (2, ["Term"], False), (3, ["Term"], None), (4, ["Section", "Document"], True), (5, [], True), (6, None, True), (7, ["Hardware"], True)]
    nodes = spark.createDataFrame(rows, "id long, labels array<string>, migrated boolean")
    got = {r["id"]: (r["labels"], r["type_legacy"]) for r in mutation.remove_legacy_labels(nodes).collect()}
    assert got == {1: (["ContentAsset"], "Document"), 2: (["Term"], None), 3: (["Term"], None), 4: ([], "Section"), 5: ([], None), 6: (None, None), 7: (["Hardware"], None)}
    kept = mutation.remove_legacy_labels(nodes.withColumn("type_legacy", F.lit("Old"))).where("id in (4, 7)").orderBy("id").collect()
    assert [r["type_legacy"] for r in kept] == ["Section", "Old"]
