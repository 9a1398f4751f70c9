import random
import time
import wave
from collections import Counter
from io import BytesIO
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.config import SearchConfig, as_bool, as_int, checked_request
from lodestone.functions import audio, classify, markdown, text
from lodestone.operators import graph, vectors
from lodestone.plans import extraction, ingest, search, tasks, watch
from lodestone.sources import tables


def test_config():
    told = SearchConfig.from_env({"TOP_K": "x", "MAX_HOPS": "4", "VECTOR_BACKEND": "odd", "MIN_SCORE_THRESHOLD": "0.3"})
    assert (told.top_k, told.hops, told.backend, told.min_score) == (3, 4, "qdrant", 0.3)
    assert as_int(" 7 ", 1) == 7 and as_bool("yes", False) and not as_bool("0", True) and as_bool(None, True)
    assert checked_request(b" hi ", 0, None) == ("hi", 3, 2)
    for bad in (("", 1, 1), ("x" * 2001, 1, 1), ("x", 51, 1), ("x", 1, 11)):
        with pytest.raises(ValueError):
            checked_request(*bad)


def test_audio(spark):
    assert audio.samples(np.array([-2.0, 0.0, 0.5])).tolist() == [-32767, 0, 16383]
    with wave.open(BytesIO(audio.wav(np.zeros(10), 8000))) as f:
        assert (f.getnchannels(), f.getsampwidth(), f.getframerate(), f.getnframes()) == (1, 2, 8000, 10)
    assert [r[0] for r in spark.createDataFrame([("a",), ("a" * 100,)], "t string").select(audio.silence_seconds(F.col("t"))).collect()] == [0.3, 4.0]


def test_extraction_falls_back(spark):
    def chat(prompt: str) -> str:
        if "fail" in prompt:
            raise RuntimeError("no model")
        return '```json\n{"concepts": [{"name_en": "From Model"}],}\n```' if "json" in prompt else "The domain: law"

    rows = spark.createDataFrame([(1, "json please"), (2, "Deep Learning fail"), (3, "Some Law text")], "key long, content string")
    out = {r["key"]: (r["answered"], [e["name_en"] for e in r["entities"]]) for r in extraction.extract(rows, chat, 1, 0).collect()}
    assert out == {1: (True, ["From Model"]), 2: (False, ["Deep Learning"]), 3: (False, ["Some Law"])}
    assert {r["key"]: r["domain"] for r in extraction.domains(rows, chat).collect()} == {1: "general", 2: "general", 3: "law"}


def test_watch(spark):
    held = watch.Indexes()
    assert held.create("v", "VECTOR", ("A",), ("embedding",)) and not held.create("v", "VECTOR", (), ()) and held.exists("v")
    assert held.table(spark).count() == 1 and held.drop("v") and not held.drop("v")
    seen = []
    s = watch.Scheduler(lambda: seen.append(1) or 1 / (len(seen) - 1), 0.01)
    assert s.start()
    while len(s.results) < 2:
        pass
    s.stop()
    assert isinstance(s.results[0], ZeroDivisionError) and s.results[1] == 1.0
    parts = spark.createDataFrame([(True, 1.0), (None, 3.0)], "healthy boolean, used double")
    assert not watch.all_healthy(parts) and not watch.all_healthy(parts.limit(0)) and watch.usage_alerts(parts, 2.0).count() == 1
    points = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "id long, embedding array<float>")
    assert watch.approximate(points, [3.0, 0.0], 1).first()["id"] == 3


def test_options(spark):
    found = spark.createDataFrame([(1, "t"), (2, "t"), (3, "t")], "doc_id long, term string")
    order = spark.createDataFrame([(1, 2), (2, 1), (3, 3)], "doc_id long, seq int")
    assert sorted((r["src"], r["dst"]) for r in graph.related(found, None, order).collect()) == [(1, 2), (3, 1), (3, 2)]
    edges = spark.createDataFrame([("a", "b", "T"), ("b", "c", "T")], "src string, dst string, type string")
    seeds = spark.createDataFrame([("a",)], "id string")
    assert [r["chain"] for r in graph.expand(edges, seeds, 2, compat=True).collect()] == ["T:outgoing", "T:outgoing>T:incoming"]
    row = spark.createDataFrame([("story of a plot", ["ทดสอบ", "ทดสอบ"])], "t string, k array<string>")
    assert tuple(row.select(classify.both(F.col("t")).alias("x")).first()["x"])[:2] == ("fiction", "en")
    assert row.select(markdown.auto_key_terms(F.lit("ทดสอบ ทดสอบ"), F.col("k")).alias("x")).first()["x"] == ["ทดสอบ"]
    assert row.select(text.segmented(F.col("t"), lambda: str.split).alias("x")).first()["x"] == ["story", "of", "a", "plot"]
    nodes = spark.createDataFrame([("a", None), ("b", None)], "id string, embedding array<float>")
    out = {r["id"]: (r["matched"], r["embedding"] is not None) for r in ingest.embed_nodes(nodes, spark.createDataFrame([("a", "x"), ("z", "y")], "id string, content string")).collect()}
    assert out == {"a": (True, True), "b": (False, False)}


def test_chunk_modes(spark):
    docs = spark.createDataFrame([(1, "on Alpha. Beta words here. Gamma! Tiny 9 delta epsilon zeta eta theta. End of it."), (2, None), (3, "漢字" * 40)], "doc_id long, content string")
    plain = {(r["doc_id"], r["chunk_id"]): r["content"] for r in ingest.chunks(docs, 30, None, 0.3).collect()}
    sents = ["on Alpha.", "Beta words here.", "Gamma!", "Tiny 9 delta epsilon zeta eta theta.", "End of it."]
    overlap = min(int(sum(map(len, sents)) / 5 * 0.3), 9)
    first = "on Alpha. Beta words here."
    tail = first[-overlap:].split(" ")[-1]
    assert plain[1, 0] == first and plain[1, 1] == f"{tail} Gamma!" and plain[1, 4] == "End of it."
    assert [len(v) for k, v in sorted(plain.items()) if k[0] == 3] == [30, 9 + 1 + 30, 9 + 1 + 20]  # three bytes a character, and the tail of the one before
    thai = ingest.chunks(docs.where("doc_id = 1"), 12, 0, mode="thai", tokenizer=lambda: lambda t: t.split(" ")).collect()
    assert all(len(r["content"]) <= 12 for r in thai) and " ".join(r["content"] for r in thai) == docs.first()["content"]

    class Alike:
        def encode(self, texts):
            return np.array([[1.0, 0.0] if "a" in t else [0.0, 1.0] for t in texts])

    def chunked(model):
        return [r["content"] for r in ingest.chunks(docs.where("doc_id = 1"), 60, 0, mode="semantic", model=model).orderBy("chunk_id").collect()]

    assert chunked(Alike) == ["on Alpha.", "Beta words here.", "Gamma! Tiny 9 delta epsilon zeta eta theta.", "End of it."] or chunked(Alike)[0].startswith("on Alpha. Beta")

    class Broken:
        def encode(self, texts):
            raise RuntimeError("no")

    assert chunked(Broken) == chunked(None) == [r["content"] for r in ingest.chunks(docs.where("doc_id = 1"), 60, 0).orderBy("chunk_id").collect()]
    with pytest.raises(ValueError):
        ingest.chunks(docs, mode="odd")


def test_reingest_replaces_by_document(spark, tmp_path):
    out = f"file://{tmp_path}/store"
    docs = spark.createDataFrame([(1, "on Alpha Beta. Text."), (2, "Alpha Beta again.")], "doc_id long, content string")
    ingest.ingest(docs, out)
    ingest.ingest(spark.createDataFrame([(2, "Gamma Delta now."), (3, "Alpha Beta too.")], "doc_id long, content string"), out)
    assert {r["doc_id"]: r["content"] for r in spark.read.parquet(f"{out}/points").collect()} == {1: "on Alpha Beta. Text.", 2: "Gamma Delta now.", 3: "Alpha Beta too."}
    assert {r["name"]: r["count"] for r in spark.read.parquet(f"{out}/graph/terms").collect()} == {"alpha beta": 2, "gamma delta": 1, "text": 1} | {k: 1 for k in ()}
    near = spark.read.parquet(f"{out}/graph/edges").where("type = 'RELATED_TO'")
    assert sorted((r["src"], r["dst"]) for r in near.collect()) == [("1", "3"), ("3", "1")]


def test_a_failed_ingest_leaves_what_was_there(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "time", SimpleNamespace(sleep=lambda s: None))  # not the module's own, which others wait by
    out = f"file://{tmp_path}/store"
    docs = spark.createDataFrame([(1, "on Alpha Beta. Text."), (2, "Alpha Beta again.")], "doc_id long, content string")
    ingest.ingest(docs, out)

    class Broken:
        def encode(self, texts):
            raise RuntimeError("model")

    with pytest.raises(ingest.SagaError) as e:
        ingest.ingest(spark.createDataFrame([(1, "Other words.")], "doc_id long, content string"), out, Broken)
    assert e.value.step == "points" and sorted(p.name for p in (tmp_path / "store").iterdir()) == ["graph", "points"]
    assert spark.read.parquet(f"{out}/points").count() == 2 and spark.read.parquet(f"{out}/graph/documents").count() == 2


def test_failing_compensations_are_told():
    done = []

    def fail():
        raise RuntimeError("no")

    saga = ingest.Saga([("a", lambda: done.append("a"), lambda: done.append("-a")), ("b", lambda: done.append("b"), fail), ("c", fail, fail)], wait=0)
    with pytest.raises(ingest.SagaError):
        saga.execute()
    assert done == ["a", "b", "-a"] and any(x[2].startswith("not compensated") for x in saga.log)
    assert ingest.run_steps([("x", lambda: None), ("y", lambda: False), ("z", fail)]) == [("x", True, None), ("y", False, None)]
    assert ingest.dual_write(lambda: None, fail) == {"ok": True, "partial": True, "errors": {"second": "RuntimeError: no"}}
    with pytest.raises(ValueError):
        ingest.stages(None, [("one", None)], "", resume="two")


def test_tool_answers(spark):
    row = spark.createDataFrame([("q", "block", 3)], "query string, context_block string, total_nodes long")
    slow = lambda q: (time.sleep(2), row)[1]

    def fail(q):
        raise RuntimeError("x" * 600)

    run = lambda f, q="q": search.run_tool(spark, f, q, 0.5)
    assert run(lambda q: row) == '# Search Results for: "q"\n\n**Found 3 related nodes**\n\nblock'
    assert "Search timed out" in run(slow) and "0.5 seconds" in run(slow)
    assert run(fail).endswith("> ❌ **Search error:** " + "x" * 497 + "...\n") and "Empty query" in run(fail, b"  ")
    assert search.execute_tool(spark, "other", {}, fail) == '# Tool Error\n\n> Unknown tool: "other"'
    assert search.execute_tool(spark, "search_knowledge_graph", {"search_query": "q"}, lambda q: row).endswith("block")


def test_sources_of_documents(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, raw in (("a.pdf", b"%PDF one"), ("b.pdf", b"bad"), ("c.pub", b"pub"), ("d.txt", b"text")):
        (folder / name).write_bytes(raw)

    def pdf(path, content):
        if not content.startswith(b"%PDF"):
            raise ValueError("not a PDF")
        return content.decode()[4:], 1

    assert tables.convert_folder(spark, str(folder), f"file://{tmp_path}/out", tables.by_extension(pdf)) == 1
    assert {p.name: p.read_text() for p in (tmp_path / "out").glob("*.md")} == {"a.md": "one"}
    assert tables.convert_folder(spark, str(folder), f"file://{tmp_path}/more", tables.by_extension(tables.first_of(pdf), lambda p, c: b"%PDF two")) == 3
    assert (tmp_path / "more" / "b.md").read_text().startswith("Extracted content from b.pdf") and (tmp_path / "more" / "c.md").read_text() == "two"
    assert tables.by_extension(pdf)("x.doc", b"") == ("", 0)
    path = f"file://{tmp_path}/points"
    assert tables.ensure_collection(spark, path, 4) and not tables.ensure_collection(spark, path, 4)
    with pytest.raises(ValueError):
        tables.ensure_collection(spark, path, 5)


def test_embedders(spark):
    sent = []

    def post(url, body):
        sent.append((url, body))
        return {"data": [{"embedding": [1.0, 2.0]} for _ in body["input"]]}

    model = vectors.ExternalEmbedder("http://host/v1", "m", post)
    assert model.encode(["a", "b"]).tolist() == [[1.0, 2.0]] * 2 and sent[0] == ("http://host/v1/embeddings", {"model": "m", "input": ["a", "b"]})
    with pytest.raises(RuntimeError):
        vectors.ExternalEmbedder("u", "m", lambda u, b: {"data": []}).encode(["a"])
    assert vectors.valid_embedder(vectors.HashingEmbedder, 64) and not vectors.valid_embedder(vectors.HashingEmbedder, 65) and not vectors.valid_embedder(lambda: None)
    tries = []
    assert tasks.retry(lambda: tries.append(1) or len(tries) if len(tries) else tries.append(1) or 1 / 0, wait=0) == 2


def test_indexes_and_models(spark):
    held = watch.Indexes()
    held.create("v", "VECTOR", ("A", "B"), ("embedding",), 2)
    nodes = spark.createDataFrame([("A", [1.0, 2.0]), ("B", None), ("C", [1.0])], "label string, embedding array<double>")
    assert held.verify("v", nodes) and not held.verify("v", nodes.unionByName(nodes.where("label = 'C'").withColumn("label", F.lit("A")))) and not held.verify("w", nodes) and not held.verify("v", nodes.drop("embedding"))
    slot = watch.ModelSlot()
    assert slot.load("a", lambda: 1) == slot.load("a", lambda: 2) == 1 and slot.load("b", lambda: 3) == 3 and slot.unload() and not slot.unload()
    assert slot.history == [("load", "a"), ("unload", "a"), ("load", "b"), ("unload", "b")]


def test_search_of_three_fields_and_long_paths(spark):
    docs = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, None)], "doc_id long, title string")
    nodes = spark.createDataFrame([(1, "n1", "x", None), (1, "n2", "y", None), (2, "n3", "z", "Alphabet"), (3, "n4", "ALPHA one", "alpha")], "doc_id long, node string, name string, title string")
    assert [tuple(r) for r in graph.keyword_search(docs, nodes, "alpha").collect()] == [(1, "alpha", 2), (2, "beta", 1), (3, None, 1)]
    rng = random.Random(4)
    held = sorted({(rng.randrange(6), f"t{rng.randrange(5)}") for _ in range(16)})
    edges = [(a, b, t) for a, t in held for b, u in held if t == u and a != b]
    want = Counter()
    for a in edges:
        for path in [[a]] if a[0] == 0 else []:
            want[a[1]] += 1
            for b in edges:
                if b[0] == a[1]:
                    want[b[1]] += 1
                    want.update(c[1] for c in edges if c[0] == b[1] and c not in (a, b))
    found = {r["doc_id"]: r["strength"] for r in graph.related_documents(spark.createDataFrame(held, "doc_id long, term string"), 0, 3).collect()}
    assert found == {k: v for k, v in want.items() if v}
