import itertools
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lodestone.operators import graph, limiter, llm_json, metrics, mutation, ranking, rendering, vectors
from lodestone.plans import ingest, search, tasks
from lodestone.sources import tables


def got(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_sections_of_a_random_tree(spark):
    random.seed(5)
    levels = [random.randint(1, 6) for _ in range(60)]
    docs = spark.createDataFrame([(1, "\n".join(f"{'#' * v} t{i}\ntext" for i, v in enumerate(levels)))], "doc_id long, content string")
    for idx, parent in got(graph.sections(docs), "idx", "parent_id"):
        want = next((j for j in range(idx - 1, -1, -1) if levels[j] < levels[idx]), None)
        assert parent == ("" if want is None else f"1_section_{want}")


def test_expand_chain_diamond_and_loops(spark):
    edges = spark.createDataFrame([("a", "b", "T"), ("b", "c", "T"), ("c", "d", "T"), ("d", "e", "T"), ("a", "x", "S"), ("x", "c", "S"), ("b", "b", "T"), ("c", "a", "U")], "src string, dst string, type string")
    seeds = spark.createDataFrame([("a",), (None,), ("",)], "id string")
    assert got(graph.expand(edges, seeds, 1), "id", "hops", "chain") == [("b", 1, "T:outgoing"), ("c", 1, "U:incoming"), ("x", 1, "S:outgoing")]
    assert got(graph.expand(edges, seeds, 9), "id", "hops") == [("b", 1), ("c", 1), ("x", 1), ("d", 2), ("e", 3)]
    assert got(graph.expand(edges, seeds, 3, 2), "id") == [("b",), ("c",)]


def test_related_members_hold_every_pair(spark):
    held = [*((d, "common") for d in range(25)), (3, "rare"), (4, "rare"), (5, "alone"), (3, "rare")]
    found = spark.createDataFrame(held, "doc_id long, term string")
    pairs = {(r["src"], r["dst"], r["via_term"]) for r in graph.related(found).collect()}
    of = {}
    for r in graph.related_members(found).collect():
        of.setdefault(r["via_term"], []).append(r["doc_id"])
        assert r["n_docs"] == {"common": 25, "rare": 2}[r["via_term"]]
    assert {(a, b, t) for t, ids in of.items() for a in ids for b in ids if a != b} == pairs and len(pairs) == 25 * 24 + 2
    edges = spark.createDataFrame([("1", "x", "MENTIONS_TERM"), ("1", "2", "RELATED_TO")], "src string, dst string, type string")
    assert sorted(map(tuple, graph.edge_counts(edges, found).collect())) == [("MENTIONS_TERM", 1, 1, 1), ("RELATED_TO", len(pairs), 25, 25)]


def test_related_documents_counts_paths(spark):
    random.seed(2)
    held = sorted({(random.randrange(7), f"t{random.randrange(6)}") for _ in range(25)})
    by = {d: {t for x, t in held if x == d} for d in range(7)}
    c = lambda a, b: len(by[a] & by[b]) if a != b else 0
    for hops in (1, 2):
        want = Counter()
        for y in range(7):
            want[y] = c(0, y) + (sum(c(0, x) * c(x, y) for x in range(7)) if hops == 2 else 0)
        found = dict(got(graph.related_documents(spark.createDataFrame(held, "doc_id long, term string"), 0, hops), "doc_id", "strength"))
        assert found == {k: v for k, v in want.items() if v}


def test_top_k_many_takes_any_number_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(7)
    points = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(40, 4)).tolist())], "id long, embedding array<double>")
    queries = points.withColumnRenamed("id", "query")
    want = sorted(map(tuple, vectors.top_k_many(points, queries, 3).collect()))
    monkeypatch.setattr(vectors, "MAX_QUERIES", 16)
    found = sorted(map(tuple, vectors.top_k_many(points, queries, 3).collect()))
    assert len(found) == 120 and [f[:2] + f[3:] for f in found] == [w[:2] + w[3:] for w in want]


def test_combine_and_order(spark):
    rows = spark.createDataFrame([("a", 0.5, 0), ("b", 0.9, 1), ("a", 0.95, 2), ("", 1.0, 3), (None, 1.0, 4), ("c", 0.9, 5), ("b", 0.9, 6)], "id string, score double, pos int")
    assert got(ranking.combine(rows), "id", "score", "pos") == [("a", 0.95, 2), ("b", 0.9, 1), ("c", 0.9, 5)]


def test_fusion_with_one_sided_documents_and_zero_scores(spark):
    v = spark.createDataFrame([(1, "x", 0.8), (1, "y", 0.9), (2, "z", 0.2)], "doc_id long, content string, score double")
    g = spark.createDataFrame([(2, 4), (3, 2)], "doc_id long, score long")
    assert got(ranking.fuse(v, g), "doc_id", "content", "score") == [(2, "z", 0.6), (1, "y", 0.45), (3, "", 0.25)]
    zero = spark.createDataFrame([(3, 0)], "doc_id long, score long")
    assert got(ranking.fuse(v, zero), "doc_id", "score") == [(1, 0.45), (2, 0.1), (3, 0.0)]


def test_top_k_many_is_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(300, [0.0] * 8), (301, None)]
    points = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    queries = points.where("id < 4").withColumnRenamed("id", "query")
    many = vectors.top_k_many(points, queries, 7)
    for q in range(4):
        single = vectors.top_k(points, rows[q][1], 7)
        assert got(many.where(F.col("query") == q).orderBy("rank"), "id") == got(single, "id")
    assert vectors.top_k(points, [0.0] * 8, 3).count() == 0


def test_upserts_keep_what_changes_leave_out(spark):
    nodes = spark.createDataFrame([("Hardware", "a", "n", "d")], "label string, id string, name_en string, domain string")
    changes = spark.createDataFrame([(1, "Hardware", "a", None, "x"), (2, "Hardware", "a", "m", None), (3, "Nope", "b", "q", "q"), (4, "Strategy", None, "q", "q"), (5, "Strategy", "s", "v", None)], "seq int, label string, id string, name_en string, domain string")
    assert sorted(got(mutation.upsert_nodes(nodes, changes), "label", "id", "name_en", "domain"), key=str) == [("Hardware", "a", "m", "x"), ("Strategy", "s", "v", None)]
    assert sorted(got(mutation.rejected_nodes(changes), "reason")) == [("id missing",), ("unknown label",)]
    edges = spark.createDataFrame([("a", "s", "PREDICTS", 1.0)], "src string, dst string, type string, weight double")
    more = spark.createDataFrame([(1, "a", "s", "PREDICTS", 2.0), (2, "a", "zz", "PREDICTS", 3.0), (3, "s", "a", "ODD", 3.0)], "seq int, src string, dst string, type string, weight double")
    known = spark.createDataFrame([("a",), ("s",)], "id string")
    assert got(mutation.upsert_edges(edges, more, known), "src", "dst", "weight") == [("a", "s", 2.0)]
    assert got(mutation.unmatched_edges(more, known), "dst") == [("zz",)]


def test_log_limiter_at_the_edge():
    lim = limiter.LogLimiter(2, 10)
    assert [lim.take(t)[0] for t in (0, 1, 2, 9, 10, 11, 12)] == [True, True, False, False, True, True, False]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 200), max_size=80), st.integers(1, 4), st.integers(1, 40))
def test_log_limiter_never_exceeds(times, most, window):
    lim, kept = limiter.LogLimiter(most, window), []
    for t in sorted(times):
        if lim.take(t)[0]:
            kept.append(t)
    assert all(sum(t - window < x <= t for x in kept) <= most for t in kept)


def test_histogram_and_latency(spark):
    rows = spark.createDataFrame([("e", 200, 0.5), ("e", 404, 1.0), ("e", 302, 1000.0), ("e", 500, None)], "endpoint string, status int, duration double")
    assert got(metrics.histogram(rows), "le", "bucket")[:2] == [("0.5", 1), ("1.0", 2)] and got(metrics.histogram(rows), "bucket")[-1] == (3,)
    assert got(metrics.totals(rows), "total", "success", "failed", "error_rate") == [(4, 2, 2, 0.5)]
    assert got(metrics.totals(rows.limit(0)), "total", "error_rate") == [(0, 0.0)]
    many = spark.createDataFrame([("e", float(i)) for i in range(40)], "endpoint string, duration double")
    assert got(metrics.latency(many, "endpoint"), "least", "most", "p95") == [(0.0, 39.0, 38.0)]


def test_json_repair(spark):
    cases = {
        '```json\n{"a": 1,}\n```': '{"a": 1}', 'so: {"a": [1, 2, ]} ok': '{"a": [1, 2]}', '{"a": {"b": 2}} and } bad': '{"a": {"b": 2}}', "[1]": "[1]", "nothing": "nothing", '{"a": 1': '{"a": 1',
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    found = dict(got(rows.select("t", llm_json.repaired(F.col("t")).alias("x")), "t", "x"))
    assert {k: v for k, v in found.items() if k != '{"a": {"b": 2}} and } bad'} == {k: v for k, v in cases.items() if k != '{"a": {"b": 2}} and } bad'}


def test_validation(spark):
    rows = spark.createDataFrame([('{"concepts": [{"name_en": "x", "domain": null}], "hardware": 3}',), ("[1]",), (None,)], "t string")
    out = [r["v"] for r in rows.select(llm_json.validated(F.col("t"), F.lit("k")).alias("v")).collect()]
    assert out[0]["concepts"][0]["domain"] == "unknown" and out[0]["concepts"][0]["name_th"] == "" and out[0]["hardware"] == [] and len(out[0]["concepts"][0]["id"]) == 64
    assert out[1] is None and out[2] is None


def test_heuristic_entities_compute_the_domain_once(spark):
    rows = spark.createDataFrame([(1, ["Alpha", "pay $1 \\\\ now", None]), (2, [])], "id long, terms array<string>")
    # a domain that is another one each time it is computed
    found = rows.select("id", llm_json.heuristic(F.col("terms"), F.uuid(), F.col("id").cast("string")).alias("e"))
    got = {r["id"]: r["e"] for r in found.collect()}
    assert got[2] == [] and len({e["domain"] for e in got[1]}) == 1
    for e, term in zip(got[1], ["Alpha", "pay $1 \\\\ now", None], strict=True):
        for k, v in llm_json.TEMPLATES.items():
            assert e[k] == (None if term is None and "{term}" in v else v.replace("{term}", term or ""))


def test_rendering(spark):
    nodes = spark.createDataFrame([(0, 0, "a", "Hardware", "A", None, 0.5), (0, 1, "b", "Odd", None, "B", 0.9), (0, 2, "a", "Hardware", "Z", None, 1.0), (0, 3, None, "Odd", "Q", "Q", 1.0)], "query int, pos int, id string, label string, name_en string, name_th string, score double")
    text = rendering.assemble(nodes, "en").first()["context"]
    assert text.index("## Hardware") < text.index("## Additional Information") and "Z" not in text and text.count("N/A") == 12
    block = rendering.context_block(nodes, nodes.limit(0)).first()
    assert block["total_nodes"] == 2 and "## 1. B" in block["context_block"] and "Relevance: 0.9000" in block["context_block"]
    assert "search_knowledge_graph" in rendering.tool_schema()


def test_saga_compensates_in_reverse():
    done = []
    fail = lambda: (_ for _ in ()).throw(RuntimeError("no"))
    saga = ingest.Saga([("a", lambda: done.append("a"), lambda: done.append("-a")), ("b", lambda: done.append("b"), lambda: done.append("-b")), ("c", fail, lambda: done.append("-c"))], wait=0)
    with pytest.raises(ingest.SagaError) as e:
        saga.execute()
    assert e.value.index == 2 and done == ["a", "b", "-b", "-a"] and [x[3] for x in saga.log if x[1] == "c"] == [1, 2, 3]


def test_ingest_writes_and_undoes(spark, tmp_path):
    docs = spark.createDataFrame([(1, "on Alpha Beta. Text here. More text."), (2, "Alpha Beta again.")], "doc_id long, content string")
    out = f"file://{tmp_path}/store"
    assert [x[2] for x in ingest.ingest(docs, out)] == ["done", "done"]
    assert spark.read.parquet(f"{out}/points").count() == 2 and spark.read.parquet(f"{out}/graph/edges").where("type = 'RELATED_TO'").count() == 2

    class Broken:
        def encode(self, texts):
            raise RuntimeError("model")

    ingest_broken = lambda: ingest.ingest(docs, f"file://{tmp_path}/other", Broken)
    ingest.time.sleep, kept = (lambda s: None), ingest.time.sleep
    try:
        with pytest.raises(ingest.SagaError):
            ingest_broken()
    finally:
        ingest.time.sleep = kept
    assert not (tmp_path / "other" / "graph").exists()


def test_stages_resume(spark, tmp_path):
    df, ran = spark.range(3), []
    steps = [("one", lambda d: (ran.append("one"), d.withColumn("x", F.lit(1)))[1]), ("two", lambda d: (ran.append("two"), d.withColumn("y", F.lit(2)))[1])]
    ingest.stages(df, steps, f"file://{tmp_path}")
    assert ingest.stages(df, steps, f"file://{tmp_path}", resume="two").columns == ["id", "x", "y"] and ran == ["one", "two", "two"]


def test_semantic_chunks(spark):
    rows = [(1, 0, "Aa.", [1.0, 0.0]), (1, 1, "Bb.", [0.9, 0.1]), (1, 2, "Cc.", [-1.0, 0.0]), (1, 3, "Dd.", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "doc_id long, pos int, sentence string, embedding array<double>")
    assert [r[0] for r in sorted(got(ingest.semantic_chunks(df), "content", "group"), key=lambda r: r[1])] == ["Aa. Bb.", "Cc.", "Dd."]


def test_tasks_isolate_failures(spark):
    out = tasks.run_tasks(spark.createDataFrame([("1",), ("x",)], "item string"), lambda s: str(int(s) + 1), tries=2)
    assert sorted(got(out, "item", "success", "result")) == [("1", True, "2"), ("x", False, None)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"%PDF-1")
    (tmp_path / "b.txt").write_bytes(b"x")
    (tmp_path / "c.pub").write_bytes(b"x" * 100)
    files = tables.scan_files(spark, str(tmp_path), content=True)
    assert [r["path"].rsplit("/", 1)[1] for r in files.collect()] == ["a.PDF", "c.pub"]
    assert got(files.select(tables.upload_status(F.col("content")).alias("s")), "s") == [(200,), (400,)]

    def converter(path, content):
        if not content.startswith(b"%PDF"):
            raise ValueError("not a PDF")
        return " text ", 1

    assert sorted(got(tables.convert(files, converter), "success", "text", "pages")) == [(False, "", 0), (True, "text", 1)]
    assert tables.safe_path(str(tmp_path / "a"), str(tmp_path)) and not tables.safe_path(str(tmp_path) + "2/a", str(tmp_path))


def test_stores(spark):
    good = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<double>")
    stores = search.Stores({"a": good, "b": spark.createDataFrame([(1, [1.0])], "id long, embedding array<double>")}, "a", 2)
    assert not stores.switch("b") and not stores.switch("zz") and got(stores.search([1.0, 0.0], 1), "id") == [(1,)]


def test_embedder_is_deterministic(spark):
    v = [r["v"] for r in spark.createDataFrame([("a b",), ("a b",), (None,)], "t string").select(vectors.embed(F.col("t")).alias("v")).collect()]
    assert v[0] == v[1] and len(v[0]) == 64 and not any(v[2])


def test_everything_in_permutations_is_stable(spark):
    rows = [("a", 1.0, 0), ("b", 1.0, 1), ("c", 0.5, 2)]
    for p in itertools.permutations(rows):
        assert got(ranking.combine(spark.createDataFrame(list(p), "id string, score double, pos int")), "id") == [("a",), ("b",), ("c",)]
