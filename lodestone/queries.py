"""Queries of the retrieval operators on the test tables, one an operator family; their
SQL is in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.functions import classify, markdown, text
from lodestone.operators import adjacency, cells, graph, limiter, llm_json, metrics, mutation, ranking, rendering, text_index, vector_index, vectors
from lodestone.plans import corpus, extraction, ingest, search, tasks
from lodestone.sources import store, tables, uploads

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), markdown.from_html(F.col("html")).alias("content"))


def _talks(spark: SparkSession, d: str, head: str) -> DataFrame:
    """Conversations as documents: a line made by ``head`` and the text of each turn."""
    rows = tables.table(spark, d, "conversations").withColumn("line", F.expr(head))
    return rows.groupBy(F.col("conv_id").alias("doc_id")).agg(rendering.joined(F.col("line"), F.col("turn"), "\n").alias("content"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _vector(spark: SparkSession, d: str, k: int = 0) -> list[float]:
    """The vector of id k; empty, which finds nothing, if there is none."""
    row = _points(spark, d).where((F.col("id") == k) & F.col("embedding").isNotNull()).first()
    return row["embedding"] if row else []


def _requests(spark: SparkSession, d: str) -> DataFrame:
    e = tables.table(spark, d, "events")
    return e.select(F.col("event_type").alias("endpoint"), (200 + 100 * (F.col("event_id") % 4)).cast("int").alias("status"), F.col("value").alias("duration"), F.col("event_id").alias("id"), "ts", "user_id")


@query
def sentence_split(spark, d):
    return text.each(_docs(spark, d), ["doc_id"], text.sentences(F.col("content")), "sentence")


@query
def chunk_character(spark, d):
    return ingest.chunks(_docs(spark, d))


@query
def chunk_ratio(spark, d):
    return ingest.chunks(_docs(spark, d), overlap=None)


@query
def chunk_bytes(spark, d):
    told = F.concat(F.expr("repeat('漢字かな😀', cast(200 + page_id % 7 as int))"), F.lit("x"), F.col("page_id").cast("string"))
    return ingest.chunks(tables.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), told.alias("content")))


@query
def overlap_size(spark, d):
    return _docs(spark, d).select("doc_id", text.overlap_chars(text.sentences(F.col("content"))).alias("overlap"))


@query
def tts_split(spark, d):
    return text.each(_docs(spark, d), ["doc_id"], text.speech_chunks("content"), "chunk")


@query
def stream_slices(spark, d):
    return text.each(tables.table(spark, d, "pages"), ["page_id"], tables.text_slices(F.col("html")), "slice")


@query
def byte_split(spark, d):
    return text.each(_docs(spark, d), ["doc_id"], text.byte_split(F.col("content"), 1500), "piece").select("doc_id", "pos", F.octet_length("piece").alias("bytes"), F.md5("piece").alias("digest"))


@query
def detect_language(spark, d):
    return _docs(spark, d).select("doc_id", classify.language(F.col("content")).alias("l")).select("doc_id", "l.*")


@query
def detect_domain(spark, d):
    return _docs(spark, d).select("doc_id", classify.domain(F.col("content")).alias("l")).select("doc_id", "l.*")


@query
def model_domain(spark, d):
    told = F.concat(F.lit(" The domain is "), F.lower("p_type"), F.when(F.col("p_partkey") % 3 == 0, " medicine").when(F.col("p_partkey") % 3 == 1, " law").otherwise(""))
    return tables.table(spark, d, "part").select("p_partkey", classify.model_domain(told).alias("domain"))


@query
def front_matter(spark, d):
    docs = tables.table(spark, d, "documents")
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("---\na: b\n---\n"), "text")).otherwise(F.col("text"))
    told = markdown.front_matter(content, classify.domain(content)["domain"], classify.language(content)["language"], F.concat("source", F.lit(".pdf")), "2024-01-01T00:00:00Z")
    return docs.select("doc_id", F.md5(told).alias("digest"), F.char_length(told).alias("n"))


@query
def html_markdown(spark, d):
    return _pages(spark, d).select(F.col("doc_id").alias("page_id"), F.md5("content").alias("digest"), F.char_length("content").alias("n"))


HEADINGS = "concat(repeat('#', cast(1 + (turn * 7) % 4 as int)), ' ', role, ' ', turn, '\\n', coalesce(text, ''))"


@query
def sections(spark, d):
    return graph.sections(_talks(spark, d, HEADINGS))


@query
def titles(spark, d):
    return _pages(spark, d).select("doc_id", markdown.title(F.col("content")).alias("title"))


@query
def links(spark, d):
    return graph.items(_pages(spark, d), markdown.links(F.col("content")), "link")


@query
def code_blocks(spark, d):
    docs = _talks(spark, d, "concat('```', if(turn % 2 = 0, role, ''), '\\n', coalesce(text, ''), '\\n```')")
    return graph.items(docs, markdown.code_blocks(F.col("content")), "code").select("doc_id", "id", "language", F.md5("code").alias("digest"))


@query
def key_terms(spark, d):
    return text.each(_docs(spark, d), ["doc_id"], markdown.key_terms(F.col("content")), "term")


@query
def term_graph(spark, d):
    return graph.terms(graph.mentions(_docs(spark, d)))


@query
def graph_edges(spark, d):
    # RELATED_TO edges, the pairs of a term's documents, are counted and not listed
    made = graph.build(_pages(spark, d), pairs=False)
    return graph.edge_counts(made["edges"], made["mentions"])


@query
def related_edges(spark, d):
    return graph.related_members(graph.mentions(_docs(spark, d)))


def _items(spark, d):
    return tables.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("content"))


@query
def related_pairs(spark, d):
    return graph.related(graph.mentions(_items(spark, d)))


@query
def related_before(spark, d):
    """Shared terms with the items ingested before, which came by falling id."""
    items = _items(spark, d)
    return graph.related(graph.mentions(items), order=items.select("doc_id", (-F.col("doc_id")).alias("seq")))


@query
def keyword_fields(spark, d):
    """Search of customers' names and segments, and of their nations' names."""
    docs = tables.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.col("n_name").alias("title"))
    nodes = tables.table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("doc_id"), F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("name"), F.col("c_name").alias("title"))
    return graph.keyword_search(docs, nodes, "000001 BUILD nation_1 more")


@query
def stage_resume(spark, d):
    """Stages that are resumed at the second: the first is read as it was."""
    folder = tables.scratch(spark)
    rows = tables.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    one = lambda c: ("one", lambda df: df.withColumn("x", F.col("o_orderkey") + c))
    two = lambda c: ("two", lambda df: df.groupBy((F.col("x") % 10).alias("x")).agg(F.count("*").alias("n"), (F.max("o_orderkey") * c).alias("most")))
    ingest.stages(rows, [one(0), two(1)], folder)
    return ingest.stages(rows, [one(5), two(2)], folder, resume="two")


@query
def entity_extraction(spark, d):
    """Entities of items by a model that answers for even ids and fails for others."""

    def chat(content):
        if len(content) % 2:
            raise RuntimeError("no answer")
        return f'```json\n{{"concepts": [{{"name_en": "c{len(content)}", }}]}}\n```'

    rows = tables.table(spark, d, "benchmark").select(F.col("item_id").alias("key"), F.col("text").alias("content"))
    out = extraction.extract(rows, chat, tries=1)
    return out.select("key", "answered", F.when(F.col("answered"), F.array_join(F.transform("entities", lambda e: e["name_en"]), ",")).otherwise("").alias("names"))


@query
def related_paths(spark, d):
    return graph.related_documents(graph.mentions(_items(spark, d)), 0, 3)


@query
def graph_search(spark, d):
    def build(name):
        # pages are converted once, for titles, sections and terms
        path = store.scratch(spark)
        _pages(spark, d).write.parquet(path)
        docs = spark.read.parquet(path)
        nodes = graph.sections(docs).select("doc_id", F.col("section_id").alias("node"), F.col("title").alias("name"))
        nodes = nodes.unionByName(graph.mentions(docs).select("doc_id", F.col("term").alias("node"), F.col("term").alias("name")))
        text_index.TextIndex.build(docs.select("doc_id", markdown.title(F.col("content")).alias("title")), nodes, name)
        store.delete(spark, path)

    # the nodes and their trigrams are stored once
    return text_index.TextIndex(spark, _stored(spark, d, "names", ("pages",), build)).search("The and of ation, the tion")


@query
def related_docs(spark, d):
    return graph.related_documents(graph.mentions(_docs(spark, d)), 0)


def _star(spark, d):
    t = lambda n: tables.table(spark, d, n)
    e = lambda df, a, x, b, y, kind: df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"), F.lit(kind).alias("type"))
    out = e(t("nation"), "region:", "n_regionkey", "nation:", "n_nationkey", "HAS_NATION")
    out = out.unionByName(e(t("supplier"), "supplier:", "s_suppkey", "nation:", "s_nationkey", "BASED_IN"))
    return out.unionByName(e(t("customer"), "customer:", "c_custkey", "nation:", "c_nationkey", "LIVES_IN")).unionByName(e(t("orders"), "customer:", "o_custkey", "order:", "o_orderkey", "PLACED"))


def _stored(spark, d, kind, names, build):
    """The name of stored tables made of some tables of d, once for the files as they are."""
    name = f"lodestone_{kind}_{store.fingerprint(spark, *[f'{d}/{n}.parquet' for n in names])}"
    if not spark.catalog.tableExists(f"{name}_done"):
        build(name)
        store.bucketed(spark.range(1), f"{name}_done", "id", 1)
    return name


@query
def expand_hops(spark, d):
    # the edges are stored once, by node
    name = _stored(spark, d, "star", ("nation", "supplier", "customer", "orders"), lambda n: adjacency.Adjacency.build(_star(spark, d), f"{n}_edges"))
    seeds = spark.createDataFrame([("nation:3",), ("region:1",), ("",)], "id string")
    return graph.expand(adjacency.Adjacency(spark, f"{name}_edges"), seeds, 2, None)


@query
def expand_compat(spark, d):
    """Two hops, the second with incoming steps alone, by name."""
    return graph.expand(_star(spark, d), spark.createDataFrame([("nation:3",), ("region:1",)], "id string"), 2, None, compat=True)


@query
def expand_limit(spark, d):
    return graph.expand(_star(spark, d), spark.createDataFrame([("nation:3",)], "id string"), 3, 50)


@query
def expand_labels(spark, d):
    edges = _star(spark, d)
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    nodes = ids.select("id", F.initcap(F.element_at(F.split("id", ":"), 1)).alias("label"))
    return graph.expand(edges, spark.createDataFrame([("nation:3",), ("region:1",)], "id string"), 2, None, nodes=nodes, labels=("Customer", "Region"))


@query
def vector_topk(spark, d):
    return vectors.top_k(_points(spark, d).drop("label"), _vector(spark, d), 10).withColumn("score", F.round("score", 6))


@query
def vector_topk_many(spark, d):
    points = _points(spark, d)
    found = vectors.top_k_many(points, points.where("id % 20 = 0").select(F.col("id").alias("query"), "embedding"), 10, mode="unit")
    return found.withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("int"))


def _indexes(spark):
    return vector_index.VectorIndex(spark, f"{tables.scratch(spark)}/indexes")


@query
def vector_index_recall(spark, d):
    """Of the exact neighbours of ids divisible by 20, whether the index finds 0.9."""
    points, indexes = _points(spark, d), _indexes(spark)
    asked = points.where("id % 20 = 0").select(F.col("id").alias("query"), "embedding")
    indexes.create("vectors", points)
    told = vector_index.recall(indexes.search("vectors", asked), vectors.top_k_many(points, asked))
    return told.select("asked", (F.col("recall") >= 0.9).alias("good"))


@query
def vector_index_catalogue(spark, d):
    """Indexes that are made, made again, changed, and dropped, as the catalogue tells."""
    points, indexes = _points(spark, d), _indexes(spark)
    indexes.create("all", points)
    indexes.create("some", points, 64, ("1", "2", "3"))
    indexes.create("some", points.limit(0))
    indexes.create("gone", points.where("label = 4"))
    indexes.drop("gone")
    # ids divisible by 10 turn round, those that leave 1 are no vectors any more, and new ones come
    turned = F.when(F.col("id") % 10 == 0, F.transform("embedding", lambda x: -x))
    changes = points.where("id % 10 < 2").withColumn("embedding", turned).withColumn("seq", F.lit(2))
    changes = changes.unionByName(points.where("id % 10 = 0").withColumn("seq", F.lit(1))).unionByName(points.where("id % 100 = 7").withColumn("id", -F.col("id")).withColumn("seq", F.lit(1)))
    indexes.put("all", changes)
    good = {r["name"]: indexes.verify(r["name"])["ok"] for r in indexes.list().collect()}
    ok = F.coalesce(*[F.when(F.col("name") == n, F.lit(v)) for n, v in good.items()])
    return indexes.list().select("name", "type", "labels", "properties", "dimensions", "vectors", ok.alias("ok"))


@query
def semantic_groups(spark, d):
    return vectors.semantic_groups(_points(spark, d), "label", "id", "embedding", 0.1).select("id", "label", F.col("group").cast("long").alias("group"))


@query
def hybrid_fusion(spark, d):
    hits = vectors.top_k(_points(spark, d).drop("label"), _vector(spark, d), 20)
    hits = hits.select(F.floor(F.col("id") / 2).cast("long").alias("doc_id"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("content"), "score")
    near = graph.related_documents(graph.mentions(_docs(spark, d)), 0, 1).select("doc_id", F.col("strength").alias("score"))
    out = ranking.fuse(hits, near)
    return out.select("doc_id", "content", *[F.round(c, 6).alias(c) for c in ("vector_score", "graph_score", "score")])


def _corpus(spark, d):
    docs = tables.table(spark, d, "documents")
    name = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    edges = docs.select(name.alias("src"), F.concat(F.lit("source:"), "source").alias("dst"), F.lit("FROM_SOURCE").alias("type"))
    points = _points(spark, d)
    edges = edges.unionByName(points.select(F.concat(F.lit("doc:"), F.col("id").cast("string")).alias("src"), F.concat(F.lit("label:"), F.col("label").cast("string")).alias("dst"), F.lit("HAS_LABEL").alias("type")))
    nodes = docs.select(name.alias("id"), F.lit("ContentAsset").alias("label"), F.concat_ws(" ", F.upper("lang"), "source").alias("name_en"))
    return points.select(F.concat(F.lit("doc:"), F.col("id").cast("string")).alias("id"), "embedding"), edges, nodes


@query
def hybrid_search(spark, d):
    points, edges, nodes = _corpus(spark, d)
    rows = search.hybrid_search(points, edges, nodes, _vector(spark, d), 3, 2, 50)
    return rows.select("id", F.round("score", 6).alias("score"), "hops", "chain", "label", "name_en")


@query
def dedupe_rank(spark, d):
    rows = _points(spark, d).select((F.col("id") % 100).alias("id"), F.element_at("embedding", 1).cast("double").alias("score"), F.col("id").alias("pos"))
    return ranking.combine(rows).select("id", "pos", F.round("score", 6).alias("score"))


def _two_stores(spark, d):
    """The nearest other points of ids divisible by 20 in two stores, of which the second
    lacks some points and scores otherwise."""
    points = _points(spark, d).drop("label")
    asked = points.where("id % 20 = 0").select(F.col("id").alias("query"), "embedding")
    near = lambda p, mode: cells.ranked(vectors.top_k_many(p, asked, 21, mode=mode).drop("rank").where("id <> query"), 20).drop("rank")
    return near(points, "cosine"), near(points.where("id % 3 <> 0"), "unit")


@query
def dual_merge(spark, d):
    a, b = _two_stores(spark, d)
    return ranking.merge_backends(a, b, ["query", "id"]).select("query", "id", F.round("score", 6).alias("score"), "backend")


@query
def parity_report(spark, d):
    a, b = _two_stores(spark, d)
    return ranking.parity(a, b).select("query", "id", F.round("delta", 6).alias("delta"))


@query
def parity_counts(spark, d):
    return ranking.parity_counts(*_two_stores(spark, d))


def _node_changes(spark, d):
    c, o = tables.table(spark, d, "customer"), tables.table(spark, d, "orders")
    name = lambda x: F.concat(F.lit("c"), F.col(x).cast("string")).alias("id")
    nodes = c.select(F.lit("ContentAsset").alias("label"), name("c_custkey"), F.col("c_name").alias("name_en"), F.col("c_mktsegment").alias("domain"))
    label = F.when(F.col("o_orderkey") % 10 == 0, "Unknown").otherwise("ContentAsset").alias("label")
    return nodes, o.select(F.col("o_orderkey").alias("seq"), label, name("o_custkey"), F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderpriority")).alias("name_en"), F.col("o_orderstatus").alias("domain"))


@query
def node_upsert(spark, d):
    return mutation.upsert_nodes(*_node_changes(spark, d))


@query
def node_rejects(spark, d):
    return mutation.rejected_nodes(_node_changes(spark, d)[1]).groupBy("reason").agg(F.count("*").alias("n"))


def _edge_changes(spark, d):
    li, o, p = (tables.table(spark, d, t) for t in ("lineitem", "orders", "part"))
    s = lambda a, c: F.concat(F.lit(a), F.col(c).cast("string"))
    changes = li.select((F.col("l_linenumber") * 100 + F.col("l_quantity").cast("long")).cast("long").alias("seq"), s("o", "l_orderkey").alias("src"), s("p", "l_partkey").alias("dst"), F.when(F.col("l_linenumber") == 7, "OTHER").otherwise("APPLIES_TO").alias("type"), F.col("l_quantity").alias("weight"))
    nodes = o.where("o_orderkey % 2 = 0").select(s("o", "o_orderkey").alias("id")).unionByName(p.where("p_partkey % 5 < 4").select(s("p", "p_partkey").alias("id")))
    return changes, nodes


@query
def edge_upsert(spark, d):
    changes, nodes = _edge_changes(spark, d)
    return mutation.upsert_edges(changes.limit(0).drop("seq"), changes, nodes)


@query
def edge_unmatched(spark, d):
    changes, nodes = _edge_changes(spark, d)
    return mutation.unmatched_edges(changes, nodes).groupBy("type").agg(F.count("*").alias("n"))


@query
def embedding_set_delete(spark, d):
    points = _points(spark, d)
    rows = points.select("id", F.when(F.col("id") % 2 == 0, F.col("embedding")).alias("embedding"))
    rows = mutation.set_embeddings(rows, points.where("id % 3 = 0").select("id", "embedding")).withColumnRenamed("matched", "was_set")
    rows = mutation.delete_embeddings(rows, points.where("id % 5 = 0").select("id"))
    return rows.select("id", "was_set", F.col("matched").alias("was_deleted"), F.col("embedding").isNotNull().alias("has"))


@query
def point_upsert(spark, d):
    old = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("point_id"), F.col("c_name").alias("content"))
    new = tables.table(spark, d, "supplier").select(F.col("s_suppkey").alias("point_id"), F.col("s_name").alias("content"))
    gone = tables.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("point_id"))
    return mutation.delete_points(mutation.upsert_points(old, new), gone)


@query
def dual_write_outcome(spark, d):
    e = tables.table(spark, d, "events")
    return e.select("event_id", mutation.dual_outcome(F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0).alias("o")).groupBy("o.ok", "o.partial").agg(F.count("*").alias("n"))


@query
def migrate_nodes(spark, d):
    docs = _pages(spark, d)
    found = graph.mentions(docs)
    done = docs.where("doc_id % 7 = 0").select(F.col("doc_id").cast("string").alias("id"))
    return mutation.migrate_nodes(docs.select("doc_id", markdown.title(F.col("content")).alias("title")), graph.sections(docs), graph.terms(found), done)


@query
def migrate_edges(spark, d):
    return mutation.migrate_edges(graph.build(_talks(spark, d, HEADINGS), pairs=False)["edges"], chapters=True)


@query
def schema_check(spark, d):
    n = tables.table(spark, d, "nation")
    return mutation.schema_check(n.select(F.col("n_name").alias("name")), n.where("n_nationkey % 4 <> 0").select(F.col("n_name").alias("name")))


@query
def schema_duplicates(spark, d):
    return mutation.duplicates(tables.table(spark, d, "customer").select(F.col("c_mktsegment").alias("label"), (F.col("c_custkey") % 1000).alias("id")))


def _cards(spark, d):
    p = tables.table(spark, d, "part")
    return p.select(
        F.lit(0).alias("query"), F.col("p_partkey").alias("pos"), F.concat(F.lit("p"), (F.col("p_partkey") % 120).cast("string")).alias("id"), F.element_at(F.array(*[F.lit(x) for x in (*graph.LABELS, "Zeta")]), (F.col("p_partkey") % 6 + 1).cast("int")).alias("label"),
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("name_th"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).alias("name_en"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice") / 1000).otherwise(0.0).alias("score"),
        F.col("p_type").alias("domain"), F.col("p_name").alias("technical_desc_en"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_type")).alias("layman_explanation"), F.when(F.col("p_partkey") % 4 == 0, F.lit("like it")).alias("analogy"),
    )


@query
def context_block(spark, d):
    cards = _cards(spark, d)
    out = rendering.context_block(cards.where("pos % 3 < 2"), cards.where("pos % 3 > 0").withColumn("score", F.lit(0.0)).withColumn("hops", (F.col("pos") % 2 + 1).cast("int")))
    return out.select("query", F.md5("context_block").alias("digest"), "total_nodes", F.char_length("context_block").alias("n"))


@query
def assemble_context(spark, d):
    out = rendering.assemble(_cards(spark, d), "en", True)
    return out.select("query", F.md5("context").alias("digest"), F.char_length("context").alias("n"))


@query
def relationships_block(spark, d):
    n = tables.table(spark, d, "nation")
    rels = n.select(F.col("n_nationkey").alias("pos"), F.when(F.col("n_regionkey") == 0, "depends_on").when(F.col("n_regionkey") == 1, "causes").otherwise("near").alias("type"), F.col("n_name").alias("source"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey").cast("string")).alias("target"))
    return rendering.relationships(rels, "en")


@query
def tool_response(spark, d):
    o = tables.table(spark, d, "orders")
    asked = F.when(F.col("o_orderkey") % 10 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "o_orderpriority"))
    return o.select("o_orderkey", F.md5(rendering.tool_response(asked, F.col("o_orderkey") % 4, F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.col("o_orderstatus")))).alias("digest"))


@query
def rate_limit_log(spark, d):
    return limiter.log_limit(_requests(spark, d), 3, 86400, "user_id", "ts", "id")


@query
def rate_limit_counter(spark, d):
    out = limiter.counter_limit(_requests(spark, d), 3, 864000, 10, "user_id", "ts", "id")
    return out.withColumn("count", F.round("count", 4))


@query
def metrics_requests(spark, d):
    return metrics.by_endpoint(_requests(spark, d))


@query
def metrics_totals(spark, d):
    return metrics.totals(_requests(spark, d)).withColumn("error_rate", F.round("error_rate", 6))


@query
def metrics_histogram(spark, d):
    return metrics.histogram(_requests(spark, d), by=("endpoint",)).withColumn("sum", F.round("sum", 2))


@query
def prometheus_text(spark, d):
    return metrics.prometheus(_requests(spark, d).withColumn("duration", F.round("duration")))


@query
def latency_stats(spark, d):
    out = metrics.latency(_requests(spark, d), "endpoint")
    return out.select("endpoint", *[F.round(c, 4).alias(c) for c in ("mean", "least", "most", "p95")])


@query
def history_ring(spark, d):
    return metrics.latest(_requests(spark, d)).select("id", "user_id")


def _shout(item: str) -> str:
    if item.endswith("7"):
        raise ValueError(item)
    return item.upper()


@query
def batch_result(spark, d):
    items = tables.table(spark, d, "customer").select(F.col("c_name").alias("item"))
    out = metrics.batch_summary(tasks.run_tasks(items, _shout))
    return out.withColumn("success_rate", F.round("success_rate", 6))


@query
def json_repair(spark, d):
    e = tables.table(spark, d, "events")
    k = F.col("event_id") % 4
    told = F.when(k == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 1, F.concat(F.lit("Sure: "), "props", F.lit(" done"))).when(k == 2, F.regexp_replace("props", r"\}", ", }")).otherwise(F.col("props"))
    return e.select("event_id", llm_json.repaired(told).alias("json"))


@query
def extraction_validate(spark, d):
    n = tables.table(spark, d, "nation")
    told = F.concat(F.lit('{"concepts":[{"name_en":"'), "n_name", F.lit('","tags":[1,2]},7,{"id":"x","domain":null}],"hardware":"no"'), F.when(F.col("n_nationkey") % 5 == 0, "").otherwise(F.concat(F.lit(',"relationships":[{"source":"'), "n_name", F.lit('","target":"x","type":"USES"}]}'))))
    out = n.select("n_nationkey", llm_json.validated(told, F.col("n_name")).alias("v"), llm_json.complete(told).alias("complete"))
    out = out.select("n_nationkey", "complete", F.size("v.hardware").alias("hardware"), F.get("v.relationships", 0)["json"].alias("link"), F.posexplode_outer("v.concepts").alias("pos", "e"))
    return out.select("n_nationkey", "complete", "hardware", "link", "pos", "e.*")


@query
def heuristic_extract(spark, d):
    docs = _docs(spark, d)
    found = llm_json.heuristic(markdown.key_terms(F.col("content")), classify.domain(F.substring("content", 1, 2000))["domain"], F.col("doc_id").cast("string"))
    return text.each(docs, ["doc_id"], found, "e").select("doc_id", "pos", "e.*")


@query
def script_names(spark, d):
    o = tables.table(spark, d, "orders")
    return o.select("o_orderkey", tables.script_name(F.concat("o_orderpriority", F.lit(" / plan?")), F.lit("en"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("name"))


@query
def visual_prompts(spark, d):
    o = tables.table(spark, d, "orders")
    script = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("a\nVisual_Concept : "), "o_orderpriority", F.lit(" x\nb"))).otherwise(F.lit("no prompt"))
    voices = {"en": {"default": "e1", "e2": "e2"}, "th": {"default": "t1"}}
    return o.select("o_orderkey", classify.visual_prompt(script, F.col("o_orderstatus")).alias("prompt"), classify.voice(F.when(F.col("o_orderkey") % 2 == 0, "en").otherwise("xx"), F.when(F.col("o_orderkey") % 4 == 0, "e2").otherwise("zz"), voices).alias("voice"))


@query
def empty_search(spark, d):
    points, edges, nodes = _corpus(spark, d)
    rows = search.hybrid_search(points, edges, nodes, [0.0] * 64)  # a query that is like nothing
    return search.search_context(rows, "what is there")


@query
def assemble_nothing(spark, d):
    o = tables.table(spark, d, "orders").withColumn("query", F.col("o_orderkey"))
    nodes = o.where("query % 3 = 0").select("query", F.lit(0).alias("pos"), F.lit("n").alias("id"), F.lit("Note").alias("label"), F.lit(0.5).alias("score"), F.col("o_orderpriority").alias("name_en"), F.lit(None).cast("string").alias("name_th"))
    rels = o.where("query % 3 = 1").select("query", F.lit(0).alias("pos"), F.lit("supports").alias("type"), F.lit("a").alias("source"), F.col("o_orderstatus").alias("target"))
    return rendering.assemble(nodes, "en", False, rels=rels, asked=o)


@query
def reingest(spark, d):
    docs = tables.table(spark, d, "documents")
    out = f"{tables.scratch(spark)}/reingest"
    ingest.ingest(docs.select("doc_id", F.concat(F.lit("old "), "lang").alias("content")), out, pairs=False)
    new = docs.where("doc_id % 4 = 1").select("doc_id", F.concat(F.lit("new "), "source").alias("content"))
    more = docs.where("doc_id % 10 = 0").select((F.col("doc_id") + 1000000000).alias("doc_id"), F.concat(F.lit("more "), "lang").alias("content"))
    ingest.ingest(new.unionByName(more), out, pairs=False)
    return spark.read.parquet(f"{out}/points").select("point_id", "doc_id", "content")


@query
def stream_reingest(spark, d):
    """The batches of ``reingest`` by a stream of files, the second one put again."""
    docs, out = tables.table(spark, d, "documents"), tables.scratch(spark)
    held = corpus.Corpus(spark, f"{out}/corpus", 16)
    source = spark.readStream.schema("doc_id long, content string").parquet(f"{out}/source/*")
    docs.select("doc_id", F.concat(F.lit("old "), "lang").alias("content")).write.parquet(f"{out}/source/first")
    held.follow(source, "documents", f"{out}/checkpoint").awaitTermination()
    new = docs.where("doc_id % 4 = 1").select("doc_id", F.concat(F.lit("new "), "source").alias("content"))
    new = new.unionByName(docs.where("doc_id % 10 = 0").select((F.col("doc_id") + 1000000000).alias("doc_id"), F.concat(F.lit("more "), "lang").alias("content")))
    new.write.parquet(f"{out}/source/second")
    held.follow(source, "documents", f"{out}/checkpoint").awaitTermination()
    held.batch("again")(spark.read.parquet(f"{out}/source/second"), 1)
    return held.read("points").select("point_id", "doc_id", "content")


@query
def point_changes(spark, d):
    """Points of customers after their orders' changes, many to a point."""
    old = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("point_id"), F.col("c_name").alias("content"), F.lit(0.0).alias("total"))
    new = tables.table(spark, d, "orders").select((F.col("o_custkey") * F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(1)).alias("point_id"), F.col("o_orderpriority").alias("content"), F.col("o_totalprice").alias("total"), F.col("o_orderkey").alias("seq"))
    return mutation.upsert_points(old, new)


@query
def embedding_changes(spark, d):
    """Nodes whose embeddings are set several times, the last one counting, and deleted."""
    points = _points(spark, d)
    nodes = points.select("id", F.when(F.col("id") % 2 == 0, F.col("embedding")).alias("embedding"))
    set_ = mutation.set_embeddings(nodes, points.where("id % 6 < 3").select(F.floor(F.col("id") / 2).alias("id"), "embedding", F.col("id").alias("seq"))).withColumnRenamed("matched", "was_set")
    gone = points.where("id % 5 = 0").select((F.col("id") % 40).alias("id"))  # each many times
    out = mutation.delete_embeddings(set_, gone)
    return out.select("id", "was_set", F.col("matched").alias("was_deleted"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))


@query
def offered_load(spark, d):
    requests = tables.table(spark, d, "events").select(F.col("user_id").alias("client_id"), "ts", F.col("event_id").alias("request_id"))
    return limiter.offered_load(requests, 3600)


@query
def legacy_labels(spark, d):
    """Legacy labels of customers that were migrated, removed."""
    c = tables.table(spark, d, "customer")
    labels = F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("Document"), F.col("c_mktsegment"))).when(F.col("c_custkey") % 4 == 1, F.array(F.lit("Term"))).when(F.col("c_custkey") % 4 == 2, F.array(F.lit("Section"), F.lit("Term"))).otherwise(F.array("c_mktsegment"))
    out = mutation.remove_legacy_labels(c.select(F.col("c_custkey").alias("id"), labels.alias("labels"), F.when(F.col("c_custkey") % 5 != 4, F.col("c_custkey") % 5 < 3).alias("migrated")))
    return out.select("id", F.array_join("labels", ",").alias("labels"), "type_legacy")


@query
def store_hits(spark, d):
    """The nearest points of a vector in the schema that stores share."""
    found = vectors.top_k(_points(spark, d).withColumn("doc_id", F.col("label")).withColumn("chunk_id", F.col("id") % 7), _vector(spark, d), 25)
    return vectors.hits(found).select("id", "content", F.round("score", 6).alias("score"), F.col("metadata.doc_id").alias("doc_id"), F.col("metadata.chunk_id").alias("chunk_id"))


@query
def domain_by_model(spark, d):
    """Domains of documents by a model that fails for some."""
    docs = tables.table(spark, d, "documents")
    answer = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("It is "), F.element_at(F.array(*[F.lit(x) for x in ("Law", "physics", "fiction or law")]), (F.col("doc_id") % 9 / 3 + 1).cast("int"))))
    content = F.when(F.col("doc_id") % 11 == 0, " ").otherwise(F.concat(F.col("text"), F.lit(" the market plot")))
    return docs.select("doc_id", classify.domain(content, "llm", answer=answer).alias("l")).select("doc_id", "l.*")


@query
def upload_pieces(spark, d):
    """Files of 50 pages each, read in pieces: those of a third are of no known kind."""
    folder = f"{tables.scratch(spark)}/files"
    rows = tables.table(spark, d, "pages").where("page_id is not null").select(F.floor(F.col("page_id") / 50).alias("file"), F.col("page_id").alias("id"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("data"))
    uploads.write_files(rows.withColumn("name", F.concat(F.col("file").cast("string"), F.lit(".pdf"))), F.when(F.col("file") % 3 > 0, "%PDF").otherwise("HTML"), folder)
    told = uploads.statuses(uploads.uploads(spark, folder, piece=4096, cap=400_000))
    name = F.regexp_extract("path", r"(\d+)\.pdf$", 1).cast("long")
    taken = lambda c: F.when(F.col("status") == 200, F.col(c)).alias(c)
    return told.select(name.alias("file"), "status", taken("bytes"), taken("pieces"))


@query
def thai_terms(spark, d):
    tokens = text.segmented(F.col("text"), lambda: lambda t: t.split(" "))
    found = tables.table(spark, d, "conversations").where("text is not null").select("conv_id", F.explode(tokens).alias("w")).groupBy("conv_id").agg(F.collect_list("w").alias("w"))
    terms = found.select("conv_id", markdown.thai_key_terms(F.col("w"), 1_000_000).alias("t")).where(F.size("t") > 0)
    return terms.select("conv_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("digest"))


@query
def edge_properties(spark, d):
    li = tables.table(spark, d, "lineitem")
    s = lambda a, c: F.concat(F.lit(a), F.col(c).cast("string"))
    seq = F.unix_date(F.col("l_shipdate").cast("date")) * 10 + F.col("l_linenumber")
    flag = F.concat(F.lit("f"), (F.col("l_linenumber") % 3).cast("string"))
    changes = li.select(seq.alias("seq"), s("o", "l_orderkey").alias("src"), s("p", "l_partkey").alias("dst"), F.lit("APPLIES_TO").alias("type"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_shipdate")).alias("since"), flag.alias("flag"))
    nodes = changes.select(F.col("src").alias("id")).unionByName(changes.select(F.col("dst").alias("id")))
    return mutation.upsert_edges(changes.limit(0).drop("seq"), changes, nodes)


class _Picky(vectors.HashingEmbedder):
    """Fails on every fifth part."""

    def encode(self, texts):
        if any(t.endswith(("0", "5")) for t in texts):
            raise RuntimeError("no embedding")
        return super().encode(texts)


@query
def failing_embedder(spark, d):
    told = F.concat(F.lit("part "), F.col("p_partkey").cast("string"))
    return tables.table(spark, d, "part").select("p_partkey", F.size(vectors.embed(told, _Picky)).alias("size"))


@query
def document_routing(spark, d):
    def pdf(path, content):
        if path.endswith("3.pdf"):
            raise ValueError("not a PDF")
        return f" {content.decode()} ", 1

    kind = F.element_at(F.array(F.lit("0.pdf"), F.lit("1.txt"), F.lit("2.pub"), F.lit("3.pdf")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    files = tables.table(spark, d, "supplier").select(F.concat(F.col("s_suppkey").cast("string"), F.lit("-"), kind).alias("path"), F.encode("s_name", "UTF-8").alias("content"))
    out = tables.convert(files, tables.by_extension(pdf, lambda path, content: b"from pub"))
    return out.select(F.element_at(F.split("path", "-"), 1).cast("long").alias("s_suppkey"), "success", "text", "pages")


@query
def folder_conversion(spark, d):
    """Pages as files of three kinds that a folder's conversion makes Markdown files of, which
    are read back: text files are not taken, every fifth page fails, a .pub file goes
    through another format first."""
    folder = tables.scratch(spark)
    kind = F.element_at(F.array(*map(F.lit, ("pdf", "pub", "txt"))), (F.col("page_id") % 3 + 1).cast("int"))
    pages = tables.table(spark, d, "pages").where("page_id is not null").select(F.concat_ws(".", "page_id", kind).alias("name"), F.col("html").alias("content"))
    tables.write_files(pages, f"{folder}/in", suffix="")

    def pdf(path, content):
        if int(path.rsplit("/", 1)[-1].split(".")[0]) % 5 == 0:
            raise ValueError("damaged")
        return content.decode(), content.count(b"<p>")

    tables.convert_folder(spark, f"{folder}/in", f"{folder}/out", tables.by_extension(pdf, lambda path, content: b"from pub: " + content))
    found = tables.scan_files(spark, f"{folder}/out", ("md",), content=True, ordered=False)
    told = F.decode("content", "UTF-8")
    return found.select(F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long").alias("page_id"), F.char_length(told).cast("long").alias("n"), F.md5("content").alias("digest"))


@query
def instruction_dataset(spark, d):
    """Conversion results as a data set of instructions, written and read back."""
    path = f"{tables.scratch(spark)}/dataset"
    results = tables.table(spark, d, "documents").select(F.col("doc_id").alias("path"), (F.col("doc_id") % 7 != 0).alias("success"), "text")
    tables.write_dataset(results, path, "Summarise the document.")
    rows = spark.read.schema("instruction string, input string, output string").json(path)
    return rows.groupBy("instruction", "input", F.md5("output").alias("digest")).agg(F.count("*").alias("n"))


class _Sizes:
    """Tells texts apart by their characters and spaces; fails on those of no character."""

    def encode(self, texts):
        if not all(texts):
            raise ValueError("empty text")
        return [[len(t), t.count(" ")] for t in texts]


@query
def stored_documents(spark, d):
    """Nodes of documents with the embedding of the document's whole text; one in four
    documents is not offered, and nodes of no document stay as they are."""
    docs = tables.table(spark, d, "documents")
    nodes = docs.select(F.col("doc_id").alias("id")).unionByName(docs.select((-1 - F.col("doc_id")).alias("id"))).withColumn("embedding", F.lit(None).cast("array<float>"))
    told = ingest.embed_nodes(nodes, docs.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("id"), F.col("text").alias("content")), _Sizes)
    return told.select("id", "matched", F.get("embedding", 0).cast("long").alias("n_chars"), F.get("embedding", 1).cast("long").alias("n_spaces"))


@query
def classify_both(spark, d):
    return _docs(spark, d).select("doc_id", classify.both(F.col("content")).alias("b")).select("doc_id", "b.*")


@query
def file_scan(spark, d):
    found = tables.scan_files(spark, d, ("parquet",))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
