"""A property graph from Markdown documents, and queries on it. Graphs are DataFrames:
nodes by kind, and edges (src, dst, type, props)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.functions import markdown
from lodestone.functions.text import each, query_tokens, strip
from lodestone.operators.adjacency import Adjacency, Steps
from lodestone.sources.tables import scratch

LABELS = ("KnowledgeConcept", "Hardware", "Strategy", "Narrative", "ContentAsset")
EDGE_TYPES = ("PREDICTS", "APPLIES_TO", "CORRELATES_WITH", "REQUIRES_INFRA", "INSPIRES_PLOT", "IS_EXAMPLE_OF", "CONTRADICTS", "HAS_CHAPTER", "NEXT_CHAPTER", "REFERENCES_CONCEPT")
MAX_HOPS = 3
#: Most rows of a frontier that the driver holds for a hop.
FRONTIER = 20_000


def sections(docs: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """doc_id, section_id, idx, level, title, start_line, end_line, parent_id of each
    heading; the parent is the nearest one before it of a smaller level. A window by
    document: no join."""
    every = docs.select(F.col(id_col).alias("doc_id"), markdown.lines(F.coalesce(F.col(content_col), F.lit(""))).alias("lines"))
    rows = each(every, ["doc_id", F.size("lines").alias("n_lines")], F.col("lines"), "line", "start_line")
    rows = rows.withColumn("marks", F.regexp_extract("line", markdown.HEADING, 1)).where("marks <> ''")
    rows = rows.select("doc_id", "n_lines", "start_line", F.length("marks").alias("level"), strip(F.regexp_extract("line", markdown.HEADING, 2)).alias("title"))
    w = Window.partitionBy("doc_id").orderBy("start_line")
    rows = rows.withColumn("idx", F.row_number().over(w) - 1)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    above = [F.when(F.col("level") > k, F.last(F.when(F.col("level") == k, F.col("idx")), ignorenulls=True).over(before)) for k in range(1, 6)]
    parent = F.greatest(*above)
    rows = rows.withColumn("parent", parent).withColumn("end_line", F.coalesce(F.lead("start_line").over(w), F.col("n_lines")) - 1)
    name = lambda k: F.concat(F.col("doc_id").cast("string"), F.lit("_section_"), k.cast("string"))
    return rows.select("doc_id", name(F.col("idx")).alias("section_id"), "idx", "level", "title", "start_line", "end_line", F.coalesce(name(F.col("parent")), F.lit("")).alias("parent_id"))


def items(docs: DataFrame, values: Column, kind: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id, idx, id ({doc}_{kind}_{idx}) and the fields of each value of an array."""
    rows = each(docs, [F.col(id_col).alias("doc_id")], values, "item", "idx")
    return rows.select("doc_id", "idx", F.concat_ws("_", F.col("doc_id").cast("string"), F.lit(kind), F.col("idx").cast("string")).alias("id"), "item.*")


def mentions(docs: DataFrame, most: int = 50, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """(doc_id, term) of each extracted key term, lower-cased; terms that differ in case
    only give a row each."""
    return each(docs, [F.col(id_col).alias("doc_id")], markdown.key_terms(F.col(content_col), most), "term").select("doc_id", F.trim(F.lower("term")).alias("term")).where("term <> ''")


def terms(found: DataFrame) -> DataFrame:
    return found.groupBy(F.col("term").alias("name")).agg(F.count("*").alias("count"))


def extracted(docs: DataFrame, most: int = 50) -> dict[str, DataFrame]:
    """Tables of a corpus (doc_id, content) that have rows by document: documents, sections,
    code_blocks, links, mentions."""
    content = F.coalesce(F.col("content"), F.lit(""))
    code, refs = items(docs, markdown.code_blocks(content), "code"), items(docs, markdown.links(content), "link")
    return {"documents": docs.select("doc_id", markdown.title(content).alias("title")), "sections": sections(docs), "code_blocks": code.drop("code"), "links": refs, "mentions": mentions(docs, most)}


def derived(held: dict[str, DataFrame], max_df: int | None = None, pairs: bool = True) -> dict[str, DataFrame]:
    """Terms and edges of extracted tables. With ``pairs``, RELATED_TO edges are listed, all
    of them or those of terms that at most ``max_df`` documents share."""
    text = lambda c: F.col(c).cast("string")
    edge = lambda src, dst, kind, via=None: (src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), (via if via is not None else F.lit("")).alias("via"))
    parts, found = held["sections"], held["mentions"]
    edges = parts.select(*edge(text("doc_id"), F.col("section_id"), "HAS_SECTION"))
    edges = edges.unionByName(parts.where("parent_id <> ''").select(*edge(F.col("parent_id"), F.col("section_id"), "CONTAINS_SECTION")))
    edges = edges.unionByName(held["code_blocks"].select(*edge(text("doc_id"), F.col("id"), "CONTAINS_CODE")))
    edges = edges.unionByName(found.distinct().select(*edge(text("doc_id"), F.col("term"), "MENTIONS_TERM")))
    edges = edges.unionByName(held["links"].select(*edge(text("doc_id"), F.col("id"), "REFERENCES_URL")))
    if pairs:
        edges = edges.unionByName(related(found, max_df).select(*edge(text("src"), text("dst"), "RELATED_TO", F.col("via_term"))))
    return {"terms": terms(found), "edges": edges}


def build(docs: DataFrame, most: int = 50, max_df: int | None = None, pairs: bool = True) -> dict[str, DataFrame]:
    """Tables of the graph of a corpus (doc_id, content): those of ``extracted`` and of
    ``derived``. Extraction reads the corpus; cache or write it first if it is dear."""
    held = extracted(docs, most)
    return held | derived(held, max_df, pairs)


def related(found: DataFrame, max_df: int | None = None, order: DataFrame | None = None) -> DataFrame:
    """(src, dst, via_term) of all ordered pairs of documents that share a term. Pairs of a
    term grow with the square of its documents: ``max_df`` leaves more frequent ones out.
    With ``order`` (doc_id, seq), only from a document to those ingested before it."""
    held = found.select("doc_id", "term").distinct()
    if max_df is not None:
        held = held.join(held.groupBy("term").count().where(F.col("count").between(2, max_df)).select("term"), "term", "left_semi")
    a, b = held.select("term", F.col("doc_id").alias("src")), held.select("term", F.col("doc_id").alias("dst"))
    if order is not None:
        a = a.join(order.select(F.col("doc_id").alias("src"), F.col("seq").alias("sa")), "src")
        b = b.join(order.select(F.col("doc_id").alias("dst"), F.col("seq").alias("sb")), "dst")
    both = a.join(b, "term").where("src <> dst" if order is None else "sb < sa")
    return both.select("src", "dst", F.col("term").alias("via_term"))


def related_members(found: DataFrame) -> DataFrame:
    """(via_term, doc_id, n_docs): the documents of each term that at least two share. All
    RELATED_TO edges, unlisted: the ordered pairs of a term's documents. Terms of any
    frequency stay, and a term gives as many rows as it has documents."""
    held = found.select("doc_id", "term").distinct()
    sizes = held.groupBy("term").agg(F.count("*").alias("n_docs")).where("n_docs > 1")
    return held.join(sizes, "term").select(F.col("term").alias("via_term"), "doc_id", "n_docs")


def edge_counts(edges: DataFrame, found: DataFrame) -> DataFrame:
    """(type, n, sources, targets) of edges without RELATED_TO, and of all RELATED_TO edges
    of ``found``. These are summed over terms, not listed: every document that shares a term
    is both source and target."""
    out = edges.where("type <> 'RELATED_TO'").groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))
    ends = related_members(found).groupBy("doc_id").agg(F.sum(F.col("n_docs") - 1).alias("n"))
    near = ends.agg(F.sum("n").alias("n"), F.count("*").alias("sources")).where("sources > 0")
    return out.unionByName(near.select(F.lit("RELATED_TO").alias("type"), "n", "sources", F.col("sources").alias("targets")))


def related_documents(found: DataFrame, doc_id, hops: int = 2, limit: int = 20) -> DataFrame:
    """(doc_id, strength): directed RELATED_TO paths of at most ``hops`` (1 to 3) edges from a
    document, one edge a shared term, no edge twice in a path. Paths are counted, not
    listed: each hop sums over terms and back over documents, so frequent terms cost no
    more."""
    if not 1 <= hops <= MAX_HOPS:
        raise ValueError(f"hops must be between 1 and {MAX_HOPS}")
    held = _written(found.select("doc_id", "term").distinct())  # read by each hop
    sizes = held.groupBy("doc_id").agg(F.count("*").alias("n"))
    own = held.where(F.col("doc_id") == doc_id).select("term")
    first = held.join(own, "term", "left_semi").groupBy("doc_id").agg(F.count("*").alias("w")).where(F.col("doc_id") != doc_id)
    at, every = first, first
    for k in range(2, hops + 1):
        through = held.join(at, "doc_id").groupBy("term").agg(F.sum("w").alias("w"))
        back = held.join(through, "term").groupBy("doc_id").agg(F.sum("w").alias("s"))
        # less the steps from a document to itself
        at = back.join(at, "doc_id", "left").join(sizes, "doc_id").select("doc_id", (F.col("s") - F.coalesce("w", F.lit(0)) * F.col("n")).alias("w")).where("w > 0")
        paths = at
        if k == 3:  # there, back and there again by one term: the same edge twice
            twice = first.select("doc_id", (F.col("w") * F.col("w")).alias("t"))
            paths = at.join(twice, "doc_id", "left").select("doc_id", (F.col("w") - F.coalesce("t", F.lit(0))).alias("w"))
        every = every.unionByName(paths)
    out = every.groupBy("doc_id").agg(F.sum("w").alias("strength")).where("strength > 0")
    return out.orderBy(F.col("strength").desc(), "doc_id").limit(limit)


def keyword_search(documents: DataFrame, nodes: DataFrame, query: str, per_term: int = 10, limit: int = 10) -> DataFrame:
    """(doc_id, title, related_count): documents by the distinct nodes (doc_id, node, name,
    and title if they have one) whose name or title, or whose document's title, contains one
    of the first three query words. Nodes are matched before they are joined, and only the
    words that match go along."""
    spark = documents.sparkSession
    words = spark.range(1).select(F.slice(F.array_distinct(query_tokens(F.lit(query))), 1, 3).alias("w")).first()["w"]
    if not words:
        return documents.limit(0).select("doc_id", "title", F.lit(0).cast("long").alias("related_count"))
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    fields = [c for c in ("name", "title") if c in nodes.columns]
    hit = lambda columns: F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.exists(F.array(*[low(c) for c in columns]), lambda x: F.contains(x, w)))
    own = nodes.select("doc_id", "node", hit(fields).alias("own")).join(documents.select("doc_id", hit(["title"]).alias("told")), "doc_id")
    own = each(own, ["doc_id", "node"], F.array_union("own", "told"), "word")
    return best_documents(documents, own.groupBy("word", "doc_id").agg(F.countDistinct("node").alias("n")), per_term, limit)


def best_documents(documents: DataFrame, counts: DataFrame, per_term: int, limit: int) -> DataFrame:
    """Of the ``per_term`` documents with most nodes for each word (word, doc_id, n), those
    with most in all."""
    rank = F.row_number().over(Window.partitionBy("word").orderBy(F.col("n").desc(), "doc_id"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= per_term).groupBy("doc_id").agg(F.sum("n").alias("related_count"))
    best = best.orderBy(F.col("related_count").desc(), "doc_id").limit(limit)
    return documents.select("doc_id", "title").join(F.broadcast(best), "doc_id").orderBy(F.col("related_count").desc(), "doc_id")


def of_labels(nodes: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Nodes of any of the labels."""
    return nodes.where(F.col("label").isin(*labels))


def bounded(rows: DataFrame, most: int = FRONTIER) -> DataFrame:
    """Rows that are computed once: a table of at most ``most`` as rows of the plan, which
    Spark broadcasts, a larger one as a table written to the shared folder."""
    return _held(rows, most)[0]


def _held(rows: DataFrame, most: int = FRONTIER) -> tuple[DataFrame, list | None]:
    """The same, and the first column's values if the driver holds the rows."""
    spark = rows.sparkSession
    some = rows.limit(most + 1).toArrow()
    if some.num_rows <= most:
        return spark.createDataFrame(some, rows.schema), some.column(0).to_pylist()
    return _written(rows), None


def _written(rows: DataFrame) -> DataFrame:
    """Rows as a table of the shared folder, so that they are computed once."""
    path = scratch(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def expand(edges: DataFrame | Adjacency, seeds: DataFrame, hops: int = 2, limit: int | None = 50, compat: bool = False, nodes: DataFrame | None = None, labels: tuple[str, ...] | None = None) -> DataFrame:
    """(id, hops, chain) of the nodes within ``hops`` (held to 1..3) of the seeds (id), over
    edges (src, dst, type), or a stored Adjacency of them, in either direction; seeds and
    blank ids are left out. Of the shortest paths to a node the least chain stays: steps
    TYPE:direction, joined by ">". Each hop is an equi-join with the frontier (a broadcast
    while it is small; stored edges are not shuffled in any case), a grouped minimum, and an
    anti-join with what is known. With ``compat``, steps after the first are all incoming,
    as none leaves the seed. With ``labels``, only nodes (id, label) of these are found;
    paths go through any."""
    hops = max(1, min(MAX_HOPS, hops))
    stored = edges if isinstance(edges, Adjacency) else Steps(edges)
    known, ids = _held(seeds.where("id is not null and id <> ''").select("id").distinct())
    front, reached = known.withColumn("chain", F.lit("")), None
    for k in range(1, hops + 1):
        step = stored.steps(front, ids)
        if compat and k > 1:
            step = step.withColumn("step", F.regexp_replace("step", ":outgoing$", ":incoming"))
        after = step.join(F.broadcast(front) if ids is not None else front, "id").groupBy(F.col("to").alias("id")).agg(F.min(F.concat_ws(">", F.nullif("chain", F.lit("")), "step")).alias("chain"))
        seen = known if reached is None else known.unionByName(reached.select("id"))
        front = after.join(seen, "id", "left_anti")
        front, ids = _held(front) if k < hops else (front, None)
        rows = front.select("id", F.lit(k).alias("hops"), "chain")
        reached = rows if reached is None else reached.unionByName(rows)
    if labels is not None:
        reached = reached.join(of_labels(nodes, labels).select("id"), "id", "left_semi")
    return reached.orderBy("hops", "id").limit(limit) if limit else reached
