"""Upserts, deletes and migration as set-based snapshots: a new table from the old one and
a table of changes. Changes carry ``seq``; a later one wins, column by column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.operators.graph import EDGE_TYPES, LABELS

# Properties that a node may have besides its id.
NODE_COLUMNS = ("domain", "name_th", "name_en", "technical_desc_th", "technical_desc_en", "layman_explanation", "analogy", "visual_concept", "fiction_seed")
MIGRATED_EDGES = {"HAS_SECTION": "HAS_CHAPTER", "MENTIONS_TERM": "REFERENCES_CONCEPT"}


def _latest(c: str) -> Column:
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)


def rejected_nodes(changes: DataFrame) -> DataFrame:
    """Changes without id or of an unknown label, with the reason."""
    why = F.when(F.col("id").isNull() | (F.col("id") == ""), F.lit("id missing")).when(~F.coalesce(F.col("label").isin(*LABELS), F.lit(False)), F.lit("unknown label"))
    return changes.withColumn("reason", why).where("reason is not null")


def upsert_nodes(nodes: DataFrame, changes: DataFrame, columns: tuple[str, ...] = NODE_COLUMNS) -> DataFrame:
    """Nodes (label, id, columns) after changes (seq, label, id, some of the columns): null
    leaves a value as it is. One aggregation with map-side combine."""
    kept = [c for c in columns if c in nodes.columns or c in changes.columns]
    good = changes.where((F.coalesce(F.col("id"), F.lit("")) != "") & F.col("label").isin(*LABELS))
    both = nodes.withColumn("seq", F.lit(-1).cast("long")).unionByName(good.withColumn("seq", F.col("seq").cast("long")).select("seq", "label", "id", *[c for c in kept if c in changes.columns]), allowMissingColumns=True)
    return both.groupBy("label", "id").agg(*[_latest(c) for c in kept])


def upsert_edges(edges: DataFrame, changes: DataFrame, nodes: DataFrame, types: tuple[str, ...] = EDGE_TYPES) -> DataFrame:
    """Edges (src, dst, type, any properties) after changes (seq, ...): unique by ends and
    type, only between known nodes, only of known types; null leaves a property as it is."""
    known = nodes.select("id").distinct()
    keys = ("src", "dst", "type", "seq")
    kept = list(dict.fromkeys(c for c in (*edges.columns, *changes.columns) if c not in keys))
    good = changes.where(F.col("type").isin(*types)).join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    both = edges.withColumn("seq", F.lit(-1).cast("long")).unionByName(good.withColumn("seq", F.col("seq").cast("long")), allowMissingColumns=True)
    return both.groupBy("src", "dst", "type").agg(*[_latest(c) for c in kept]) if kept else both.select("src", "dst", "type").distinct()


def unmatched_edges(changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Changes of which an end is no node."""
    known = nodes.select("id").distinct()
    both = changes.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return changes.join(both.select("src", "dst", "type", "seq"), ["src", "dst", "type", "seq"], "left_anti")


def _last(changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row a key: the columns of its change of greatest ``seq``; without that column, and
    among equal ones, of the greatest values. Changes without a key go."""
    order = F.struct(*(["seq"] if "seq" in changes.columns else []), *columns)
    rows = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("__last"))
    return rows.select(key, *[F.col("__last")[c].alias(c) for c in columns])


def set_embeddings(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Nodes with the embeddings of ``vectors`` (id, embedding, and seq if they have it) set,
    and whether one was. Of vectors that repeat an id the last by seq counts; a null one
    leaves the embedding as it is. Every node stays one row."""
    told = _last(vectors, "id", ["embedding"]).select("id", F.col("embedding").alias("__new"), F.lit(True).alias("__hit"))
    rows = nodes.join(told, "id", "left").withColumn("embedding", F.coalesce("__new", "embedding")).withColumn("matched", F.coalesce("__hit", F.lit(False)))
    return rows.drop("__new", "__hit")


def delete_embeddings(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes without the embeddings of ``ids`` (id; repeats are one), and whether one is told."""
    told = ids.select("id").distinct().withColumn("matched", F.lit(True))
    rows = nodes.join(told, "id", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    return rows.withColumn("embedding", F.when(~F.col("matched"), F.col("embedding")))


def upsert_points(points: DataFrame, changes: DataFrame, key: str = "point_id") -> DataFrame:
    """Points with those of ``changes`` (the columns of points, and seq if they have it) put
    in or replaced whole, one row a key: of changes that repeat a key the last by seq
    counts. Changes without a key go."""
    last = _last(changes, key, [c for c in points.columns if c != key])
    return points.join(last.select(key), key, "left_anti").unionByName(last.select(*points.columns))


def delete_points(points: DataFrame, keys: DataFrame, key: str = "point_id") -> DataFrame:
    return points.join(keys.select(key), key, "left_anti")


def dual_outcome(first_ok: Column, second_ok: Column) -> Column:
    """struct of a write to two stores: it went well if one did, partly if one did not."""
    return F.struct((first_ok | second_ok).alias("ok"), (first_ok != second_ok).alias("partial"))


def migrate_nodes(documents: DataFrame, sections: DataFrame, terms: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Legacy tables as nodes of the universal schema; ids in ``done`` are left out."""
    name = lambda c: (F.coalesce(c, F.lit("")).alias("name_th"), F.coalesce(c, F.lit("")).alias("name_en"))
    told = lambda c: (c.alias("technical_desc_th"), c.alias("technical_desc_en"))
    head = lambda label, i, domain: (i.alias("id"), F.lit(label).alias("label"), F.lit(domain).alias("domain"))
    out = documents.select(*head("ContentAsset", F.col("doc_id").cast("string"), "document"), *name(F.coalesce("title", F.lit("Untitled"))), *told(F.lit("")), F.lit("Document").alias("type_legacy"))
    level = F.concat(F.lit("Level "), F.coalesce("level", F.lit(1)).cast("string"), F.lit(" section: "), F.coalesce("title", F.lit("")))
    out = out.unionByName(sections.select(*head("KnowledgeConcept", F.col("section_id"), "section"), *name(F.col("title")), *told(level), F.lit("Section").alias("type_legacy")))
    count = F.concat(F.lit("Extracted term (frequency: "), F.coalesce("count", F.lit(0)).cast("string"), F.lit(")"))
    out = out.unionByName(terms.select(*head("KnowledgeConcept", term_id(F.col("name")), "term"), *name(F.col("name")), *told(count), F.lit("Term").alias("type_legacy")))
    return out if done is None else out.join(done.select("id"), "id", "left_anti")


#: Labels that migration takes away.
LEGACY = ("Document", "Section", "Term")


def remove_legacy_labels(nodes: DataFrame) -> DataFrame:
    """Nodes (id, labels, migrated, ...) without the legacy label of those that are migrated;
    it goes to ``type_legacy``, where others keep what they have. Of several legacy labels
    the last of LEGACY is told, and all go."""
    known = "type_legacy" in nodes.columns
    held, kept = F.array(*[F.lit(x) for x in LEGACY]), F.col("type_legacy") if known else F.lit(None).cast("string")
    legacy = F.element_at(F.filter(held, lambda x: F.array_contains("labels", x)), -1)
    done = F.coalesce(F.col("migrated"), F.lit(False)) & F.coalesce(F.arrays_overlap("labels", held), F.lit(False))
    return nodes.withColumns({"type_legacy": F.when(done, legacy).otherwise(kept), "labels": F.when(done, F.array_except("labels", held)).otherwise(F.col("labels"))})


def term_id(name: Column) -> Column:
    return F.concat(F.lit("term_"), F.regexp_replace(F.coalesce(name, F.lit("")), " ", "_"))


def migrate_edges(edges: DataFrame, chapters: bool = False, limit: int | None = None) -> DataFrame:
    """Legacy edges (src, dst, type) in the universal schema; with ``chapters``, sections in
    sections too; ``limit`` keeps that many of each type."""
    types = MIGRATED_EDGES | ({"CONTAINS_SECTION": "NEXT_CHAPTER"} if chapters else {})
    out = None
    for old, new in types.items():
        dst = term_id(F.col("dst")) if old == "MENTIONS_TERM" else F.col("dst")
        rows = edges.where(F.col("type") == old).select("src", dst.alias("dst"), F.lit(new).alias("type")).distinct()
        rows = rows.orderBy("src", "dst").limit(limit) if limit else rows
        out = rows if out is None else out.unionByName(rows)
    return out


def duplicates(nodes: DataFrame) -> DataFrame:
    """Breaches of the uniqueness of (label, id): must be empty."""
    return nodes.groupBy("label", "id").agg(F.count("*").alias("n")).where("n > 1")


def schema_check(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, found) for each expected constraint or index name."""
    return expected.select("name").distinct().join(actual.select("name").distinct().withColumn("found", F.lit(True)), "name", "left").withColumn("found", F.coalesce("found", F.lit(False)))
