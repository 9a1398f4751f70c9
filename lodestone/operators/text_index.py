"""Substring search over stored names by character trigrams.

Names repeat, so what is indexed are the distinct lower-cased ones. ``texts`` has them,
``postings`` the trigrams of each, ``uses`` the nodes and documents that have a name: tables
bucketed by what they are looked up by. A word's trigrams are intersected, which needs the
buckets of those trigrams alone, and what is left is verified by the name itself. Words of
fewer than three characters are looked for in all distinct names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.functions.text import each, query_tokens
from lodestone.operators.graph import best_documents
from lodestone.sources import store

GRAM = 3
#: Most trigrams of a word that are intersected; any of them would do, as names are verified.
MOST = 16


def trigrams(text):
    """The distinct trigrams of a lower-cased text, as an array."""
    n = F.char_length(text)
    at = F.when(n >= GRAM, F.sequence(F.lit(1), n - GRAM + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(GRAM))))


class TextIndex:
    """The stored tables of an index, by the prefix of their names."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    def table(self, part: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{part}")

    @classmethod
    def build(cls, documents: DataFrame, nodes: DataFrame, name: str, buckets: int | None = None) -> TextIndex:
        """Indexes documents (doc_id, title) and nodes (doc_id, node, name, and title if they
        have one)."""
        spark, fields = documents.sparkSession, [c for c in ("name", "title") if c in nodes.columns]
        # both are read several times, and what they come from may be dear
        path = store.scratch(spark)
        documents.select("doc_id", "title").write.parquet(f"{path}/documents")
        nodes.where("node is not null").select("doc_id", "node", *fields).write.parquet(f"{path}/nodes")
        documents, nodes = spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/nodes")
        low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
        uses = documents.select("doc_id", F.lit(None).cast(dict(nodes.dtypes)["node"]).alias("node"), low("title").alias("low"))
        for c in fields:
            uses = uses.unionByName(nodes.select("doc_id", "node", low(c).alias("low")))
        uses = uses.where("low <> ''").withColumn("text_id", F.xxhash64("low"))
        store.bucketed(uses.select("text_id", "low").distinct(), f"{name}_texts", "text_id", buckets)
        # a text's trigrams are distinct; where two texts have one hash, a search tells
        grams = each(spark.table(f"{name}_texts"), ["text_id"], trigrams(F.col("low")), "gram").select("gram", "text_id")
        store.bucketed(grams, f"{name}_postings", "gram", buckets)
        store.bucketed(uses.distinct(), f"{name}_uses", "text_id", buckets)
        sizes = nodes.groupBy("doc_id").agg(F.countDistinct("node").alias("n"))
        store.bucketed(documents.join(sizes, "doc_id", "left"), f"{name}_documents", "doc_id", buckets)
        store.delete(spark, path)
        return cls(spark, name)

    def matching(self, words: list[str]) -> DataFrame:
        """(word, text_id, low) of the names that contain each word (lower-cased)."""
        spark, texts = self.spark, self.table("texts")
        short, found = [w for w in words if len(w) < GRAM], None
        if short:
            held = F.filter(F.array(*[F.lit(w) for w in short]), lambda w: F.contains("low", w))
            found = each(texts, ["text_id", "low"], held, "word").select("word", "text_id", "low")
        if len(short) < len(words):
            grams = [(w, g) for w in words if len(w) >= GRAM for g in list(dict.fromkeys(w[i : i + GRAM] for i in range(len(w) - GRAM + 1)))[:MOST]]
            needed = {w: sum(x == w for x, _ in grams) for w, _ in grams}
            asked = spark.createDataFrame([(w, g, needed[w]) for w, g in grams], "word string, gram string, needed int")
            posts = self.table("postings").where(F.col("gram").isin(sorted({g for _, g in grams}))).join(F.broadcast(asked), "gram")
            hits = posts.groupBy("word", "text_id", "needed").agg(F.countDistinct("gram").alias("n")).where("n = needed").select("word", "text_id")
            hits = hits.join(texts, "text_id").where(F.contains("low", F.col("word"))).select("word", "text_id", "low")
            found = hits if found is None else found.unionByName(hits)
        return found

    def search(self, query: str, per_term: int = 10, limit: int = 10) -> DataFrame:
        """(doc_id, title, related_count): what ``graph.keyword_search`` returns."""
        documents = self.table("documents")
        words = self.spark.range(1).select(F.slice(F.array_distinct(query_tokens(F.lit(query))), 1, 3).alias("w")).first()["w"]
        if not words:
            return documents.limit(0).select("doc_id", "title", F.lit(0).cast("long").alias("related_count"))
        uses = self.table("uses").join(self.matching(words), ["text_id", "low"]).select("word", "doc_id", "node")
        # a word in a document's title counts all of its nodes, else those that have the word
        own = uses.groupBy("word", "doc_id").agg(F.countDistinct("node").alias("some"), F.bool_or(F.col("node").isNull()).alias("whole"))
        counts = own.join(documents.select("doc_id", "n"), "doc_id").where("n is not null").select("word", "doc_id", F.when(F.col("whole"), F.col("n")).otherwise(F.col("some")).alias("n")).where("n > 0")
        return best_documents(documents.select("doc_id", "title"), counts, per_term, limit)

    def drop(self) -> None:
        for part in ("texts", "postings", "uses", "documents"):
            self.spark.sql(f"drop table if exists `{self.name}_{part}`")
