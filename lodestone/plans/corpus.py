"""A corpus in bucketed tables: chunks with embeddings and the graph's tables, each dealt
into folders by a hash of the document. Documents come in batches, of a table or a stream; a
batch rewrites the buckets of its documents and leaves all others as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lodestone.operators import graph, vectors
from lodestone.plans.ingest import POINTS, chunks
from lodestone.sources import store


class Corpus:
    """The tables of a folder. What grows by document is stored; terms and edges are sums
    and unions of it, derived when they are read."""

    STORED = ("documents", "sections", "code_blocks", "links", "mentions", POINTS)

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, model=vectors.HashingEmbedder, most: int = 50, **chunking):
        self.spark, self.folder, self.model, self.most, self.chunking = spark, folder.rstrip("/"), model, most, chunking
        self.tables = {name: store.Buckets(spark, f"{self.folder}/{name}", "doc_id", buckets) for name in self.STORED}

    def _rows(self, docs: DataFrame) -> dict[str, DataFrame]:
        rows = graph.extracted(docs, self.most)
        rows[POINTS] = chunks(docs, model=self.model, **self.chunking).withColumn("embedding", vectors.embed(F.col("content"), self.model))
        return rows

    def put(self, docs: DataFrame) -> list[int]:
        """Sets documents (doc_id, content): what was known of their ids goes. Of rows that
        repeat an id the one of greatest ``seq`` counts, if they have that column, else the
        greatest content; a null content is an empty document, and a row without id none.
        Putting a batch twice is putting it once, so one that failed midway is put again.
        Returns the buckets that were written."""
        order = F.struct("seq", "content") if "seq" in docs.columns else F.struct("content")
        one = F.max_by("content", order)
        work = store.scratch(self.spark)
        docs.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(one, F.lit("")).alias("content")).write.parquet(f"{work}/docs")
        docs = self.spark.read.parquet(f"{work}/docs")
        rows = self._rows(docs)
        rows[POINTS].write.parquet(f"{work}/{POINTS}")
        rows[POINTS] = self.spark.read.parquet(f"{work}/{POINTS}")
        if not rows[POINTS].where(F.size("embedding") == 0).isEmpty():
            store.delete(self.spark, work)
            raise RuntimeError("no embeddings for some chunks")
        touched = [table.replace(rows[name], docs) for name, table in self.tables.items()]
        store.delete(self.spark, work)
        return touched[0]

    def remove(self, ids: DataFrame) -> list[int]:
        """Forgets the documents of ``ids`` (doc_id)."""
        ids = ids.select("doc_id").where("doc_id is not null")
        touched = [table.replace(table.read().limit(0), ids) for table in self.tables.values() if table.there()]
        return touched[0] if touched else []

    def read(self, name: str) -> DataFrame:
        """A stored table."""
        table = self.tables[name]
        if table.there():
            return table.read()
        return self._rows(self.spark.createDataFrame([], "doc_id long, content string"))[name].limit(0)

    def graph(self, pairs: bool = False) -> dict[str, DataFrame]:
        """Tables of the graph, with terms and edges; RELATED_TO edges only with ``pairs``."""
        held = {name: self.read(name) for name in self.STORED if name != POINTS}
        return held | graph.derived(held, pairs=pairs)

    def follow(self, docs: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
        """Puts the micro-batches of a stream of documents until all that is there is in.
        A batch that is done is recorded by ``name`` and its number, and skipped when it
        comes again; a stream with a new checkpoint needs a new name."""
        return docs.writeStream.foreachBatch(self.batch(name)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def batch(self, name: str):
        """The function that puts a micro-batch, given it and its number."""

        def put(docs: DataFrame, number: int) -> None:
            done = f"{self.folder}/_batches/{name}/{number}"
            if not store.exists(self.spark, done):
                self.put(docs)
                store.mark(self.spark, done)

        return put
