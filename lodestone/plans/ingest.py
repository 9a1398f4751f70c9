"""Ingest of a corpus: chunks, embeddings and graph, written by steps that undo themselves."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window, functions as F

from lodestone.functions.text import MAX_CHUNK, OVERLAP_CHARS, OVERLAP_RATIO, byte_safe, check_chunking, each, overlap_chars, pack, segmented, sentences
from lodestone.operators import graph, vectors
from lodestone.sources.store import delete, exists, move

MODES = ("character", "thai", "semantic")
POINTS = "points"


def chunks(docs: DataFrame, most: int = MAX_CHUNK, overlap: int | None = OVERLAP_CHARS, ratio: float = OVERLAP_RATIO, mode: str = "character", tokenizer: Callable | None = None, model: Callable | None = None, threshold: float = 0.6) -> DataFrame:
    """(point_id, doc_id, chunk_id, content) of each document (doc_id, content). With
    overlap=None the overlap follows each document's mean sentence length. Sentences are
    cut at three bytes a character before they are packed.

    mode "character": sentences by punctuation; "thai": by ``tokenizer()``, a function that
    makes a list of parts (by punctuation without one); "semantic": neighbours that are
    alike by ``model()`` go together (all of a document without a model, or where it fails),
    and a group that does not fit is packed."""
    check_chunking(most, ratio, overlap)
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    parts = segmented(F.col("content"), tokenizer) if mode == "thai" and tokenizer else sentences(F.col("content"))
    rows = docs.select("doc_id", parts.alias("s"))
    o = F.lit(overlap) if overlap is not None else overlap_chars(F.col("s"), ratio, most)
    rows = rows.select("doc_id", o.alias("o"), byte_safe(F.col("s"), most).alias("s"))
    if mode == "semantic" and model:
        sents = each(rows, ["doc_id", "o"], F.col("s"), "sentence").withColumn("embedding", vectors.embed(F.col("sentence"), model))
        failed = F.max(F.size("embedding") == 0).over(Window.partitionBy("doc_id"))
        groups = vectors.semantic_groups(sents, "doc_id", "pos", "embedding", threshold).withColumn("group", F.when(failed, 0).otherwise(F.col("group")))
        lists = groups.groupBy("doc_id", "o", "group").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]).alias("s"))
        whole = F.array_join("s", " ")
        lists = lists.withColumn("c", F.when(F.char_length(whole) <= most, F.array(whole)).otherwise(pack("s", most, "o")))
        rows = lists.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("group", "c"))), lambda x: x["c"])).alias("c"))
    else:
        rows = rows.select("doc_id", pack("s", most, "o" if overlap is None else overlap).alias("c"))
    rows = each(rows, ["doc_id"], F.col("c"), "content", "chunk_id")
    return rows.select(F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("chunk_id").cast("string")).alias("point_id"), "doc_id", "chunk_id", "content")


def semantic_chunks(sents: DataFrame, most: int = MAX_CHUNK, overlap: int = OVERLAP_CHARS, threshold: float = 0.6) -> DataFrame:
    """Chunks of sentences (doc_id, pos, sentence, embedding): neighbours that are alike go
    together; a group that does not fit is packed."""
    grouped = vectors.semantic_groups(sents, "doc_id", "pos", "embedding", threshold)
    parts = grouped.groupBy("doc_id", "group").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]).alias("s"))
    whole = F.array_join("s", " ")
    rows = parts.withColumn("c", F.when(F.char_length(whole) <= most, F.array(whole)).otherwise(pack("s", most, overlap)))
    return rows.select("doc_id", "group", F.posexplode("c").alias("part", "content"))


@dataclass
class SagaError(Exception):
    step: str
    index: int
    cause: Exception

    def __str__(self) -> str:
        return f"step {self.index} ({self.step}) failed: {self.cause}"


@dataclass
class Saga:
    """Steps (name, forward, compensate) in order. A step is tried three times; when it
    fails, those done are compensated in reverse and SagaError tells which one. A failing
    compensation is logged and the others still run."""

    steps: list[tuple[str, Callable[[], None], Callable[[], None]]]
    tries: int = 3
    wait: float = 1.0
    log: list[tuple[int, str, str, int]] = field(default_factory=list)

    def execute(self) -> list[tuple[int, str, str, int]]:
        done = []
        for k, (name, forward, compensate) in enumerate(self.steps):
            for n in range(1, self.tries + 1):
                try:
                    forward()
                    self.log.append((k, name, "done", n))
                    break
                except Exception as e:
                    self.log.append((k, name, "failed", n))
                    if n == self.tries:
                        self._undo(done)
                        raise SagaError(name, k, e) from e
                    time.sleep(self.wait * 2 ** (n - 1))
            done.append((k, (name, compensate)))
        return self.log

    def _undo(self, done: list) -> None:
        for k, (name, compensate) in reversed(done):
            try:
                compensate()
                self.log.append((k, name, "compensated", 1))
            except Exception as e:
                self.log.append((k, name, f"not compensated: {e}", 1))


def run_steps(steps: list[tuple[str, Callable[[], bool | None]]]) -> list[tuple[str, bool, str | None]]:
    """(name, success, error) of steps in order, up to the first that fails: raises, or
    returns False."""
    out = []
    for name, step in steps:
        try:
            good, error = step() is not False, None
        except Exception as e:
            good, error = False, f"{type(e).__name__}: {e}"[:500]
        out.append((name, good, error))
        if not good:
            break
    return out


def dual_write(first: Callable[[], None], second: Callable[[], None]) -> dict:
    """Writes to two stores, each whether or not the other fails: ok if one did it, partial
    if one did not, and the errors."""
    results = [run_steps([(name, write)])[0] for name, write in (("first", first), ("second", second))]
    good = [r[1] for r in results]
    return {"ok": any(good), "partial": good[0] != good[1], "errors": {r[0]: r[2] for r in results if not r[1]}}


def _merged(old: str, new: DataFrame, ids: DataFrame) -> DataFrame:
    """A stored table without the rows of the documents in ``ids``, and the new rows."""
    spark = new.sparkSession
    if not exists(spark, old):
        return new
    return spark.read.parquet(old).join(ids, "doc_id", "left_anti").select(new.columns).unionByName(new)


def ingest(docs: DataFrame, out: str, model=vectors.HashingEmbedder, pairs: bool = True, most: int = 50, **chunking) -> list:
    """Writes chunks with embeddings and the graph's tables below ``out``; documents that
    are there already are replaced, by id, and all others stay. A saga: tables are staged
    beside the old ones, which they replace when all are there; what a failed step leaves
    goes, and the old ones are as they were. It writes whole tables: ``corpus.Corpus`` takes
    batches at the cost of their buckets, and lists no RELATED_TO edges, which grow with the
    square of a term's documents: ``pairs=False`` leaves them out here."""
    spark = docs.sparkSession
    mark = uuid.uuid4().hex
    staged, kept = f"{out}/_staged-{mark}", f"{out}/_old-{mark}"
    ids = docs.select("doc_id").distinct()

    def store_graph():
        new = graph.extracted(docs, most)
        for name, df in new.items():
            _merged(f"{out}/graph/{name}", df, ids).write.mode("overwrite").parquet(f"{staged}/graph/{name}")
        held = {name: spark.read.parquet(f"{staged}/graph/{name}") for name in new}
        for name, df in graph.derived(held, pairs=pairs).items():
            df.write.mode("overwrite").parquet(f"{staged}/graph/{name}")

    def store_points():
        rows = chunks(docs, model=model, **chunking).withColumn("embedding", vectors.embed(F.col("content"), model))
        rows.write.mode("overwrite").parquet(f"{staged}/_new")
        rows = spark.read.parquet(f"{staged}/_new")
        if not rows.where(F.size("embedding") == 0).isEmpty():
            raise RuntimeError("no embeddings for some chunks")
        _merged(f"{out}/{POINTS}", rows, ids).write.mode("overwrite").parquet(f"{staged}/{POINTS}")

    def swap(back: bool = False):
        for name in ("graph", POINTS):
            if not back:
                if exists(spark, f"{out}/{name}") and exists(spark, f"{staged}/{name}"):
                    move(spark, f"{out}/{name}", f"{kept}/{name}")
                if exists(spark, f"{staged}/{name}"):
                    move(spark, f"{staged}/{name}", f"{out}/{name}")
            elif exists(spark, f"{kept}/{name}"):
                delete(spark, f"{out}/{name}")
                move(spark, f"{kept}/{name}", f"{out}/{name}")

    saga = Saga([("graph", store_graph, lambda: delete(spark, f"{staged}/graph")), ("points", store_points, lambda: delete(spark, f"{staged}/{POINTS}"))])
    try:
        log = saga.execute()
        try:
            swap()
        except Exception as e:
            swap(True)
            raise SagaError("swap", len(log), e) from e
        return log
    finally:
        delete(spark, staged)
        delete(spark, kept)


def stages(df: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]], folder: str, resume: str | None = None) -> DataFrame:
    """Runs named stages, each written below ``folder``; with ``resume`` those before that
    stage are read instead of run."""
    if resume is not None and resume not in [name for name, _ in steps]:
        raise ValueError(f"no stage {resume}")
    spark, skip = df.sparkSession, resume is not None
    for name, step in steps:
        if skip and name == resume:
            skip = False
        path = f"{folder}/{name}"
        if not skip:
            step(df).write.mode("overwrite").parquet(path)
        df = spark.read.parquet(path)
    return df


def embed_nodes(nodes: DataFrame, texts: DataFrame, model=vectors.HashingEmbedder) -> DataFrame:
    """Nodes with the embeddings of ``texts`` (id, content) attached, and whether one was."""
    from lodestone.operators.mutation import set_embeddings

    told = texts.select("id", vectors.embed(F.col("content"), model).alias("embedding"))
    return set_embeddings(nodes, told.where(F.size("embedding") > 0))
