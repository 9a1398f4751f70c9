"""The corpus pipeline: quality filter, near-duplicate removal, secret masking, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept;
all but the last return the columns of documents. ``run`` writes each stage's rows as
Parquet to the shared folder and reads them again, so a lost executor repeats tasks of
one stage at most.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm import bagminhash, packing, quality, secrets
from lodestone.llm.queries import quality_model, table
from lodestone.llm.shared import held, written

#: Documents that score less than this for quality go.
KEEP = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, unchanged. Null and empty texts have
    no words to judge by and get the share of good labels as their score."""
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, name="__score").where(F.col("__score") >= KEEP).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each class of near copies. Where rows repeat an id,
    one row of each id and text (of the smallest other columns) whose own text is no near
    copy of one of a smaller id, or of a smaller one of the same id.
    Texts without words, null and empty ones too, are near copies of none; rows without id
    stay. Other columns, whatever their names, are carried along."""
    if bagminhash.repeated(docs.where("doc_id is not null"), "doc_id"):
        rest = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
        some = docs.where("doc_id is not null").groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("__none"), *rest)).alias("row")).select("doc_id", "text", "row.*")
        some = some.withColumn("__none", F.coalesce(bagminhash.text_key("doc_id", "text"), F.lit("")))
        copies = written(bagminhash.copies(docs).withColumnRenamed("key", "__none").distinct(), "copies")
        some = held(some, copies, "__none", "left_anti")
        return some.select(docs.columns).unionByName(docs.where("doc_id is null")).select(docs.columns)
    # copies are fewer than documents: texts stay where they are while these are few
    copies = written(bagminhash.classes(docs).where("not kept").select("doc_id").distinct(), "copies")
    return held(docs, copies, "doc_id", "left_anti").select(docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, values of secrets in their texts replaced and n_chars counted again.
    Null texts stay null, with their n_chars; empty ones stay empty; every row, also one
    that repeats another or has no id, is masked by itself. Other columns, whatever their
    names, are carried along."""
    clean = secrets.masked(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast(dict(docs.dtypes)["n_chars"]), F.col("n_chars")))
    return clean.select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids, by sequence and offset. Null and empty
    texts are the end id alone; every row, also one that repeats another or has no id, is a
    document. Other columns of docs are left out."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), derive=lambda ids: ids.astype(np.int32), derived="ids array<int>")


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("secrets", secret_stage), ("packing", packing_stage)]
#: SQL has neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
