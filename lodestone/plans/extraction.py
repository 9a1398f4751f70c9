"""Entity extraction by a chat model, with repair, validation and a heuristic fallback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from lodestone.functions import classify, markdown
from lodestone.operators import llm_json
from lodestone.plans.tasks import run_tasks


def extract(chunks: DataFrame, chat: Callable[[str], str], tries: int = 3, wait: float = 2.0, most: int = 50) -> DataFrame:
    """(key, answered, entities) of chunks (key, content): the model's concepts where its
    answer holds a JSON object, else an entity for each key term. ``chat`` runs on the
    executors, a call a distinct content."""
    asked = chunks.select(F.col("content").alias("item")).distinct()
    answers = run_tasks(asked, chat, tries=tries, wait=wait).select("item", "result")
    rows = chunks.join(answers, F.col("content") == F.col("item"), "left").withColumn("json", llm_json.repaired(F.col("result")))
    told = llm_json.validated(F.col("json"), F.col("key").cast("string"))
    made = llm_json.heuristic(markdown.key_terms(F.col("content"), most), classify.domain(F.substring("content", 1, 2000))["domain"], F.col("key").cast("string"))
    plain = F.transform(made, lambda e: F.struct(e["id"], e["domain"], e["name_th"], e["name_en"], F.to_json(e).alias("json")))
    rows = rows.withColumn("told", told)
    return rows.select("key", F.col("told").isNotNull().alias("answered"), F.coalesce("told.concepts", plain).alias("entities"))


def domains(chunks: DataFrame, chat: Callable[[str], str]) -> DataFrame:
    """(key, domain, confidence) of chunks (key, content) by a chat model's answer; where the
    call fails, by keywords. Blank contents are not asked about."""
    asked = chunks.where(F.trim("content") != "").select(F.col("content").alias("item")).distinct()
    answers = run_tasks(asked, chat).where("success").select("item", "result")
    rows = chunks.join(answers, F.col("content") == F.col("item"), "left")
    return rows.select("key", classify.domain(F.col("content"), "llm", answer=F.col("result")).alias("d")).select("key", "d.*")
