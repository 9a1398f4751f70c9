"""Exact vector search, semantic grouping, and embedding plug-ins."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.operators import cells

#: Most points and queries of a cell of a many-query search, by the mean; queries of it that
#: are scored together; rows that are made unit vectors together.
MAX_POINTS, MAX_QUERIES, SLICE, STEP = 1 << 14, 1 << 14, 32, 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine of two arrays in doubles; null if a norm is zero."""
    return dot(a, b) / F.nullif((norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b), F.lit(0.0))


def scored(cos: Column, mode: str) -> Column:
    """mode "cosine": as it is; "unit": (1 + cosine) / 2."""
    if mode not in ("cosine", "unit"):
        raise ValueError(f"score mode {mode}")
    return cos if mode == "cosine" else (1 + cos) / 2


def top_k(points: DataFrame, query: list[float], k: int = 10, id_col: str = "id", vector_col: str = "embedding", mode: str = "cosine") -> DataFrame:
    """The k points of highest score for one query vector, as points' other columns and
    ``score``. The query's norm is computed once, here; the plan is a scan and a top-k."""
    q = [float(x) for x in query]
    length = float(np.sqrt(np.dot(q, q)))
    if not length:
        return points.limit(0).drop(vector_col).withColumn("score", F.lit(None).cast("double"))
    told = F.array(*[F.lit(x) for x in q])
    rows = points.withColumn("score", scored(cosine(F.col(vector_col), told, norm_b=F.lit(length)), mode)).drop(vector_col)
    return rows.where("score is not null").orderBy(F.col("score").desc(), id_col).limit(k)


def hits(found: DataFrame) -> DataFrame:
    """Rows of a store's search in the schema that backends share: (id, content, score,
    metadata), metadata a struct of doc_id ("" if unknown) and chunk_id (0 if unknown)."""
    has = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in found.columns else F.lit(default)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")) if "doc_id" in found.columns else F.lit("")
    metadata = F.struct(name.alias("doc_id"), has("chunk_id", 0).cast("int").alias("chunk_id"))
    return found.select("id", has("content", "").alias("content"), has("score", 0.0).cast("double").alias("score"), metadata.alias("metadata"))


def matrix(column: pa.ChunkedArray | pa.Array, kind=np.float64) -> np.ndarray:
    """Lists of one length as rows of a matrix; one is copied at most."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; a zero row becomes one of nan, whose cosines are no numbers."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, np.nan, n)


def units(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """``unit`` of lists of one length in doubles, made a few rows at a time, so that no more
    than the result is held beside them."""
    out = np.empty((len(column), size))
    for a in range(0, len(out), STEP):
        out[a : a + STEP] = unit(matrix(column.slice(a, STEP)))
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best scores of each row, nan left out; all that tie with the
    last one go along."""
    scores = np.where(np.isnan(scores), -np.inf, scores)
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
    else:
        least = np.full((len(scores), 1), -np.inf)
    rows, columns = np.nonzero((scores >= least) & (scores > -np.inf))
    # ties with the last one may be many: the smallest ids of them are enough
    order = np.lexsort((ids[columns], -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    first = np.searchsorted(rows, rows)
    kept = np.arange(len(rows)) - first < k
    return rows[kept], columns[kept]


def orders(ids: pa.ChunkedArray) -> np.ndarray:
    """The rank of each id among them: what ties are decided by."""
    column = ids.combine_chunks()
    out = np.empty(len(column), np.int64)
    out[pa.compute.array_sort_indices(column).to_numpy()] = np.arange(len(column))
    return out


def top_k_many(points: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", vector_col: str = "embedding", mode: str = "cosine") -> DataFrame:
    """(query, id, score, rank) of the k best points for each query vector in ``queries``
    (query, embedding). A grid of blocks of points and of queries, of the same vector length
    (others are never compared): each cell keeps k a query, and those are ranked. Null,
    empty and zero vectors are like nothing. Floats become doubles in the cells: till then
    they are half as many bytes."""
    vector = lambda df, c: (F.col(c) if dict(df.dtypes)[c] == "array<float>" else F.col(c).cast("array<double>")).alias("v")
    sized = lambda df: df.where(F.size("v") > 0).withColumn("size", F.size("v"))
    held, asked = sized(points.select(F.col(id_col).alias("id"), vector(points, vector_col))), sized(queries.select("query", vector(queries, "embedding")))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):  # few to a block: one may be empty
            return pa.Table.from_arrays([right["query"].slice(0, 0), left["id"].slice(0, 0), pa.chunked_array([], pa.float64())], ["query", "id", "score"])
        size = left["size"][0].as_py()
        v, order = units(left["v"], size).T, orders(left["id"])
        parts = []
        for a in range(0, right.num_rows, SLICE):
            rows, columns = best(scores := units(right["v"].slice(a, SLICE), size) @ v, order, k)
            found = [right["query"].take(pa.array(rows + a)), left["id"].take(pa.array(columns)), pa.chunked_array([pa.array(scores[rows, columns])])]
            parts.append(pa.Table.from_arrays(found, ["query", "id", "score"]))
        return pa.concat_tables(parts)

    schema = f"query {dict(asked.dtypes)['query']}, id {dict(held.dtypes)['id']}, score double"
    found = cells.matched(held, asked, ["size"], cell, schema, cells.within(MAX_POINTS, F.col("size")), cells.within(MAX_QUERIES, F.col("size")))
    return cells.ranked(found.withColumn("score", scored(F.col("score"), mode)), k)


def semantic_groups(rows: DataFrame, by: str, pos: str, vector_col: str = "embedding", threshold: float = 0.6) -> DataFrame:
    """rows with ``group``: it grows where a vector's cosine with the one before it in its
    partition is under the threshold (a zero vector is like nothing)."""
    w = Window.partitionBy(by).orderBy(pos)
    like = F.coalesce(cosine(F.lag(vector_col).over(w), F.col(vector_col)), F.lit(0.0))
    breaks = F.when(F.row_number().over(w) == 1, 0).when(like >= threshold, 0).otherwise(1)
    return rows.withColumn("__break", breaks).withColumn("group", F.sum("__break").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__break")


class HashingEmbedder:
    """Deterministic stand-in for an embedding model: hashed words, signed, of unit length."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"\w+", (text or "").lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dimensions] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)


class ExternalEmbedder:
    """An embedding service: ``post(url, body)`` sends {"model", "input"} and returns the
    answer, whose "data" lists an "embedding" for each text."""

    def __init__(self, url: str, model: str, post: Callable[[str, dict], dict] | None = None, seconds: float = 60.0):
        self.url, self.model, self.post, self.seconds = url, model, post or self._post, seconds

    def _post(self, url: str, body: dict) -> dict:
        import json
        import urllib.request

        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.seconds) as answer:
            return json.load(answer)

    def encode(self, texts: list[str]) -> np.ndarray:
        told = self.post(f"{self.url}/embeddings", {"model": self.model, "input": texts})
        found = [item.get("embedding", []) for item in told.get("data", [])]
        if len(found) != len(texts):
            raise RuntimeError(f"{len(found)} embeddings for {len(texts)} texts")
        return np.array(found)


def valid_embedder(model: Callable[[], object], dimensions: int | None = None) -> bool:
    """Whether a model can be made and gives vectors, of that many dimensions if told."""
    try:
        shape = np.asarray(model().encode(["dimension check"])).shape
    except Exception:
        return False
    return len(shape) == 2 and shape[0] == 1 and shape[1] > 0 and dimensions in (None, shape[1])


def embed(text: Column, model: Callable[[], object] = HashingEmbedder) -> Column:
    """Vectors of texts by ``model().encode(list)``; the model is made once a task. Texts
    of a call that fails are tried one by one, and those that fail get an empty array."""

    def one(made, told: str) -> list:
        try:
            return np.asarray(made.encode([told])[0], np.float32).tolist()
        except Exception:
            return []

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            made = model()
        except Exception:
            made = None
        for texts in batches:
            told = texts.fillna("").tolist()
            try:
                rows = list(made.encode(told))
            except Exception:
                rows = [one(made, t) for t in told]
            yield pd.Series(rows, dtype=object)

    return run(text)
