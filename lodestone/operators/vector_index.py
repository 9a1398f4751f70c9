"""Vector indexes as tables: inverted lists around coarse centroids, with product codes of
what a vector differs from its centroid by.

An index is a folder: ``lists``, a table dealt into folders by list number that has each
vector's code and the vector itself; ``model``, the centroids and code words; ``about``, one
row that says what is indexed, written last, so an index is there when it is whole. A search
goes to the ``probes`` lists nearest to a query: only their folders are read. Codes rank a
list's vectors by table look-ups, and the best of them are scored exactly, so scores are
cosines, and only what is found is approximate. How many lists to probe is measured when the
index is made, on the sample that its model learns from, as the fewest that reach ``recall``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.operators import cells
from lodestone.operators.vectors import best, matrix, orders, scored, unit
from lodestone.sources import store

#: Most lists of an index; most vectors, and numbers in them, that its model learns from.
MAX_LISTS, SAMPLE, NUMBERS = 4096, 1 << 17, 1 << 23
#: Numbers of a vector that one code byte stands for, and most code words.
PIECE, WORDS = 8, 256
#: Sample queries that tell how many lists to probe, and the neighbours they ask for.
TRIALS, NEIGHBOURS = 256, 10
#: Vectors by codes that are scored exactly, for each one that is asked for.
RERANK = 32
#: Most vectors and queries of a task's cell by the mean; queries scored together.
MAX_POINTS, MAX_QUERIES, SLICE = 1 << 14, 1 << 12, 32
#: Most numbers of a matrix that a task makes at once: distances, scores, queries by lists.
AT_ONCE = 1 << 19
ABOUT = "name string, type string, labels string, properties string, dimensions int, lists int, probes int, vectors long"


def means(x: np.ndarray, k: int, rng: np.random.Generator, spherical: bool, rounds: int = 8) -> np.ndarray:
    """k centres of the rows of x by Lloyd's rounds, of length 1 if ``spherical``; a centre
    that no row is nearest to goes to a random one."""
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=k)[:, None]
        lone = np.flatnonzero(counts[:, 0] == 0)
        centres = sums / np.maximum(counts, 1)
        centres[lone] = x[rng.choice(len(x), len(lone))]
        if spherical:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    half, step = (centres**2).sum(1) / 2, max(1, AT_ONCE // max(1, len(centres)))
    return np.concatenate([np.empty(0, np.int64), *[(x[a : a + step] @ centres.T - half).argmax(1) for a in range(0, len(x), step)]])


class Model:
    """Centroids (lists, dimensions), and code words of each piece of the residuals."""

    def __init__(self, centroids: np.ndarray, words: list[np.ndarray], probes: int):
        self.centroids, self.words, self.probes = centroids, words, probes
        self.edges = np.cumsum([0, *[w.shape[1] for w in words]])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List number and code bytes of each row."""
        at = nearest(x, self.centroids)
        rest = x - self.centroids[at]
        return at, np.stack([nearest(rest[:, a:b], w).astype(np.uint8) for a, b, w in zip(self.edges, self.edges[1:], self.words)], 1)

    def approximate(self, q: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries with the vectors of a list that codes stand for."""
        out = np.repeat(q @ self.centroids[at], len(codes)).reshape(len(q), -1)
        for k, (a, b, w) in enumerate(zip(self.edges, self.edges[1:], self.words)):
            out += (q[:, a:b] @ w.T)[:, codes[:, k]]
        return out

    def nearby(self, q: np.ndarray, probes: int) -> np.ndarray:
        """The lists to look into for each query, nearest first."""
        return np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, :probes]


def learned(x: np.ndarray, lists: int, recall: float, seed: int = 0) -> Model:
    """A model of unit vectors, and the fewest probes that find ``recall`` of the neighbours
    of sample vectors in the sample."""
    rng = np.random.default_rng(seed)
    lists = min(lists, len(x))
    centroids = means(x, lists, rng, True)
    near = nearest(x, centroids)
    rest = x - centroids[near]
    pieces = np.array_split(np.arange(x.shape[1]), max(1, -(-x.shape[1] // PIECE)))
    words = [means(rest[:, p], min(WORDS, max(1, len(x) // 4)), rng, False) for p in pieces]
    model = Model(centroids, words, lists)
    asked = rng.choice(len(x), min(TRIALS, len(x)), replace=False)
    ranks, step = [np.empty(0, np.int64)], max(1, AT_ONCE // max(1, len(x)))
    for some in (asked[a : a + step] for a in range(0, len(asked), step)):
        scores = x[some] @ x.T
        scores[np.arange(len(some)), some] = np.nan
        rows, columns = best(scores, np.arange(len(x)), NEIGHBOURS)
        ranks.append(np.argsort(model.nearby(x[some], lists), axis=1)[rows, near[columns]])
    rank = np.concatenate(ranks)
    if len(rank):
        model.probes = int(np.sort(rank)[min(len(rank) - 1, int(np.ceil(recall * len(rank))) - 1)]) + 1
    return model


def probed(batch: pa.RecordBatch, model: Model, probes: int) -> Iterator[pa.RecordBatch]:
    """(query, embedding, list) of the lists to look into for each query of a batch, a few
    queries at a time: what is held at once does not grow with queries or lists."""
    step = max(1, AT_ONCE // max(1, len(model.centroids), probes * model.centroids.shape[1]))
    for a in range(0, batch.num_rows, step):
        some = batch.slice(a, step)
        at = model.nearby(unit(matrix(some.column(1))), probes)
        where = pa.array(np.repeat(np.arange(some.num_rows), at.shape[1]))
        yield pa.RecordBatch.from_arrays([some.column(0).take(where), some.column(1).take(where), pa.array(at.ravel().astype(np.int32))], ["query", "embedding", "list"])


class VectorIndex:
    """A catalogue of indexes below a folder that driver and executors share. Names are told
    apart as folders, so nothing is kept in the driver."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, name: str, part: str) -> str:
        if not name or not name.replace("_", "").replace("-", "").isalnum():
            raise ValueError(f"an index's name has letters, digits, - and _, not {name!r}")
        return f"{self.folder}/{name}/{part}"

    def exists(self, name: str) -> bool:
        return store.exists(self.spark, f"{self._at(name, 'about')}/_SUCCESS")

    def create(self, name: str, points: DataFrame, dimensions: int | None = None, labels: tuple[str, ...] | None = None, recall: float = 0.95, lists: int | None = None) -> bool:
        """Indexes points (id, embedding, and label if they have one): those of ``labels``,
        of ``dimensions`` numbers (those of the first vector in id order if not told). Null
        and zero vectors, and those with a component that is no finite number, are left
        out; rows that repeat an id are indexed each. False, and nothing done, if there is
        an index of that name already."""
        if self.exists(name):
            return False
        store.delete(self.spark, f"{self.folder}/{name}")  # what a failed creation left
        rows = points.select("id", F.col("label").cast("string").alias("label") if "label" in points.columns else F.lit(None).cast("string").alias("label"), F.col("embedding").cast("array<float>").alias("embedding"))
        if labels is not None:
            rows = rows.where(F.col("label").isin(*labels))
        if dimensions is None:
            first = rows.where(F.size("embedding") > 0).orderBy("id").select(F.size("embedding").alias("n")).first()
            dimensions = first["n"] if first else 0
        rows = self._usable(rows, dimensions)
        n = rows.count()
        wanted = min(MAX_LISTS, max(1, round(n**0.5))) if lists is None else max(1, min(MAX_LISTS, lists))
        most = max(1, min(SAMPLE, 32 * wanted + 4096, NUMBERS // max(1, dimensions)))

        def learn(batches):
            x = np.concatenate([np.empty((0, dimensions)), *[matrix(b.column(0)) for b in batches if b.num_rows]])
            if len(x):
                m = learned(unit(x), wanted, recall)
                parts = [("centroids", m.centroids), *[(f"words{k:04d}", w) for k, w in enumerate(m.words)], ("probes", np.array([[float(m.probes)]]))]
                for part, values in parts:
                    yield pa.RecordBatch.from_pydict({"part": [part] * len(values), "number": list(range(len(values))), "v": values.tolist()}, pa.schema([("part", pa.string()), ("number", pa.int32()), ("v", pa.list_(pa.float64()))]))

        sample = rows.orderBy(F.xxhash64("id"), "id").limit(most).select(F.col("embedding").cast("array<double>").alias("v"))
        sample.repartition(1).mapInArrow(learn, "part string, number int, v array<double>").write.parquet(self._at(name, "model"))
        self._write(name, self._coded(name, rows, dimensions))
        model = self._model(name)
        about = [(name, "VECTOR", ",".join(labels or ()), "embedding", dimensions, len(model.centroids), model.probes, n)]
        self.spark.createDataFrame(about, ABOUT).coalesce(1).write.parquet(self._at(name, "about"))
        return True

    @staticmethod
    def _usable(rows: DataFrame, dimensions: int) -> DataFrame:
        finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return rows.where((F.size("embedding") == dimensions) & finite & F.exists("embedding", lambda x: x != 0))

    def _model(self, name: str) -> Model:
        """Read into the driver: at most MAX_LISTS centroids and WORDS code words a piece."""
        rows = self.spark.read.parquet(self._at(name, "model")).orderBy("part", "number").toArrow()
        parts: dict[str, list] = {}
        for part, v in zip(rows["part"].to_pylist(), rows["v"].to_pylist(), strict=True):
            parts.setdefault(part, []).append(v)
        if not parts:
            return Model(np.empty((0, 0)), [], 0)
        return Model(np.array(parts["centroids"]), [np.array(parts[p]) for p in sorted(parts) if p.startswith("words")], int(parts["probes"][0][0]))

    def _coded(self, name: str, rows: DataFrame, dimensions: int) -> DataFrame:
        """rows (id, label, embedding) with list number and code."""
        held = self.spark.sparkContext.broadcast(self._model(name))
        kinds = dict(rows.dtypes)

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    at, codes = held.value.encode(unit(matrix(batch.column(2))))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(at.astype(np.int32))], ["id", "label", "embedding", "code", "list"])

        return rows.select("id", "label", "embedding").mapInArrow(run, f"id {kinds['id']}, label string, embedding array<float>, code binary, list int")

    def _write(self, name: str, coded: DataFrame) -> None:
        # whole lists to a task, large ones to several
        coded.hint("rebalance", "list").write.partitionBy("list").parquet(self._at(name, "lists"))

    def about(self, name: str):
        """The row that tells of an index, or None."""
        return self.spark.read.schema(ABOUT).parquet(self._at(name, "about")).first() if self.exists(name) else None

    def rows(self, name: str) -> DataFrame:
        """An index's table: id, label, embedding, code, list."""
        return self.spark.read.parquet(self._at(name, "lists"))

    def list(self) -> DataFrame:
        """The rows of ``about`` of all indexes."""
        found = [p for p in store.folders(self.spark, self.folder) if store.exists(self.spark, f"{p}/about/_SUCCESS")]
        return self.spark.read.schema(ABOUT).parquet(*[f"{p}/about" for p in found]) if found else self.spark.createDataFrame([], ABOUT)

    def verify(self, name: str) -> dict[str, bool]:
        """Whether an index is there, holds as many vectors as it says, all of its
        dimensions and labels, and each in a list of its model; ``ok`` if all is so."""
        told = self.about(name)
        if told is None:
            return {"exists": False, "vectors": False, "dimensions": False, "labels": False, "lists": False, "ok": False}
        if not told["vectors"]:
            return dict.fromkeys(("exists", "vectors", "dimensions", "labels", "lists", "ok"), True)
        labels = F.col("label").isin(*told["labels"].split(",")) if told["labels"] else F.lit(True)
        whole = lambda c: F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(False))
        sizes = F.size("embedding") == told["dimensions"]
        got = self.rows(name).agg((F.count("*") == told["vectors"]).alias("vectors"), whole(sizes).alias("dimensions"), whole(labels).alias("labels"), whole(F.col("list").between(0, told["lists"] - 1)).alias("lists")).first().asDict()
        return {"exists": True, **got, "ok": all(got.values())}

    def drop(self, name: str) -> bool:
        """Removes an index; False if there is none. What is not whole goes too."""
        found = self.exists(name)
        store.delete(self.spark, self._at(name, "about"))
        store.delete(self.spark, f"{self.folder}/{name}")
        return found

    def put(self, name: str, points: DataFrame) -> int:
        """Sets the vectors of ids: what an id had goes, and rows of the index's dimensions
        and labels come in. Of rows that repeat an id the one of greatest ``seq`` counts, if
        they have that column, else that of the greatest vector. Only the lists that ids
        leave or enter are written again. The model stays as it was learned. Returns how
        many lists changed."""
        told = self.about(name)
        if told is None:
            raise ValueError(f"no index {name}")
        order = F.struct("seq", "embedding") if "seq" in points.columns else F.struct("embedding")
        rows = points.where("id is not null").withColumn("label", F.col("label").cast("string") if "label" in points.columns else F.lit(None).cast("string"))
        rows = rows.groupBy("id").agg(F.max_by(F.struct("label", F.col("embedding").cast("array<float>").alias("embedding")), order).alias("r")).select("id", "r.*")
        work = store.scratch(self.spark)
        rows.write.parquet(f"{work}/rows")
        rows = self.spark.read.parquet(f"{work}/rows")
        good = self._usable(rows, told["dimensions"])
        good = good.where(F.col("label").isin(*told["labels"].split(","))) if told["labels"] else good
        held = self.rows(name)
        new = self._coded(name, good, told["dimensions"]).select(*held.columns)
        new.write.parquet(f"{work}/new")
        new = self.spark.read.parquet(f"{work}/new")
        touched = held.join(rows.select("id"), "id", "left_semi").select("list").union(new.select("list")).distinct()
        touched = [r["list"] for r in touched.collect()]  # at most MAX_LISTS numbers
        kept = held.where(F.col("list").isin(*touched)).join(rows.select("id"), "id", "left_anti") if touched else held.limit(0)
        store.replace_parts(self.spark, kept.unionByName(new), self._at(name, "lists"), "list", touched, f"{work}/staged")
        n = self.rows(name).count()
        about = told.asDict() | {"vectors": n}
        self.spark.createDataFrame([tuple(about.values())], ABOUT).coalesce(1).write.mode("overwrite").parquet(self._at(name, "about"))
        store.delete(self.spark, work)
        return len(touched)

    def search(self, name: str, queries: DataFrame, k: int = 10, probes: int | None = None, mode: str = "cosine", rerank: int = RERANK) -> DataFrame:
        """(query, id, label, score, rank) of about the k best vectors for each of ``queries``
        (query, embedding); without ``probes``, as many lists as the index was made for.
        Queries that are null, zero, or of another length find nothing."""
        told = self.about(name)
        if told is None:
            raise ValueError(f"no index {name}")
        kinds = dict(queries.dtypes)
        asked = self._usable(queries.select("query", F.col("embedding").cast("array<float>").alias("embedding")), told["dimensions"])
        model = self._model(name)
        probes = max(1, min(len(model.centroids), model.probes if probes is None else probes))
        held = self.spark.sparkContext.broadcast(model)
        points = self.rows(name).select("id", "label", "code", "embedding", "list") if told["vectors"] else None
        if points is None:
            return queries.limit(0).select("query", F.lit("").alias("id"), F.lit("").alias("label"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))

        def probe(batches):
            for batch in batches:
                yield from probed(batch, held.value, probes)

        path = store.scratch(self.spark)
        asked.mapInArrow(probe, f"query {kinds['query']}, embedding array<float>, list int").write.parquet(path)
        asked = self.spark.read.parquet(path)
        lists = [r["list"] for r in asked.select("list").distinct().collect()]  # at most MAX_LISTS numbers
        points = points.where(F.col("list").isin(*lists)) if lists else points.limit(0)

        def cell(left: pa.Table, right: pa.Table) -> pa.Table:
            if not (left.num_rows and right.num_rows):  # few to a block: one may be empty
                return pa.Table.from_arrays([right["query"].slice(0, 0), left["id"].slice(0, 0), left["label"].slice(0, 0), pa.chunked_array([], pa.float64())], ["query", "id", "label", "score"])
            codes = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(left.num_rows, -1)
            v, q, order = unit(matrix(left["embedding"])), unit(matrix(right["embedding"])), orders(left["id"])
            at, parts = left["list"][0].as_py(), []
            for a in range(0, len(q), SLICE):
                some = q[a : a + SLICE]
                if left.num_rows > rerank * k:
                    row, column = best(held.value.approximate(some, at, codes), order, rerank * k)
                    scores = np.full((len(some), left.num_rows), np.nan)
                    scores[row, column] = np.einsum("ij,ij->i", some[row], v[column])
                else:
                    scores = some @ v.T
                row, column = best(scores, order, k)
                found = left.select(["id", "label"]).take(pa.array(column))
                parts.append(pa.Table.from_arrays([right["query"].take(pa.array(row + a)), *found.columns, pa.chunked_array([pa.array(scores[row, column])])], ["query", "id", "label", "score"]))
            return pa.concat_tables(parts)

        schema = f"query {kinds['query']}, id {dict(points.dtypes)['id']}, label string, score double"
        found = cells.matched(points, asked, ["list"], cell, schema, cells.within(MAX_POINTS, told["dimensions"]), cells.within(MAX_QUERIES, told["dimensions"]))
        return cells.ranked(found.withColumn("score", scored(F.col("score"), mode)), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: exact results (query, id), how many of them were found, and that share (1 of
    none)."""
    hit = exact.select("query", "id").join(found.select("query", "id").distinct().withColumn("hit", F.lit(1)), ["query", "id"], "left")
    out = hit.agg(F.count("*").alias("asked"), F.count("hit").alias("found"))
    return out.withColumn("recall", F.coalesce(F.try_divide("found", "asked"), F.lit(1.0)))
