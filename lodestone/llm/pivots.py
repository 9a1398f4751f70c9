"""Exact top-k inner products through a pivot-distance index.

Components x become floor(SCALE * x). Distance is the angle, which obeys the triangle
inequality, and an inner product is bounded by lengths and angle:
``q.v <= |q| |v| cos(max(0, |angle(q, p) - angle(p, v)|))`` for any pivot p. Pivots are
taken from a bounded sample, each the vector farthest from the span of those before it,
until that span holds most of the sample. Candidates are keyed by their nearest pivot and
their distance to it, sorted, and cut into annuli: blocks of at most BLOCK vectors with
inner and outer distance and least and largest length.

A query starts from the k-th best score in the sample. Queries of like place expand the
annuli nearest first, raise that score as results come in, and stop where the triangle
inequality says that no annulus left can hold a better one. Inside an annulus the
distances to all pivots together bound each vector: they give its part in the pivots' span,
and the lengths of what is left of both bound the rest. Only vectors that this leaves are
visited, that is, scored. Annuli are thin, so that on clustered vectors the triangle
inequality leaves out many of them whole (two fifths, in the test of it). On vectors without any
structure (independent components) it excludes none, as all are about as far from every
pivot as from each other, and the bound by all pivots does the work.

The annuli are a table that is sorted once. Queries go through it a bounded number at a
time, broadcast, so nothing that grows with the data is held by a task or sent twice.

Each row that the condition holds for is a query of its own, also where rows repeat an id;
rows with the query's id are its own and no candidates. Vectors without id, null, empty or
with null or non-finite components take no part; vectors of different length do not meet.
Ties go to the smaller id; of equal ids with equal scores each row counts. Scores are
exact: products are summed in doubles while they stay below 2^53, else as Python
integers, held to the range of a long. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lodestone.llm.shared import dropped, scratch, width, written

SCALE = 256
#: Vectors that pivots and first scores are taken from: those of smallest hashed id.
SAMPLE, PIVOTS = 4096, 512
#: Share of the sample's squared lengths that may lie outside the span of the pivots.
OUTSIDE = 0.25
BLOCK, QUERIES = 128, 512
#: Bytes of queries that one pass through the annuli takes.
PASS = 32 << 20
#: Slack of bounds against rounding, relative to the product of the lengths.
SLACK = 1e-9


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued rows (held as doubles)."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0**53:
        return (q @ v.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in v], object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def lengths(v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", v, v))


class Index:
    """Pivots and sample for vectors of one length (number of components)."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, k: int):
        self.k, self.ids, self.sample = k, ids, sample
        size = sample.shape[1]
        left, basis, chosen = sample.copy(), np.empty((0, size)), []
        whole = float(np.square(left).sum())
        while len(chosen) < min(PIVOTS, size, len(sample)):
            rest = np.einsum("ij,ij->i", left, left)
            if rest.sum() <= OUTSIDE * whole:
                break
            far = int(rest.argmax())
            step = left[far] - basis.T @ (basis @ left[far])  # again, against rounding
            step /= np.linalg.norm(step)
            chosen.append(far)
            basis = np.vstack([basis, step])
            left -= np.outer(left @ step, step)
        self.basis = basis
        self.pivots = sample[chosen] / lengths(sample[chosen])[:, None] if chosen else np.zeros((1, size))

    def angles(self, v: np.ndarray) -> np.ndarray:
        """Distances to all pivots; a zero vector is at distance 0 of each."""
        size = lengths(v)
        cosine = (v @ self.pivots.T) / np.where(size, size, 1)[:, None]
        return np.where(size[:, None] > 0, np.arccos(np.clip(cosine, -1, 1)), 0.0)

    def seen(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts in the pivots' span, and the lengths of what is outside."""
        part = v @ self.basis.T
        return part, np.sqrt(np.maximum(0, np.einsum("ij,ij->i", v, v) - np.einsum("ij,ij->i", part, part)))

    def first(self, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        """A score that k candidates of the sample reach, or less: -inf if it has fewer."""
        if len(self.ids) < self.k:
            return np.full(len(q), -np.inf)
        got = scores(q, self.sample).astype(np.float64)
        got[ids[:, None] == self.ids[None]] = -np.inf
        return np.sort(got, 1)[:, -self.k]


def reach(far: np.ndarray, inner: float, outer: float, least: float, most: float, size: np.ndarray) -> np.ndarray:
    """The best score that queries of length ``size`` at distance ``far`` of a pivot can have
    in its annulus from inner to outer with vectors of length least to most."""
    gap = np.maximum(0, np.maximum(inner - far, far - outer) - SLACK)
    cosine = np.cos(np.minimum(gap, np.pi))
    return size * (np.where(cosine > 0, most, least) * cosine + SLACK * most)


def by_size(column, ids: np.ndarray):
    """(size, places, ids, rows of integers) of the vectors of each length in a list column."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield size, at, ids[at], flat[starts[at][:, None] + np.arange(size)]


def prepared(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    ok = "id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(ok)


def empty(size: int, k: int) -> Index:
    """For a length that the sample lacks: no pivots, no first score."""
    return Index(np.empty(0, np.int64), np.empty((0, size)), k)


def annuli(rows: DataFrame, index, k: int) -> DataFrame:
    """Candidates as annuli: a row for each block of the order by (size, pivot, distance)."""

    def key(batches):
        for batch in batches:
            for size, _, ids, v in by_size(batch.column(1), batch.column(0).to_numpy()):
                d = (index.value.get(size) or empty(size, k)).angles(v)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), size, np.int32)), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), pa.array([r.tobytes() for r in v], pa.binary())], ["id", "size", "pivot", "r", "v"])

    def pack(batches):
        def rows_of(table):
            size, p, r = (table.column(c).to_numpy() for c in ("size", "pivot", "r"))
            edges = [0, *(np.flatnonzero((np.diff(p) != 0) | (np.diff(size) != 0)) + 1).tolist(), len(p)]
            out = []
            for a, b in itertools.pairwise(edges):
                for x in range(a, b, BLOCK):
                    y = min(x + BLOCK, b)
                    raw = b"".join(table.column("v").slice(x, y - x).to_pylist())
                    n = lengths(np.frombuffer(raw).reshape(y - x, -1))
                    out.append((int(size[x]), int(p[x]), float(r[x]), float(r[y - 1]), float(n.min()), float(n.max()), table.column("id").to_numpy()[x:y].astype("<i8").tobytes(), raw))
            types = (pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["size", "pivot", "inner", "outer", "least", "most", "ids", "vectors"])

        held, count = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= 32 * BLOCK:
                yield rows_of(pa.Table.from_batches(held))
                held, count = [], 0
        if held:
            yield rows_of(pa.Table.from_batches(held))

    keyed = written(rows.mapInArrow(key, "id long, size int, pivot int, r double, v binary"), "keyed")  # ranges are sampled from it
    ordered = keyed.repartitionByRange(width(keyed), "size", "pivot", "r", "id").sortWithinPartitions("size", "pivot", "r", "id")
    out = written(ordered.mapInArrow(pack, "size int, pivot int, inner double, outer double, least double, most double, ids binary, vectors binary"), "annuli")
    dropped(keyed)
    return out


def asked(queries: DataFrame, index, k: int) -> list[str]:
    """Files of queries, each of at most PASS bytes: id, size, first score, vector."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, QUERIES):
                part = batch.slice(a, QUERIES)
                for size, _, ids, q in by_size(part.column(1), part.column(0).to_numpy()):
                    least = (index.value.get(size) or empty(size, k)).first(ids, q)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), size, np.int32)), pa.array(least), pa.array([r.tobytes() for r in q], pa.binary())], ["id", "size", "least", "v"])

    told = written(queries.mapInArrow(run, "id long, size int, least double, v binary"), "questions")
    n, size = told.agg(F.count("*"), F.max("size")).first()
    if not n:
        return []
    most = max(1, PASS // (8 * size))
    path = scratch(queries.sparkSession, "asked")
    told.repartition(-(-n // most)).write.option("maxRecordsPerFile", most).parquet(path)
    dropped(told)
    return sorted(r[0] for r in queries.sparkSession.read.parquet(path).select(F.input_file_name()).distinct().collect())  # one for each pass


class Group:
    """Queries of one length: those of like place together."""

    def __init__(self, it: Index, number: np.ndarray, ids: np.ndarray, q: np.ndarray, least: np.ndarray):
        far = it.angles(q)
        order = np.lexsort((far.min(1), far.argmin(1)))
        self.it, self.number, self.ids, self.q, self.far = it, number[order], ids[order], q[order], far[order]
        self.least, self.size = least[order].copy(), lengths(self.q)
        self.part, self.rest = it.seen(self.q)
        self.best: list[list] = [[] for _ in order]


def expand(group: Group, rows: list[dict], k: int, visits: list[int]) -> None:
    """Takes the annuli of ``rows`` (of the group's length) for each block of queries, the
    nearest first, until the bounds say that none left can matter. ``visits`` counts
    pairs that are scored, and all pairs."""
    held: dict[int, tuple] = {}

    def block(n):
        if n not in held:
            v = np.frombuffer(rows[n]["vectors"]).reshape(-1, group.q.shape[1])
            held[n] = v, np.frombuffer(rows[n]["ids"], "<i8"), lengths(v), *group.it.seen(v)
        return held[n]

    for a in range(0, len(group.ids), QUERIES):
        some = np.arange(a, min(a + QUERIES, len(group.ids)))
        bound = np.stack([reach(group.far[some, r["pivot"]], r["inner"], r["outer"], r["least"], r["most"], group.size[some]) for r in rows])
        order = np.argsort(-bound.max(1), kind="stable")
        for n in order.tolist():
            visits[1] += len(some) * (len(rows[n]["ids"]) // 8)
            alive = some[bound[n] >= group.least[some]]
            if not len(alive):
                continue
            v, ids, size, part, rest = block(n)
            most = group.part[alive] @ part.T + np.outer(group.rest[alive], rest) + SLACK * np.outer(group.size[alive], size)
            likely = (most >= group.least[alive][:, None]) & (ids[None] != group.ids[alive][:, None])
            for x in np.flatnonzero(likely.any(1)).tolist():
                i = int(alive[x])
                hit = np.flatnonzero(likely[x])
                visits[0] += len(hit)
                got = scores(group.q[i : i + 1], v[hit])[0]
                good = got >= group.least[i]
                hit, got = hit[good], got[good]
                if len(hit) > k:  # best scores, smaller ids of equals
                    top = np.lexsort((ids[hit], -got))[:k]
                    hit, got = hit[top], got[top]
                heap = group.best[i]
                for s, j in zip(got.tolist(), ids[hit].tolist(), strict=True):
                    if len(heap) < k:
                        heapq.heappush(heap, (s, -j))
                    elif (s, -j) > heap[0]:
                        heapq.heapreplace(heap, (s, -j))
                if len(heap) == k:
                    group.least[i] = max(group.least[i], heap[0][0])


def grouped(questions: pa.Table, base: int, index: dict, k: int) -> dict[int, Group]:
    """The queries of one pass by their length, numbered from ``base``."""
    sizes, out = questions.column("size").to_numpy(), {}
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        some = questions.take(pa.array(at))
        q = np.frombuffer(b"".join(some.column("v").to_pylist())).reshape(-1, size)
        out[size] = Group(index.get(size) or empty(size, k), base + at, some.column("id").to_numpy(), q, some.column("least").to_numpy())
    return out


def search(blocks: DataFrame, questions, base: int, index, k: int) -> DataFrame:
    """(asked, query_id, vec_id, score): the k best of each query among a task's annuli."""

    def run(batches):
        groups = grouped(questions.value, base, index.value, k)
        for batch in batches:
            rows = batch.to_pylist()
            for size, some in itertools.groupby(rows, lambda r: r["size"]):
                if size in groups:
                    expand(groups[size], list(some), k, [0, 0])
        found = [(int(g.number[n]), int(g.ids[n]), -j, s) for g in groups.values() for n, heap in enumerate(g.best) for s, j in heap]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*found, strict=True)], ["asked", "query_id", "vec_id", "score"])

    return blocks.mapInArrow(run, "asked long, query_id long, vec_id long, score long")


def fitted(rows: DataFrame, k: int) -> dict[int, Index]:
    """An index for each length in the sample."""
    some = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    column = some.column("v").combine_chunks()
    return {size: Index(ids, v, k) for size, _, ids, v in by_size(column, some.column("id").to_numpy())} if some.num_rows else {}


def top_k(df: DataFrame, k: int = 5, query: str = "id % 50 = 0", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of every row that the
    condition ``query`` on ``id`` holds for; candidates are all rows."""
    spark = df.sparkSession
    rows = prepared(df, id_col, vector_col)
    index = spark.sparkContext.broadcast(fitted(rows, k))  # at most SAMPLE vectors
    blocks = annuli(rows, index, k)
    found, base = scratch(spark, "found"), 0
    schema = "asked long, query_id long, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(found)
    for name in asked(rows.where(query), index, k):
        told = spark.read.parquet(name).toArrow()
        questions = spark.sparkContext.broadcast(told)
        search(blocks, questions, base, index, k).write.mode("append").parquet(found)
        base += told.num_rows
        questions.destroy()
    dropped(blocks)
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.col("score").desc(), "vec_id"))
    return spark.read.schema(schema).parquet(found).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
