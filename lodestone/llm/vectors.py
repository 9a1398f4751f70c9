"""Near-duplicate vectors by cross-polytope hashing.

Vectors with equal labels are hashed in several tables. Each table rotates a vector by
signs and fast Hadamard transforms (three rounds each), more than once where the label has
many vectors; a rotation's code is the closest of the signed axes, and the table's code
joins those of its rotations. A vector lies in its own bucket and also visits the next-likeliest ones
(multiprobe). Vectors that meet in a bucket are verified by their cosine in double
precision, in blocks of matrix products; nothing is listed pair by pair. A pair that
meets several times counts where it meets first: each row carries its codes.

Equal vectors are one node with a count. Vectors without id or label, null or zero, or
with null or non-finite components link with nothing; vectors of different length do not
meet. Rows that repeat an id are vectors of their own in ``n_links``.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.llm.bagminhash import GOLDEN, mix
from lodestone.llm.shared import components, dropped, joined, looked_up, width, written

SIMILAR = 0.93
PROBES = 6
#: Tables by rotations: so many that a pair at the threshold meets in one with a chance of
#: 0.999 or more (a table's own is 0.92, 0.78, 0.56 and 0.36).
TABLES = {1: 4, 2: 6, 3: 10, 4: 16, 5: 28, 6: 48}
#: Vectors that a bucket should hold on average, at most: more rotations split larger
#: tables, so chance meetings stay rare and work grows with the rows.
LOAD = 0.05
#: Rows of a bucket that one product compares with another such block.
BLOCK = 256


@functools.cache
def signs(size: int, rotations: int, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.choice(np.array([-1.0, 1.0], np.float32), (TABLES[rotations], rotations, 3, size))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, orthonormal; the width is a power of two."""
    n, size = x.shape
    step = 1
    while step < size:
        x = x.reshape(n, size // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, size)
        step *= 2
    return x / np.float32(np.sqrt(size))


def codes(unit: np.ndarray, rotations: int) -> np.ndarray:
    """(rows, tables, PROBES) bucket codes, the first of each table the row's own."""
    n, d = unit.shape
    size = 1 << max(0, (d - 1).bit_length())
    x = np.zeros((n, size), np.float32)
    x[:, :d] = unit
    near = min(3, size)  # axes of each rotation that probes may take
    combos = sorted(itertools.product(range(near), repeat=rotations), key=sum)[: 4 * PROBES]
    tables = TABLES[rotations]
    out = np.zeros((n, tables, PROBES), np.int64)
    for t in range(tables):
        axes, loss = [], []
        for r in range(rotations):
            y = x
            for s in signs(size, rotations)[t, r]:
                y = hadamard(y * s)
            best = np.argsort(-np.abs(y), 1)[:, :near]
            value = np.take_along_axis(y, best, 1)
            axes.append(2 * best + (value < 0))
            loss.append((np.abs(value[:, :1]) - np.abs(value)) ** 2)
        price = np.stack([sum(loss[r][:, c[r]] for r in range(rotations)) for c in combos], 1)
        code = np.stack([functools.reduce(lambda a, r: a * (2 * size) + axes[r][:, c[r]], range(rotations), 0) for c in combos], 1)  # noqa: B023
        order = np.argsort(price, 1, kind="stable")[:, :PROBES]
        got = np.take_along_axis(code, order, 1)
        out[:, t, : got.shape[1]] = got
        out[:, t, got.shape[1] :] = got[:, :1]
    return out


def code_type(size: int, rotations: int) -> str:
    return "<u4" if (2 * size) ** rotations < 1 << 32 else "<u8"


BUCKET = pa.list_(pa.struct([("key", pa.int64()), ("t", pa.int32()), ("own", pa.bool_()), ("code", pa.int64())]))


def rotations(vectors: str, size: str) -> Column:
    """For a label with so many vectors of at most ``size`` components."""
    axes = F.pow(F.lit(2.0), F.ceil(F.log2(F.col(size))) + 1)
    return sum(((F.col(vectors) > LOAD * F.pow(axes, F.lit(r))).cast("int") for r in range(1, max(TABLES))), F.lit(1))


def hashed(nodes: DataFrame, kind: str) -> DataFrame:
    """A row for each node (node, n, label, embedding, rotations): node, n, label, rotations,
    its vector (as ``kind`` of float), its codes, and the buckets it lies in or visits."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                vectors = [np.array(v, kind) for v in part.column(3).to_pylist()]
                labels = np.array(part.column(2).to_pylist(), np.int64)
                sizes, turns = np.array([len(v) for v in vectors]), np.array(part.column(4).to_pylist())
                for d, r in np.unique(np.stack([sizes, turns]), axis=1).T.tolist():
                    rows = np.flatnonzero((sizes == d) & (turns == r))
                    c = codes(normal(np.stack([vectors[i] for i in rows])).astype(np.float32), r)
                    base = mix(mix(labels[rows].view(np.uint64) * GOLDEN + np.uint64(d))[:, None] + np.arange(TABLES[r], dtype=np.uint64) * GOLDEN)
                    keys = mix(base[:, :, None] ^ mix(c.view(np.uint64) + GOLDEN)).view(np.int64)
                    # a probe that equals an earlier one of the same table is no bucket more
                    new = np.ones(keys.shape, bool)
                    for p in range(1, PROBES):
                        new[:, :, p] = (c[:, :, p : p + 1] != c[:, :, :p]).all(2)
                    who, table, probe = np.nonzero(new)
                    ends = np.append(0, np.cumsum(np.bincount(who, minlength=len(rows)))).astype(np.int32)
                    fields = [pa.array(keys[who, table, probe]), pa.array(table.astype(np.int32)), pa.array(probe == 0), pa.array(c[who, table, probe])]
                    buckets = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, fields=list(BUCKET.value_type)))
                    take = pa.array(rows)
                    small = c.astype(code_type(1 << max(0, (d - 1).bit_length()), r))
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(k).take(take) for k in (0, 1, 2, 4)), pa.array([vectors[i].tobytes() for i in rows], pa.binary()), pa.array([x.tobytes() for x in small], pa.binary()), buckets],
                        ["node", "n", "label", "rotations", "vector", "codes", "buckets"],
                    )

    return nodes.select("node", "n", "label", "embedding", "rotations").mapInArrow(run, "node long, n long, label long, rotations int, vector binary, codes binary, buckets array<struct<key:long,t:int,own:boolean,code:long>>")


def normal(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision, without overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def compare(code: int, table: int, x: dict, y: dict | None, kind: str, tables: int):
    """Links between the rows of x (or of x and y) that meet in a bucket, as arrays: nodes
    with one, copies linked that are counted here, a node that stands for those reached."""
    other = y or x
    floats = lambda g: normal(np.frombuffer(b"".join(g["vector"]), kind).reshape(len(g["node"]), -1))
    good = floats(x) @ floats(other).T >= SIMILAR
    good &= (x["label"][:, None] == other["label"][None]) & (x["own"][:, None] | other["own"][None]) & (x["node"][:, None] != other["node"][None])
    i, j = np.nonzero(np.triu(good, 1) if y is None else good)
    if not len(i):
        return None
    coded = lambda g: np.frombuffer(b"".join(g["codes"]), f"<u{len(g['codes'][0]) // (tables * PROBES)}").reshape(-1, tables, PROBES)
    all_x, all_y = coded(x), coded(other)
    # where each linked pair meets first: a table in which the own bucket of one is a
    # bucket of the other, and there the smaller node's own bucket if the other visits it
    counted = np.zeros(len(i), bool)
    for a in range(0, len(i), 1 << 14):
        p, q = i[a : a + (1 << 14)], j[a : a + (1 << 14)]
        cx, cy = all_x[p], all_y[q]
        xy, yx = (cx[:, :, :1] == cy).any(2), (cy[:, :, :1] == cx).any(2)
        first = (xy | yx).argmax(1)
        r = np.arange(len(p))
        swap = x["node"][p] > other["node"][q]
        small_met = np.where(swap, yx[r, first], xy[r, first])
        small, large = np.where(swap, cy[r, first, 0], cx[r, first, 0]), np.where(swap, cx[r, first, 0], cy[r, first, 0])
        counted[a : a + (1 << 14)] = (first == table) & (np.where(small_met, small, large) == code)
    nodes = x["node"] if y is None else np.concatenate([x["node"], y["node"]])
    copies = x["n"] if y is None else np.concatenate([x["n"], y["n"]])
    j = j if y is None else j + len(x["node"])
    links = np.bincount(i, copies[j] * counted, len(nodes)) + np.bincount(j, copies[i] * counted, len(nodes))
    some = np.unique(np.concatenate([i, j]))
    return nodes[some], links[some].astype(np.int64), nodes[joined(len(nodes), i, j)][some]


def met(nodes: DataFrame, kind: str) -> DataFrame:
    """(node, links, low): links counted, and a node that is reached, by bucket and pair
    of blocks. Buckets are counted first, so a vector goes only where another one is."""
    light = nodes.select("node", F.explode("buckets").alias("b")).select("node", "b.*")
    sizes = light.groupBy("key").agg(F.count("*").alias("rows"), F.max("own").alias("some")).where("rows > 1 and some").drop("some")
    sizes = written(sizes, "sizes")
    rows = looked_up(light, sizes, "key", nodes.count() * max(TABLES.values()), count="rows")
    rows = rows.join(nodes.drop("buckets"), "node").withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.select("key", "t", "own", "node", "n", "label", "rotations", "vector", "codes", "block", "code", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    rows = rows.withColumn("i", F.least("block", "k")).withColumn("j", F.greatest("block", "k")).drop("k")
    rows = rows.repartition(width(nodes), "key", "i", "j").sortWithinPartitions("key", "i", "j", "label")
    names = ["key", "t", "own", "node", "n", "label", "rotations", "vector", "codes", "block", "code", "i", "j"]

    def run(batches):
        def groups():
            """Runs of equal (key, i, j, label) across batches, each at most two blocks."""
            held: list = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                held.append(batch)
                table = pa.Table.from_batches(held)
                change = np.flatnonzero(np.any([np.diff(table.column(c).to_numpy()) != 0 for c in ("key", "i", "j", "label")], 0)) + 1
                edges = [0, *change.tolist()]
                if len(edges) > 1:
                    yield from cut(table, edges)
                    held = table.slice(edges[-1]).combine_chunks().to_batches()
            if held:
                table = pa.Table.from_batches(held)
                yield from cut(table, [0, table.num_rows])

        def cut(table, edges):
            whole = {c: table.column(c).to_numpy() for c in names if c not in ("vector", "codes")}
            raw = {c: table.column(c).to_pylist() for c in ("vector", "codes")}
            for a, b in itertools.pairwise(edges):
                if b - a > 1:
                    yield {c: v[a:b] for c, v in {**whole, **raw}.items()}

        rows: list = []
        size = 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], ["node", "links", "low"])  # noqa: B023, E731
        for g in groups():
            i, j = int(g["i"][0]), int(g["j"][0])
            part = lambda k: {c: (np.asarray(g[c])[k] if c not in ("vector", "codes") else [g[c][r] for r in np.flatnonzero(k)]) for c in names}  # noqa: B023, E731
            x, y = (g, None) if i == j else (part(g["block"] == i), part(g["block"] == j))
            if len(x["node"]) and (y is None or len(y["node"])) and (found := compare(int(g["code"][0]), int(g["t"][0]), x, y, kind, TABLES[int(g["rotations"][0])])):
                rows.append(found)
                size += len(found[0])
            if size > 20000:
                yield pack()
                rows, size = [], 0
        if rows:
            yield pack()

    return rows.select(*names).mapInArrow(run, "node long, links long, low long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each row of df: id, n_links, component_id, kept."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    finite = "id is not null and label is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)"
    rows = rows.withColumn("x", F.xxhash64("label", "embedding")).withColumn("y", F.xxhash64(F.lit(1), "embedding", "label"))
    good = rows.where(finite)
    nodes = written(good.groupBy("x", "y").agg(F.min("id").alias("node"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding")), "nodes")
    total = nodes.count()
    kind = "<f4" if dict(df.dtypes)[vector_col] == "array<float>" else "<f8"
    labels = nodes.groupBy("label").agg(F.count("*").alias("rows"), F.max(F.size("embedding")).alias("d"))
    labels = written(labels.select("label", "rows", rotations("rows", "d").alias("rotations")), "labels")
    turned = looked_up(nodes, labels, "label", total, count="rows")
    buckets = written(hashed(turned, kind), "hashed")
    links = written(met(buckets, kind), "met")
    dropped(buckets, labels)
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    tree = components(links.select(F.col("node").alias("a"), F.col("low").alias("b")))
    told = nodes.select("x", "y", "node", "n").join(counts, "node", "left").join(tree, "node", "left")
    told = written(told.select("x", "y", "n", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")), "told")
    dropped(nodes, links)
    out = looked_up(good.select("id", "x", "y"), told, ["x", "y"], good.count()).select("id", "links", "component")
    alone = rows.where(f"coalesce(not ({finite}), true)").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    out = out.unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
