"""Near-duplicate documents by BagMinHash: weighted Jaccard of word-shingle multisets.

Words are lower-cased runs of word characters; a shingle is five of them (a shorter text
is one shingle) and weighs as often as it occurs. Weight is discretised at whole numbers
and split into dyadic blocks (0,1], (1,2], (2,4], (4,8], ...; each shingle runs a Poisson
process in each block that its weight reaches, at a rate in proportion to the block's
width, and a point falls by halving to a level inside the block: it counts if the
weight reaches that level. Each point marks one of SIZE components, and a component keeps
its earliest point. Two documents agree in a component with probability equal to their
weighted Jaccard similarity. As only the earliest points matter, processes stop at a
time that the document's total weight sets, so a signature costs one draw for each
shingle and a bounded number of points.

Signatures are banded; candidates are verified on their whole multisets. Exact copies (of
the words) are one node throughout. Buckets of at most SMALL nodes give all their pairs.
Larger ones give a star first; those that share members are one family. Once links are
verified, members of a family that are not in its dominant component are compared with
all its members, in blocks: products of occurrence matrices give all similarities of two
blocks exactly, and only who reaches whom leaves a task. So no pair of a bucket is lost,
and no list grows with the square of a group.

Documents without words (null, empty, punctuation) are classes of their own, as are rows
without id (class null). Rows that repeat an id are one document, which a link of any of
its texts links: each distinct (id, text) is signed and compared. ``copies`` tells such
rows apart by their texts.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.llm.pretokenise import portions, trim, words
from lodestone.llm.shared import components, dropped, held, joined, looked_up, written

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 25, 5
SIZE = BANDS * ROWS
#: Agreement of signatures below which a pair is not verified: four deviations (a chance
#: of 3e-5 for a pair at 0.8) below the threshold.
LIKELY = SIMILAR - 4 * (SIMILAR * (1 - SIMILAR) / SIZE) ** 0.5
SMALL = 24
#: Most documents, and shingles of documents, that a block should hold.
BLOCK, WEIGHT = 512, 1 << 20
#: Columns of an occurrence matrix held at once.
COLUMNS = 4096
GOLDEN, M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def bagged(texts: list[str]) -> list[np.ndarray]:
    """Of each text a 64-bit hash of each shingle, in order, repeats included."""
    distinct, numbers, ends = words([t.lower() for t in texts])
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_pylist()), np.uint64, len(distinct))[numbers]
    out = h[: max(0, len(h) - SHINGLE + 1)].copy()
    for k in range(1, SHINGLE):
        out = mix(out * GOLDEN + h[k : len(out) + k])
    found = []
    for a, b in itertools.pairwise([0, *ends.tolist()]):
        if b - a >= SHINGLE:
            found.append(out[a : b - SHINGLE + 1])
        else:
            found.append(np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes())], np.uint64) if b > a else h[:0])
    return found


def shingles(text: str | None) -> np.ndarray:
    return bagged([text or ""])[0]


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets (sorted values, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    every = a[1].sum() + b[1].sum() - both
    return float(both / every) if every else 0.0


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Row k: for each component the hash of its earliest point, for the bag k of
    (distinct shingle hashes, weights), none empty."""
    owner = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    values = np.concatenate([b[0] for b in bags])
    weights = np.concatenate([b[1] for b in bags]).astype(np.int64)
    total = np.array([b[1].sum() for b in bags], np.float64)
    best = np.full(len(bags) * SIZE, np.inf)
    mark = np.zeros(len(bags) * SIZE, np.uint64)
    reach = (np.log(SIZE) + 4) / total  # by then all components are marked, nearly always
    todo = np.ones(len(bags), bool)
    while todo.any():
        block, low, width = 0, 0, 1
        keep = todo[owner]
        own, val, wgt = owner[keep], values[keep], weights[keep]
        while len(own):
            state = mix(val + GOLDEN * np.array([block + 1], np.uint64))
            o, w, t, k = own, wgt, np.zeros(len(own)), 0
            while len(o):
                k += 1
                draw = mix(state + GOLDEN * np.array([k], np.uint64))
                t = t - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / (SIZE * width)
                alive = t <= reach[o]
                o, w, t, state, draw = o[alive], w[alive], t[alive], state[alive], draw[alive]
                if not len(o):
                    break
                place = mix(draw ^ M2)
                key = o * SIZE + (place % np.uint64(SIZE)).astype(np.int64)
                level = low + ((place >> np.uint64(32)) & np.uint64(width - 1)).astype(np.int64)  # halved to one level
                hit = level < w
                key, at, who = key[hit], t[hit], place[hit]
                np.minimum.at(best, key, at)
                first = best[key] == at
                mark[key[first]] = who[first]
            low += width
            block += 1
            width = low
            more = wgt > low
            own, val, wgt = own[more], val[more], wgt[more]
        todo = np.isinf(best.reshape(-1, SIZE)).any(1)
        reach = np.where(todo, reach * 2, reach)
        if todo.any():  # from the start, further: the same points come again
            redo = np.repeat(todo, SIZE)
            best[redo] = np.inf
    return mark.reshape(-1, SIZE)


def bands(signature: np.ndarray) -> np.ndarray:
    """64-bit bucket keys of signatures, one a band."""
    out = np.empty((len(signature), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(signature), b + 1, np.uint64) * GOLDEN
        for k in range(ROWS):
            key = mix(key * GOLDEN + signature[:, b * ROWS + k])
        out[:, b] = key
    return out


def signed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, words, weight, bands, signature) of each row with an id and words; ``words``
    is a 128-bit hash of the words, equal for exact copies; signatures keep 16 bits."""
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    kind = dict(source.dtypes)["id"]

    def run(batches):
        for batch in batches:
            for first, some in portions(batch.column(1)):
                rows, bags, digests = [], [], []
                for i, s in enumerate(bagged(some)):
                    if len(s):
                        rows.append(first + i)
                        bags.append(np.unique(s, return_counts=True))
                        digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                if rows:
                    sig = signatures(bags)
                    keys = bands(sig).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(rows)), pa.array(digests, pa.binary()), pa.array([int(b[1].sum()) for b in bags], pa.int64()),
                            pa.array(list(keys), pa.list_(pa.int64())), pa.array([x.tobytes() for x in sig.astype("<u2")], pa.binary()),
                        ],
                        ["id", "words", "weight", "bands", "signature"],
                    )
        trim()

    return written(source.mapInArrow(run, f"id {kind}, words binary, weight long, bands array<long>, signature binary"), "signatures")


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree in LIKELY of the components, with the share."""
    left = nodes.select(F.col("id").alias("a"), F.col("signature").alias("sa"))
    right = nodes.select(F.col("id").alias("b"), F.col("signature").alias("sb"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, SIZE) for k in (2, 3))
            share = (x == y).mean(1)
            some = pa.array(share >= LIKELY)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(some), batch.column(1).filter(some), pa.array(share[share >= LIKELY])], ["a", "b", "share"])

    kind = dict(nodes.dtypes)["id"]
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    return joined.mapInArrow(run, f"a {kind}, b {kind}, share double")


def bags_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, size, bag) of the texts (id, text) whose id is in ``wanted``, written: the
    occurrences of their shingles, sorted."""
    some = held(texts.select("id", "text"), wanted, "id")
    kind = dict(texts.dtypes)["id"]

    def run(batches):
        for batch in batches:
            for first, texts in portions(batch.column(1)):
                bags = [np.sort(occurrences(s)) for s in bagged(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array([len(b) for b in bags], pa.int64()), pa.array([b.tobytes() for b in bags], pa.binary())], ["id", "size", "bag"])
        trim()

    return written(some.mapInArrow(run, f"id {kind}, size long, bag binary"), "bags")


def verified(pairs: DataFrame, bags: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Pairs (a, b) whose whole shingle multisets have a weighted Jaccard similarity of
    ``similar`` or more. ``bags`` (id, bag) has each id once."""
    joined = pairs.select("a", "b").join(bags.select(F.col("id").alias("a"), F.col("bag").alias("x")), "a")
    joined = joined.join(bags.select(F.col("id").alias("b"), F.col("bag").alias("y")), "b").select("a", "b", "x", "y")
    kind = dict(bags.dtypes)["id"]

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similar * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return joined.mapInArrow(run, f"a {kind}, b {kind}")


def occurrences(shingles: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each shingle and the number of its occurrence: sets of these have
    the size of the multiset, and its overlaps."""
    values, counts = np.unique(shingles, return_counts=True)
    first = np.cumsum(counts) - counts
    k = np.arange(counts.sum()) - np.repeat(first, counts)
    return mix(np.repeat(values, counts) + k.astype(np.uint64) * GOLDEN)


def similarities(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Weighted Jaccard similarity of every bag of x (its occurrences) with every one of y."""
    bags = [*x, *y]
    sizes = np.array([len(b) for b in bags], np.float64)
    owner = np.repeat(np.arange(len(bags)), sizes.astype(np.int64))
    _, column, counts = np.unique(np.concatenate(bags), return_inverse=True, return_counts=True)
    shared = counts > 1  # what one bag alone has overlaps with nothing
    keep = shared[column]
    owner, column = owner[keep], (np.cumsum(shared) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(x), len(y)), np.float32)
    for a in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, (a, a + COLUMNS))
        held = np.zeros((len(bags), COLUMNS), np.float32)
        held[owner[lo:hi], column[lo:hi] - a] = 1
        both += held[: len(x)] @ held[len(x) :].T
    every = sizes[: len(x), None] + sizes[None, len(x) :] - both
    return both / np.maximum(every, 1)


def families(large: DataFrame, labels: DataFrame, bags: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Links (a, b) that lead from each member (id, star of its bucket) to one that stands
    for those it reaches, where its family lies in several components."""
    tied = components(large.select(F.col("id").alias("a"), F.col("star").alias("b")), "families")
    members = tied.select(F.col("node").alias("id"), F.col("component").alias("family")).join(labels.withColumnRenamed("node", "id"), "id", "left")
    members = members.join(bags.select("id", "size"), "id")
    members = written(members.select("id", "family", F.coalesce("component", "id").alias("component"), "size"), "members")
    parts = members.groupBy("family", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    most = F.struct("n", "component")
    parts = parts.groupBy("family").agg(F.max_by("component", most).alias("most"), F.max("n").alias("large"), F.max_by("size", most).alias("large_size"), F.sum("n").alias("n"), F.sum("size").alias("all_size")).where("n > large")
    # a family of one component needs no more; the number of the others is small beside the members
    parts = written(parts, "parts")
    rows = looked_up(members, parts, "family", members.count()).join(bags.select("id", "bag"), "id")
    kind = dict(members.dtypes)["id"]
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / WEIGHT)).cast("int")
    rows = rows.withColumn("blocks", blocks(F.col("n"), F.col("all_size"))).withColumn("others", blocks(F.col("n") - F.col("large"), F.col("all_size") - F.col("large_size")))
    place = lambda count: F.pmod(F.xxhash64("id"), F.col(count)).cast("int")
    column = ["family", "id", "component", "bag"]
    inside = rows.select(*column, F.lit(False).alias("out"), place("blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("j"))
    out = rows.where("component <> most").select(*column, F.lit(True).alias("out"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), place("others").alias("j"))

    def compare(pdf):
        import pandas as pd

        x, y = pdf[pdf["out"]], pdf[~pdf["out"]]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": []}, dtype=pdf["id"].dtype)
        bag = lambda p: [np.frombuffer(b, np.uint64) for b in p["bag"]]
        good = similarities(bag(x), bag(y)) >= similar
        good &= x["component"].to_numpy()[:, None] != y["component"].to_numpy()[None]
        i, j = np.nonzero(good)
        nodes = np.concatenate([x["id"].to_numpy(), y["id"].to_numpy()])
        low = joined(len(nodes), i, j + len(x))
        some = np.unique(np.concatenate([i, j + len(x)]))
        return pd.DataFrame({"a": nodes[some], "b": nodes[low[some]]})

    return inside.unionByName(out).groupBy("family", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}").where("a <> b")


def repeated(docs: DataFrame, id_col: str) -> bool:
    return bool(docs.groupBy(id_col).count().where("count > 1").take(1))


def text_key(id_col: str, text_col: str) -> Column:
    """One value for each pair of an id and a text."""
    name = F.col(id_col).cast("string")
    return F.md5(F.concat(F.char_length(name).cast("string"), F.lit(" "), name, F.lit(" "), F.col(text_col)))


def keyed(docs: DataFrame) -> DataFrame:
    """(id, doc, text) of each distinct (id, text) of docs, ``id`` a key and ``doc`` the id."""
    rows = docs.where("text is not null").distinct()
    return written(rows.select(text_key("id", "text").alias("id"), F.col("id").alias("doc"), "text"), "texts")


def linked(docs: DataFrame) -> DataFrame:
    """(node, component) of the ids that links of similarity SIMILAR reach. ``docs`` (id,
    text) has each id once."""
    sigs = signed(docs, "id", "text")
    total = sigs.count()
    same = written(sigs.groupBy("words").agg(F.min("id").alias("node"), F.count("*").alias("n")).where("n > 1"), "same")
    copies = written(looked_up(sigs.select("id", "words"), same, "words", total).where("id <> node").select("id", F.col("node").alias("b")), "copies")
    nodes = held(sigs, copies, "id", "left_anti").select("id", "weight", "bands", "signature")
    rows = nodes.select("id", "weight", F.explode("bands").alias("key"))
    many = written(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("star")).where("n > 1"), "many")
    rows = written(looked_up(rows, many, "key", total * BANDS), "buckets")
    # small buckets: equal sets of members meet in many bands and are listed once
    small = rows.where(f"n <= {SMALL}").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("id", "weight"))).alias("m")).select("m").distinct()
    pairs = small.select("m", F.posexplode("m").alias("k", "x")).select("x", F.explode(F.expr("slice(m, k + 2, size(m))")).alias("y"))
    pairs = pairs.select(F.col("x.id").alias("a"), F.col("x.weight").alias("wa"), F.col("y.id").alias("b"), F.col("y.weight").alias("wb"))
    large = rows.where(f"n > {SMALL}").select("id", "star").distinct()
    star = large.where("id <> star").select(F.least("id", "star").alias("a"), F.greatest("id", "star").alias("b"))
    pairs = pairs.where(f"least(wa, wb) >= {SIMILAR} * greatest(wa, wb)").select("a", "b").unionByName(star).distinct()
    ends = written(rows.select("id").distinct(), "ends")
    some = written(held(nodes, ends, "id").select("id", "signature"), "some")
    pairs = written(likely(pairs, some), "likely")
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(large.select("id"))
    wanted = written(wanted.distinct(), "wanted")
    bags = bags_of(docs, wanted)
    links = written(verified(pairs, bags).unionByName(copies.select(F.col("id").alias("a"), "b")), "links")
    labels = components(links)
    if not large.isEmpty():
        # what families add links whole components
        name = labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        more = families(large, labels, bags).join(name[0], "a", "left").join(name[1], "b", "left")
        more = written(more.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct(), "more")
        if more.take(1):
            joint = components(more).select(F.col("node").alias("component"), F.col("component").alias("low"))
            alone = joint.select(F.col("component").alias("node"), F.col("component")).join(labels, "node", "left_anti")
            labels = labels.unionByName(alone.select("node", "component")).join(joint, "component", "left").select("node", F.coalesce("low", "component").alias("component"))
    dropped(sigs, same, many, rows, ends, some, pairs, wanted, bags, links)
    return labels


def copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key) of each text_key of df whose text links of similarity SIMILAR lead to one of a
    smaller id, or to a smaller text of the same id."""
    docs = keyed(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null"))
    held = linked(docs.select("id", "text")).join(docs.withColumnRenamed("id", "node"), "node")
    first = held.groupBy("component").agg(F.min(F.struct("doc", "text", "node")).alias("m")).select(F.col("m.node").alias("node"))
    return held.join(first, "node", "left_anti").select(F.col("node").alias("key"))


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, kept) for each row of df: class_id is the smallest id of the
    documents that links of similarity SIMILAR reach, kept says that it is the row's own."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    if repeated(docs, "id"):
        texts = keyed(docs)
        ends = linked(texts.select("id", "text")).join(texts.select(F.col("id").alias("node"), "doc"), "node")
        ends = written(ends.select("doc", "component").distinct(), "ends")
        low = ends.groupBy("component").agg(F.min("doc").alias("low"))
        final = components(ends.join(low, "component").select(F.col("doc").alias("a"), F.col("low").alias("b")))
    else:
        final = linked(docs)
    out = df.select(F.col(id_col).alias("id")).join(final.withColumnRenamed("node", "id"), "id", "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("component", "id").alias("class_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("class_id"), F.lit(True)))
