"""Quality classifier: supervised subword embeddings.

Each word has a hashed vector, and so has each of its character n-grams; of word bigrams
those of a word with itself have one (one vector for all such pairs, REPEAT times, as a word
brings many n-grams): a bigram's own vector would say nothing of other words' repeats. A
document is the mean of all of them and of PRIOR zero vectors, so that a few words decide
little; a softmax layer on the mean gives its class. Vectors and layer are learned by
stochastic gradient descent in numpy on a bounded sample of labelled documents, in one task,
so that the driver gets the model alone. A linear layer on a mean is a mean of per-feature
logits, so scoring folds the model to one number for each hash bucket: a word costs one
cache lookup.

Null and empty texts (no words) get the score of the layer's bias alone. Repeated rows
get equal scores; rows with a null id are scored and never learned from; of the texts of a
repeated id the smallest is learned from.
"""

from __future__ import annotations

import itertools
import operator
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.llm.pretokenise import PieceCache, portions, trim

BUCKETS, DIM, GRAMS = 1 << 18, 12, (2, 3, 4)
#: Most labelled documents to learn from; those of smallest hashed id are taken, as long as
#: they have no more than FEATURES distinct buckets together.
SAMPLE, FEATURES = 3000, 1 << 24
EPOCHS, RATE = 6, 0.4
#: Bucket and weight of the bigram of a word with itself; zero vectors in every mean.
SAME, REPEAT, PRIOR = 0, 8, 32
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Words that are hashed together.
TOGETHER = 8192


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of words and of their character n-grams, as (place of the word, bucket),
    for many words at once: n-grams are windows of one array of code points."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    raw = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(raw).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(r) for r in raw])
    word = np.repeat(np.arange(len(words)), sizes)
    owners = [np.arange(len(words))]
    hashes = [np.array([zlib.crc32(r.encode("utf-8", "surrogatepass"), 1) for r in raw], np.int64) & (BUCKETS - 1)]
    for n in GRAMS:
        inside = np.flatnonzero(word[: len(codes) - n + 1] == word[n - 1 :])
        h = np.full(len(inside), n, np.uint64)
        for k in range(n):
            h = (h ^ codes[inside + k]) * PRIME
            h ^= h >> np.uint64(29)
        owners.append(word[inside])
        hashes.append((h & np.uint64(BUCKETS - 1)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(hashes)


def repeated(words: list[str]) -> int:
    """Words that follow themselves."""
    return sum(map(operator.eq, words, itertools.islice(words, 1, None)))


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text, and how often each occurs."""
    words = (text or "").split()
    again = np.full(REPEAT * repeated(words), SAME, np.int64)
    return np.unique(np.concatenate([again, features(words)[1]]), return_counts=True)


class Model:
    """Per-bucket logits of class 1 against class 0, and the bias."""

    def __init__(self, logits: np.ndarray, bias: float):
        self.logits, self.bias, self.cache = logits.astype(np.float32), bias, None

    def __getstate__(self):
        return {"logits": self.logits, "bias": self.bias, "cache": None}

    def scores(self, texts: list[str]) -> list[float]:
        """Scores of texts; words that are not known yet are hashed together."""
        if self.cache is None:
            self.cache = PieceCache(None, 150_000)
        known, logits = self.cache, self.logits
        cut = [t.split() for t in texts]
        new = list(set(itertools.chain.from_iterable(cut)).difference(known))
        found = {w: v for w in new if (v := known.old.get(w)) is not None}
        lacking = [w for w in new if w not in found]
        for a in range(0, len(lacking), TOGETHER):
            some = lacking[a : a + TOGETHER]
            owner, bucket = features(some)
            sums, counts = np.bincount(owner, logits[bucket], len(some)), np.bincount(owner, minlength=len(some))
            found.update(zip(some, (sums + 1j * counts).tolist(), strict=True))
        held = {w: known[w] for w in set(itertools.chain.from_iterable(cut)).difference(found)} | found
        known.add({w: v for w, v in found.items() if len(w) <= 64})
        out = []
        for words in cut:
            again = REPEAT * repeated(words)
            total = sum(map(held.__getitem__, words), complex(again * float(logits[SAME]), again))
            out.append(float(1 / (1 + np.exp(-np.clip(total.real / (total.imag + PRIOR) + self.bias, -60, 60)))))
        return out

    def score(self, text: str | None) -> float:
        return self.scores([text or ""])[0]


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 0) -> Model:
    """rows: buckets, counts and class (0 or 1) of each document. Classes weigh as they
    occur. Without rows of both classes, the model tells their share."""
    classes = np.array([r[2] for r in rows])
    if len(set(classes.tolist())) < 2:
        share = (classes.sum() + 0.5) / (len(classes) + 1)
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    steps, at = epochs * len(rows), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            buckets, counts, label = rows[k]
            now = rate * (1 - at / steps)
            at += 1
            share = (counts / (counts.sum() + PRIOR)).astype(np.float32)
            hidden = share @ vectors[buckets] if len(buckets) else np.zeros(DIM, np.float32)
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            if len(buckets):
                # features of a document share its gradient; dividing by the largest share
                # lets rare ones move as far as frequent ones would in a short text
                back = layer @ p
                vectors[buckets] -= (now * share / max(share.max(), 1e-9))[:, None] * back
            layer -= now * np.outer(hidden, p)
            bias -= 0.1 * now * p
    return Model(vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> Model:
    """Learns from documents whose id has a label 0 or 1, at most ``most`` of them. Their
    features are counted where they lie, and one task of bounded size learns from them."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(known), "id")
    texts = texts.groupBy("id", "label").agg(F.min("text").alias("text")).select("id", "text", "label")
    kind = dict(texts.dtypes)["id"]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                buckets, counts = counted(batch.column(1)[k].as_py())
                raw = [pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (buckets, counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *raw, batch.column(2).slice(k, 1)], ["id", "buckets", "counts", "label"])

    def learn(batches):
        rows, size = [], 0
        for batch in batches:
            for buckets, counts, label in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                size += len(buckets) // 4
                if size <= FEATURES:
                    rows.append((np.frombuffer(buckets, "<i4"), np.frombuffer(counts, "<i4"), label))
        model = train(rows)
        yield pa.RecordBatch.from_arrays([pa.array([model.logits.tobytes()], pa.binary()), pa.array([model.bias])], ["logits", "bias"])
        del rows, model
        trim()

    counts = texts.mapInArrow(run, f"id {kind}, buckets binary, counts binary, label int")
    one = counts.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id").mapInArrow(learn, "logits binary, bias double")
    told = one.first()
    return Model(np.frombuffer(told["logits"], np.float32), told["bias"]) if told else train([])


def score(df: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """df with the model's score of its text (0 to 1, higher: class 1 likelier) in a
    column ``name``; a column of df that has that name already is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # 1 MB

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([x for _, some in portions(texts) for x in shared.value.scores(some)], pa.float64())

    return df.withColumn(name, scored(F.coalesce(F.col(text_col), F.lit(""))))
