"""Language identification of words in code-switched text: a linear-chain conditional random
field.

A word's features are hashed: the word, its first and last 1 to 4 characters, its character
2- and 3-grams, and whether the lexicon (words that the sample has LEXICON times or more)
has it mostly in one language, and which. Features have a weight for each language, learned
together with the weights of transitions between neighbouring words' languages; the
forward-backward algorithm gives each word's distribution over languages, and a document's is
the mean of its words'. Words are lower-cased runs of letters, digits and _ that hold a
letter; others tell nothing and are left out of the chain.

Learning wants labelled words, and labels are of documents: segments of documents whose
language is known are spliced, so that the chain sees switches; how often is SPLICED, a prior
and not a count. It runs on a bounded sample in one task, so the driver gets the model alone.
Forward-backward is exact on any length: blocks of words become matrices, the matrices of a
document are gone through one by one, and then all blocks at once word by word.

Null and empty texts, and those without letters, are UNKNOWN with score 0. So is every text
if nothing was learned. Repeated rows give equal results; rows of a null id or language are
not learned from, and of a repeated id the smallest text is.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.llm.pretokenise import portions, trim, words as runs_of_words

UNKNOWN = "und"
BUCKETS, AFFIXES, GRAMS = 1 << 17, (1, 2, 3, 4), (2, 3)
#: Most labelled documents to learn from, those of smallest hashed id; the segments that a
#: document gives at most, and their words.
SAMPLE, SEGMENTS, WORDS = 4000, 4, 64
#: Share of the sequences that are spliced of two to four pieces.
SPLICED = 0.5
#: Words that occur so often in the sample are in the lexicon, and in a language's if so large
#: a share of them is.
LEXICON, SHARE = 3, 0.8
EPOCHS, BATCH, RATE, DECAY = 3, 64, 0.2, 1e-5
#: Words that become one matrix.
BLOCK = 64
PRIME = np.uint64(0x9E3779B97F4A7C15)


def _hashed(codes: np.ndarray, at: np.ndarray, n: int, kind: int) -> np.ndarray:
    """Buckets of the n code points from each place on, apart for each kind of feature."""
    h = np.full(len(at), 8 * kind + n, np.uint64)
    for k in range(n):
        h = (h ^ codes[at + k]) * PRIME
        h ^= h >> np.uint64(29)
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of many words' features at once, as (place of the word, bucket), words in
    order. ``lexicon`` gives a word's entry; words that it lacks share one."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    every = np.arange(len(words))
    raw = [zlib.crc32(w.encode("utf-8", "surrogatepass"), 1) for w in words]
    known = _hashed(np.array([lexicon.get(w, 0) for w in words], np.uint64), every, 1, 3)
    owners, buckets = [every, every], [np.array(raw, np.int64) & (BUCKETS - 1), known]
    for n in AFFIXES:
        long = np.flatnonzero(sizes >= n)
        owners += [long, long]
        buckets += [_hashed(codes, (ends - sizes)[long], n, 0), _hashed(codes, ends[long] - n, n, 1)]
    for n in GRAMS:
        inside = np.flatnonzero(word[: len(codes) - n + 1] == word[n - 1 :]) if len(codes) >= n else np.empty(0, np.int64)
        owners.append(word[inside])
        buckets.append(_hashed(codes, inside, n, 2))
    owner, bucket = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(owner, kind="stable")
    return owner[order], bucket[order]


def normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


def marginals(emit: np.ndarray, ends: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Distribution of each word over the languages, by forward-backward over the chains
    that end at ``ends``; emit are the words' and moves the transitions' weights."""
    n, k = emit.shape
    out = np.empty((n, k))
    ends = np.asarray(ends, np.int64)
    lengths = np.diff(ends, prepend=0)
    chains = np.flatnonzero(lengths)
    if not len(chains):
        return out
    e, t = np.exp(emit - emit.max(1, keepdims=True)), np.exp(moves - moves.max())
    per = -(-lengths[chains] // BLOCK)
    chains = chains[np.argsort(-per, kind="stable")]  # longest first
    per = -(-lengths[chains] // BLOCK)
    first = np.cumsum(per) - per  # each chain's first block
    chain = np.repeat(np.arange(len(chains)), per)
    inner = np.arange(len(chain)) - first[chain]
    begin = (ends - lengths)[chains][chain] + inner * BLOCK
    size = np.minimum(BLOCK, ends[chains][chain] - begin)
    order = np.argsort(-size, kind="stable")  # blocks, longest first
    begin, size = begin[order], size[order]
    counts = np.searchsorted(-size, -np.arange(1, BLOCK + 1), "right")  # blocks that have a word at each place
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))  # where in that order a block is
    forward, backward = np.ones((len(order), k)), np.ones((len(order), k))
    if per[0] > 1:
        # from what a block is entered with to what its last word has
        m = np.eye(k)[None] * e[begin][:, None, :]
        for j in range(1, BLOCK):
            c = counts[j]
            m[:c] = (m[:c].reshape(-1, k) @ t).reshape(-1, k, k) * e[begin[:c] + j][:, None, :]
            m[:c] /= m[:c].sum((1, 2), keepdims=True)
        for i in range(1, int(per[0])):
            c = int(np.searchsorted(-per, -i))  # chains of more than i blocks
            at, into = place[first[:c] + i - 1], place[first[:c] + i]
            forward[into] = normal((forward[at][:, None, :] @ m[at])[:, 0] @ t)
        for i in range(int(per[0]) - 1, 0, -1):
            c = int(np.searchsorted(-per, -i))
            at, into = place[first[:c] + i], place[first[:c] + i - 1]
            backward[into] = normal((m[at] @ backward[at][:, :, None])[:, :, 0] @ t.T)
    for j in range(BLOCK):
        c = counts[j]
        if not c:
            break
        a = normal(forward[:c] * e[begin[:c] + j])
        out[begin[:c] + j] = a
        forward[:c] = a @ t
    for j in range(BLOCK - 1, -1, -1):
        c = counts[j]
        at = begin[:c] + j
        out[at] = normal(out[at] * backward[:c])
        backward[:c] = normal((e[at] * backward[:c]) @ t.T)
    return out


def gradient(emit: np.ndarray, moves: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the negative log-likelihood of chains of one length, (chains, words, languages)
    and (chains, words): by words' weights and by transitions' weights."""
    s, n, k = emit.shape
    e, t = np.exp(emit - emit.max(2, keepdims=True)), np.exp(moves)
    a, b = np.empty((n, s, k)), np.ones((n, s, k))
    a[0] = normal(e[:, 0])
    for j in range(1, n):
        a[j] = normal((a[j - 1] @ t) * e[:, j])
    pairs = np.zeros((k, k))
    for j in range(n - 1, 0, -1):
        ahead = e[:, j] * b[j]
        back = ahead @ t.T
        z = (a[j - 1] * back).sum(1)
        pairs += t * ((a[j - 1] / z[:, None]).T @ ahead)
        b[j - 1] = normal(back)
    by_word = normal(a * b).transpose(1, 0, 2)
    by_word[np.arange(s)[:, None], np.arange(n)[None], labels] -= 1
    np.add.at(pairs, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), -1)
    return by_word, pairs


class Model:
    """Languages, weights of features and of transitions, lexicon."""

    def __init__(self, languages: list[str], weights: np.ndarray, moves: np.ndarray, lexicon: dict[str, int]):
        self.languages, self.weights, self.moves, self.lexicon = languages, weights.astype(np.float32), moves, lexicon

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), len(self.languages)))
        for a in range(0, len(words), 8192):
            some = words[a : a + 8192]
            owner, bucket = features(some, self.lexicon)
            out[a : a + len(some)] = np.add.reduceat(self.weights[bucket], np.searchsorted(owner, np.arange(len(some))), axis=0)
        return out

    def documents(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of each text's language, or -1, and its score."""
        distinct, numbers, ends = runs_of_words([t.lower() for t in texts])
        names = [w.decode("utf-8", "surrogatepass") for w in distinct.to_pylist()]
        told = np.array([any(map(str.isalpha, w)) for w in names], bool)
        lang, score = np.full(len(texts), -1), np.zeros(len(texts))
        if not told.any() or not self.languages:
            return lang, score
        kept = told[numbers]
        ends = np.append(0, np.cumsum(kept))[ends]
        numbers = (np.cumsum(told) - 1)[numbers[kept]]
        by_word = marginals(self.emissions([w for w, yes in zip(names, told, strict=True) if yes])[numbers], ends, self.moves)
        lengths = np.diff(ends, prepend=0)
        text = np.repeat(np.arange(len(texts)), lengths)
        sums = np.stack([np.bincount(text, by_word[:, j], len(texts)) for j in range(len(self.languages))], 1)
        some = lengths > 0
        mean = sums[some] / lengths[some, None]
        lang[some], score[some] = mean.argmax(1), np.clip(mean.max(1), 0, 1)
        return lang, score

    def spans(self, text: str) -> list[dict]:
        """Stretches of words of one language: from where to where in the text, the
        language, and the mean of its words' probability."""
        found = [m for m in re.finditer(r"\w+", text) if any(map(str.isalpha, m.group()))]
        if not found or not self.languages:
            return []
        by_word = marginals(self.emissions([m.group().lower() for m in found]), np.array([len(found)]), self.moves)
        best = by_word.argmax(1)
        edges = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(found)]
        return [{"start": found[a].start(), "end": found[b - 1].end(), "lang": self.languages[best[a]], "score": float(by_word[a:b, best[a]].mean())} for a, b in zip(edges, edges[1:])]


def spliced(segments: list[tuple[np.ndarray, int]], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of WORDS words and their languages. Segments of all languages are drawn
    alike; a segment too short for its piece is gone through again."""
    by_lang = [np.flatnonzero([s[1] == k for s in segments]) for k in range(max(s[1] for s in segments) + 1)]
    words, labels = np.empty((len(segments), WORDS), np.int64), np.empty((len(segments), WORDS), np.int64)
    for row in range(len(segments)):
        cuts = np.sort(rng.integers(1, WORDS, rng.integers(1, 4))).tolist() if rng.random() < SPLICED else []
        for a, b in zip([0, *cuts], [*cuts, WORDS]):
            held, lang = segments[rng.choice(by_lang[rng.integers(len(by_lang))])]
            words[row, a:b] = held[(rng.integers(len(held)) + np.arange(b - a)) % len(held)]
            labels[row, a:b] = lang
    return words, labels


def train(rows: list[tuple[list[str], str]], seed: int = 0) -> Model:
    """Learns from segments (words, language)."""
    languages = sorted({lang for words, lang in rows if words})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)), {})
    k, numbers = len(languages), {}
    segments = [(np.array([numbers.setdefault(w, len(numbers)) for w in words]), languages.index(lang)) for words, lang in rows if words]
    counts = np.zeros((len(numbers), k))
    for held, lang in segments:
        np.add.at(counts[:, lang], held, 1)
    often = (counts.sum(1) >= LEXICON) & (counts.max(1) >= SHARE * counts.sum(1))
    lexicon = {w: int(counts[i].argmax()) + 1 for w, i in numbers.items() if often[i]}
    owner, bucket = features(list(numbers), lexicon)
    first = np.searchsorted(owner, np.arange(len(numbers) + 1))
    rng = np.random.default_rng(seed)
    weights, moves = np.zeros((BUCKETS, k), np.float32), np.zeros((k, k))
    seen, seen_moves = np.full((BUCKETS, k), 1e-3, np.float32), np.full((k, k), 1e-3)
    for _ in range(EPOCHS):
        words, labels = spliced(segments, rng)
        for a in range(0, len(words), BATCH):
            some, told = words[a : a + BATCH], labels[a : a + BATCH]
            distinct, inverse = np.unique(some, return_inverse=True)
            sizes = first[distinct + 1] - first[distinct]
            stop = np.cumsum(sizes)
            at = bucket[np.repeat(first[distinct] - (stop - sizes), sizes) + np.arange(stop[-1])]
            emit = np.add.reduceat(weights[at], stop - sizes, axis=0)[inverse.reshape(some.shape)]
            by_word, by_move = gradient(emit, moves, told)
            flat = by_word.reshape(-1, k)
            sums = np.stack([np.bincount(inverse.ravel(), flat[:, j], len(distinct)) for j in range(k)], 1)
            hit, where = np.unique(at, return_inverse=True)
            spread = np.repeat(sums, sizes, axis=0)
            down = np.stack([np.bincount(where, spread[:, j], len(hit)) for j in range(k)], 1) / some.size + DECAY * weights[hit]
            seen[hit] += down**2
            weights[hit] -= RATE * down / np.sqrt(seen[hit])
            by_move = by_move / some.size + DECAY * moves
            seen_moves += by_move**2
            moves -= RATE * by_move / np.sqrt(seen_moves)
    return Model(languages, weights, moves, lexicon)


def segments_of(text: str, name: str) -> list[list[str]]:
    """At most SEGMENTS stretches of WORDS words of a text, at places by its id's hash."""
    words = [w for w in re.findall(r"\w+", text.lower()) if any(map(str.isalpha, w))]
    cut = [words[a : a + WORDS] for a in range(0, len(words), WORDS)]
    if len(cut) <= SEGMENTS:
        return cut
    places = np.random.default_rng(zlib.crc32(name.encode())).choice(len(cut), SEGMENTS, replace=False)
    return [cut[p] for p in sorted(places.tolist())]


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> Model:
    """Learns from documents with an id, a language and a text, at most ``most`` of them."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("id is not null and lang is not null and text is not null")
    ids = rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(most)
    best = F.min(F.struct("text", "lang")).alias("b")
    texts = rows.join(F.broadcast(ids), "id").groupBy("id").agg(best).select(F.col("id").cast("string").alias("id"), "b.lang", "b.text")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                name, lang, text = (batch.column(c)[k].as_py() for c in range(3))
                found = [" ".join(s) for s in segments_of(text, name)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array([lang] * len(found), pa.string()), pa.array(found, pa.string())], ["id", "lang", "words"])

    def learn(batches):
        model = train([(r["words"].split(" "), r["lang"]) for batch in batches for r in batch.to_pylist()])
        told = [model.languages], [model.weights.tobytes()], [model.moves.tobytes()], [list(model.lexicon)], [list(model.lexicon.values())]
        kinds = pa.list_(pa.string()), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(told, kinds, strict=True)], ["languages", "weights", "moves", "words", "entries"])
        del model, told
        trim()

    parts = texts.mapInArrow(run, "id string, lang string, words string")
    one = parts.repartition(1).sortWithinPartitions("id", "words").mapInArrow(learn, "languages array<string>, weights binary, moves binary, words array<string>, entries array<long>").first()
    if one is None:
        return train([])
    k = len(one["languages"])
    return Model(one["languages"], np.frombuffer(one["weights"], np.float32).reshape(BUCKETS, k), np.frombuffer(one["moves"], np.float64).reshape(k, k), dict(zip(one["words"], one["entries"], strict=True)))


def predict(df: DataFrame, model: Model, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the language of its text and the share of it that the words have (0 to 1), in
    columns that replace those of the same names."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few MB

    @F.arrow_udf("struct<lang:string,score:double>")
    def told(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for _, some in portions(texts):
            numbers, found = shared.value.documents(some)
            langs += [shared.value.languages[i] if i >= 0 else UNKNOWN for i in numbers.tolist()]
            scores.append(found)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate([np.empty(0), *scores]))], ["lang", "score"])

    out = df.withColumn("__told", told(F.coalesce(F.col(text_col), F.lit(""))))
    return out.withColumn(lang, F.col("__told.lang")).withColumn(score, F.col("__told.score")).drop("__told")


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("score", pa.float64())]))


def switched(df: DataFrame, model: Model, text_col: str = "text", name: str = "spans") -> DataFrame:
    """df with the stretches of its text that are of one language, as code point ranges, in a
    column ``name``, which replaces one of that name."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<struct<start:int,end:int,lang:string,score:double>>")
    def told(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.spans(t) for _, some in portions(texts) for t in some], SPANS)

    return df.withColumn(name, told(F.coalesce(F.col(text_col), F.lit(""))))
