"""Language identification: forward-backward against enumeration, held-out accuracy,
code-switched texts, and odd input."""

import itertools
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from lodestone.llm import language, queries

ROWS = "doc_id long, text string, lang string"
EN = "the ship and the harbour with some of the people that were there on that day".split()
DE = "der Schiff und die Straße mit einigen von den Leuten welche dort gewesen waren an dem Tag".split()


def enumerated(emit, moves):
    """Marginals of one chain, by all labellings."""
    n, k = emit.shape
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        w = np.exp(sum(emit[i, p] for i, p in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
        for i, p in enumerate(path):
            out[i, p] += w
    return out / out.sum(1, keepdims=True)


def plain(emit, moves):
    """Marginals of one chain, word by word."""
    n, k = emit.shape
    e, t, a, b = np.exp(emit), np.exp(moves), np.ones((n, k)), np.ones((n, k))
    for i in range(n):
        a[i] = e[i] * (a[i - 1] @ t if i else 1)
        a[i] /= a[i].sum()
    for i in range(n - 2, -1, -1):
        b[i] = t @ (e[i + 1] * b[i + 1])
        b[i] /= b[i].sum()
    return a * b / (a * b).sum(1, keepdims=True)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    lengths = [0, 3, 1, 5, 0]
    emit, moves = rng.normal(size=(sum(lengths), 3)), rng.normal(size=(3, 3))
    got = language.marginals(emit, np.cumsum(lengths), moves)
    at = 0
    for n in lengths:
        if n:
            assert np.allclose(got[at : at + n], enumerated(emit[at : at + n], moves))
        at += n


def test_long_chains_of_many_blocks():
    rng = np.random.default_rng(1)
    lengths = [63, 64, 65, 1000, 0, 7, 129, 128, 5000]
    emit, moves = rng.normal(size=(sum(lengths), 4)) * 3, rng.normal(size=(4, 4)) * 2
    got = language.marginals(emit, np.cumsum(lengths), moves)
    at = 0
    for n in lengths:
        if n:
            assert np.allclose(got[at : at + n], plain(emit[at : at + n], moves))
        at += n


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(2)
    emit, moves, labels = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), rng.integers(0, 3, (2, 4))

    def loss(emit, moves):
        total = 0.0
        for e, y in zip(emit, labels, strict=True):
            score = lambda p: sum(e[i, x] for i, x in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p))  # noqa: E731, B023
            total += np.log(sum(np.exp(score(p)) for p in itertools.product(range(3), repeat=4))) - score(y)
        return total

    by_word, by_move = language.gradient(emit, moves, labels)
    for x, got, make in ((emit, by_word, lambda d: loss(emit + d, moves)), (moves, by_move, lambda d: loss(emit, moves + d))):
        for at in itertools.product(*map(range, x.shape)):
            d = np.zeros(x.shape)
            d[at] = 1e-5
            assert abs((make(d) - make(-d)) / 2e-5 - got[at]) < 1e-6


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(3)
    rows = [([str(w).lower() for w in rng.choice(words, 40)], lang) for words, lang in ((EN, "en"), (DE, "de")) for _ in range(200)]
    return language.train(rows)


def test_code_switched_text(model):
    text = " ".join(EN[:8]) + ", " + " ".join(DE[:9]) + ". 123 _ " + " ".join(EN[8:])
    spans = model.spans(text)
    assert [s["lang"] for s in spans] == ["en", "de", "en"]
    assert text[spans[1]["start"] : spans[1]["end"]] == " ".join(DE[:9])
    assert all(0.5 < s["score"] <= 1 for s in spans)


def test_odd_rows(spark, model):
    rows = [(1, None, "en"), (2, "", "en"), (3, " 12 _ !?\n", "en"), (4, " ".join(DE), "xx"), (4, " ".join(DE), None), (None, " ".join(EN), "en"), (5, " ".join(EN) + " 漢字 \x00 😀", "en"), (6, (" ".join(DE) + " ") * 20000, "de")]
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "7.5 as score", "'x' as spans", "1 as lang_pred")
    out = language.predict(df, model)
    assert sorted(out.columns) == sorted(["doc_id", "text", "lang", "score", "spans", "lang_pred"])
    got = [(r["doc_id"], r["lang_pred"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de"), (None, "en"), (5, "en"), (6, "de")], key=str)
    assert all(r["score"] == 0 if r["lang_pred"] == "und" else 0 < r["score"] <= 1 for r in out.collect())
    assert language.predict(df.limit(0), model).count() == 0
    spans = language.switched(df.where("doc_id in (1, 4)"), model).select("doc_id", "spans").collect()
    assert [[s["lang"] for s in r["spans"]] for r in sorted(spans, key=lambda r: r["doc_id"])] == [[], ["de"], ["de"]]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, None, "en"), (None, "the ship", "en"), (2, "the ship", None)], ROWS)
    model = language.fit(df)
    assert not model.languages
    assert {(r["lang_pred"], r["score"]) for r in language.predict(df, model).collect()} == {("und", 0.0)}
    assert not language.fit(df.limit(0)).languages
    one = language.fit(spark.createDataFrame([(1, "the ship", "en"), (2, "...", "de")], ROWS))
    assert one.languages == ["en"] and language.predict(df, one).where("lang_pred = 'en' and score = 1").count() == 2


def test_segments_come_from_whole_texts():
    text = " ".join(f"w{k}x" for k in range(64 * 50))
    found = {i: language.segments_of(text, str(i)) for i in range(40)}
    assert all(len(s) == 4 and all(len(x) == 64 for x in s) for s in found.values())
    assert len({x[0] for s in found.values() for x in s}) > 40
    assert language.segments_of("1 2 _", "a") == [] and language.segments_of("one Two", "a") == [["one", "two"]]


def test_registered_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").collect()
    truth = {r["doc_id"]: r for r in docs}
    got = entry.queries()["op11_language"](spark, data)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = {r["doc_id"]: r for r in got.collect()}
    assert set(got) == set(truth)
    model = queries.language_model(spark.read.parquet(f"{data}/documents.parquet"))
    langs, right = {r["lang"] for r in docs}, []
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        letters = any(map(str.isalpha, truth[i]["text"] or ""))
        assert r["lang_pred"] in langs if letters else r["lang_pred"] == "und"
        if r["held_out"] and letters:
            right.append(r["lang_pred"] == truth[i]["lang"])
        if letters and i % 10 == 0:  # the document's words one by one, without blocks or hashing together
            words = [w for w in language.re.findall(r"\w+", truth[i]["text"].lower()) if any(map(str.isalpha, w))]
            emit = np.stack([sum(model.weights[b].astype(float) for b in language.features([w], model.lexicon)[1]) for w in words])
            mean = plain(emit, model.moves).mean(0)
            assert model.languages[mean.argmax()] == r["lang_pred"] and abs(mean.max() - r["score"]) < 1e-4
    assert np.mean(right) > 0.95


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = [(i, " ".join(EN if i % 2 else DE), "en" if i % 2 else "de") for i in range(60)]
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    a = queries.language_model(spark.createDataFrame(rows, ROWS))
    b = queries.language_model(spark.createDataFrame([(i, t, "zz" if out(i) else lang) for i, t, lang in rows], ROWS))
    assert a.languages == b.languages == ["de", "en"] and np.array_equal(a.weights, b.weights) and np.array_equal(a.moves, b.moves)
