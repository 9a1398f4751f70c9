"""Periodic runs against all stretches of all periods."""

import hashlib
import re
import zlib

from hypothesis import given, settings, strategies as st

import __spark_entry__ as entry
from lodestone.llm import periodic

ROWS = "doc_id long, text string"


def brute(words, least=12):
    n, found = len(words), {}
    for q in range(1, n):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - a >= max(least, 2 * q):
                found.setdefault((a, i + q), q)
    return sorted((a, e - a, q) for (a, e), q in found.items())


def dropped(n, runs):
    return {k for a, size, q in runs for k in range(a + q, a + size) if k < n}


@settings(max_examples=400, deadline=None)
@given(st.integers(1, 6).flatmap(lambda k: st.lists(st.integers(0, k), max_size=80)), st.integers(0, 79), st.integers(1, 30), st.booleans(), st.integers(0, 79))
def test_runs(words, a, p, loop, other):
    if loop:
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)] if a < len(words) else words
        if other < len(words):
            words[other] = 99
    assert periodic.runs(words) == brute(words)
    assert periodic.runs(words, 2) == brute(words, 2)


def test_every_period_at_its_shortest():
    for q in range(1, 70):
        n = max(12, 2 * q)
        for lead in range(9):
            body = [1000 + i % q for i in range(n)]
            words = [*range(lead), *body, *range(500, 507)]
            assert periodic.runs(words) == [(lead, n, q)] == brute(words)
            assert periodic.runs([*range(lead), *body[:-1], *range(500, 507)]) == []


def test_structured_words():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    thue = [bin(i).count("1") % 2 for i in range(300)]
    for words in (b, thue, [0] * 300, [0, 1] * 150, ([0] * 20 + [1]) * 12, [0] * 50 + [1] * 50 + [0] * 50):
        assert periodic.runs(words) == brute(words)


def test_long_texts_are_linear():
    assert periodic.runs([0] * 200_000) == [(0, 200_000, 1)]
    assert periodic.runs([i % 70_000 for i in range(200_000)]) == [(0, 200_000, 70_000)]
    assert periodic.runs(list(range(200_000))) == []


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t\x0b"), (4, "a " * 20), (4, "a " * 20), (None, "b c " * 6), (5, "x y　z " * 12 + "é")]
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 as runs", "2 as id", "3 as collapsed")
    out = periodic.detect(df)
    assert out.columns == ["doc_id", "runs", "collapsed"]
    got = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.collect()), key=str)
    want = [(1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 20, 1)], "a"), (4, [(0, 20, 1)], "a"), (None, [(0, 12, 2)], "b c"), (5, [(0, 12, 1)], "x y　z é")]
    assert got == sorted(want, key=str)
    assert periodic.detect(df.limit(0)).count() == 0


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    gone = dropped(n, runs)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_registered_query(spark, data, tmp_path):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    looped = [i for i in range(1000, 1400) if zlib.crc32(str(i).encode()) % 10 == 0][:8]
    docs |= {i: docs[0][: 300 * k] for k, i in enumerate(looped)} | {1: None, 5000: "a b " * 30, 5001: "   x\x85y \n"}
    spark.createDataFrame(list(docs.items()), ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    out = entry.queries()["op12_periodic"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r[0]: tuple(r)[1:] for r in out.collect()}
    assert set(got) == set(docs)
    short = {i: t for i, t in docs.items() if len(t or "") < 6000}
    assert len(short) > 100 and any(got[i][0] for i in looped)
    for i, t in short.items():
        assert got[i] == expected(i, t), i
