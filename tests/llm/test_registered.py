"""The registered queries on the smallest tables, every column of the contract against a
plain computation of it."""

import base64
import hashlib
import html
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def texts(data):
    t = pq.read_table(f"{data}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return {r["doc_id"]: r["text"] or "" for r in t}


@pytest.fixture(scope="module")
def library(texts):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return {i: t.encode(x, add_special_tokens=False).ids for i, x in texts.items()}


@pytest.fixture(scope="module")
def run(spark, data):
    return lambda name: [r.asDict() for r in entry.queries()[name](spark, data).collect()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(run, library):
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in run("op1_pack"):
        ids = [*library[r["doc_id"]], 1]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(library)
    for spans, size in [(v, len(library[k]) + 1) for k, v in pieces.items()] + [(v, None) for v in sequences.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at and length > 0
            at += length
        assert at == size if size else at == 2048 or (at < 2048 and at & (at - 1) == 0)


def test_op2(run, library):
    at = 0
    rows = sorted(run("op2_token_files"), key=lambda r: r["doc_id"])
    assert len(rows) == len(library)
    for r in rows:
        ids = [*library[r["doc_id"]], 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


def test_op4(run, texts):
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    rows = run("op4_bpe")
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        ids = want.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(texts[r["doc_id"]].encode()))


def test_op6(spark, data):
    folder = data.replace("sf0.001", "sf0.01")  # the smallest tables that hold secrets
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    assign = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    kinds = ["assign", "access", "hex", "literal"]
    rows = [r.asDict() for r in entry.queries()["op6_secrets"](spark, folder).collect()]
    assert sorted(r["doc_id"] for r in rows) == sorted(texts) and sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in rows) > 0
    for r in rows:
        t = texts[r["doc_id"]]
        found = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        listed = [f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda x: (x[1], kinds.index(x[0])))]
        counts = Counter(k for k, _, _ in found)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (counts["assign"], counts["access"], counts["hex"])
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if not s.startswith("literal")] == listed
        order = [(int(s.split(":")[1]), kinds.index(s.split(":")[0])) for s in spans]
        assert order == sorted(order)


def test_op7(spark, texts, data):
    folder = data.replace("sf0.001", "sf0.01")
    rows = [r.asDict() for r in entry.queries()["op7_quality"](spark, folder).collect()]
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    docs = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id"]).column(0).to_pylist()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r["predicted"] == labels[r["doc_id"]] for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert len(held) > 50 and np.mean(held) >= 0.97


def test_op8(run, data):
    pages = {r["page_id"]: r for r in pq.read_table(f"{data}/pages.parquet").to_pylist()}
    rows = run("op8_html")
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]]["html"], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        assert r["text"] == "\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def bags(texts):
    out = {}
    for i, t in texts.items():
        words = re.findall(r"\w+", t.lower())
        out[i] = Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()
    return out


def test_op10(run, texts):
    found, held = bags(texts), defaultdict(set)
    for i, b in found.items():
        for s in b:
            held[s].add(i)
    near = {(i, j) for v in held.values() for i in v for j in v if i < j}
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in near:
        both = sum((found[i] & found[j]).values())
        if both >= 0.8 * (sum(found[i].values()) + sum(found[j].values()) - both):
            a, b = sorted((top(i), top(j)))
            root[b] = a
    rows = run("op10_bagminhash")
    assert {r["doc_id"]: r["class_id"] for r in rows} == {i: top(i) for i in texts} and len(rows) == len(texts)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in rows)
