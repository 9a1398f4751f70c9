"""HTML extraction and WARC archives."""

import gzip
import hashlib
import io
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import html_text, warc
from lodestone.llm.shared import file_system

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><a href=/>Home</a> Site</header>
<div id="cookie-notice">We use cookies. Accept them all please today.</div><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><main><article><h1>T &amp; x</h1>
<p>Para one is a good long  sentence,\nis it not.<aside>side note</aside><p>Two <b>bold</b> text<div class="ad-slot">Buy now! Buy now! Buy now!</div><ul><li>point a<li>point b</ul>
<p>See <a href=x>this link</a></p><p>To.</p><section id="comments"><h2>Comments</h2><p>Nice article, thank you very much for writing it.</p></section></article></main>
<form><label>Name</label><input></form><script>var a="<p>no</p>";</script><footer>&copy; 2020</footer>"""


def test_article_alone_is_left():
    assert html_text.main_text(PAGE).split("\n") == ["T & x", "Para one is a good long sentence, is it not.", "Two bold text", "point a", "point b", "See this link", "To."]


def test_odd_pages():
    assert html_text.main_text(None) == "" == html_text.main_text("") == html_text.main_text("<p></p><!-- x")
    assert html_text.main_text("<article><p>A plain text with an unclosed tag <b here") != ""
    assert html_text.main_text("<article><p>" + "word " * 50000 + "</article>") == ("word " * 50000).strip()
    assert html_text.main_text("<div>" * 3000 + "<article><p>Deep inside of it.") == "Deep inside of it."
    assert html_text.main_text("<article><p>1 &lt; 2 &#233;&nbsp;x</p><script>if (a<b) {}</script></article>") == "1 < 2 é x"


def test_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randrange(1, 9)
        scores = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.uniform(0, 1.5)) for _ in range(rng.randrange(14))]
        cost = lambda x: -sum(s for s, k in zip(scores, x) if k) + sum(w for i, j, w in edges if x[i] != x[j])  # noqa: B023, E731
        assert cost(html_text.cut(scores, edges)) == pytest.approx(min(map(cost, itertools.product((0, 1), repeat=n))))


def test_extract_keeps_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = html_text.extract(df)
    assert out.columns == ["page_id", "url", "text"] and sorted(len(r["text"]) for r in out.collect())[:2] == [0, 0]
    assert html_text.extract(df.limit(0)).count() == 0


def test_archive_round_trip(spark):
    big, same = "é" * 5000, "s" * 100
    rows = [(7, "http://x/\n%", big), (3, None, same), (2, "u", same), (9, "u", same), (1, "u", "tiny"), (4, "u", "tiny"), (5, "u", None), (6, "u", ""), (2, "u", same), (None, "n", same), (8, "u", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(0)).withColumn("chunk", F.lit(0)).repartition(3)
    folder, files = warc.write(df, chunk=999)
    chunks = [r.asDict() for r in warc.read(spark, folder, files, chunk=700).collect()]
    last = [r for r in chunks if r["last"]]
    assert len(last) == len(rows)
    for i, u, t in rows:
        raw = (t or "").encode()
        first = min((x for x, _, y in rows if y == t and x is not None), default=None) if len(raw) >= 100 else None
        got = [r for r in last if r["page_id"] == i]
        for r in got:
            again = i is not None and first is not None and i > first
            assert (r["url"], r["payload_bytes"], r["payload_digest"]) == (u, len(raw), hashlib.sha256(raw).hexdigest())
            assert (r["record_type"], r["refers_to"]) == (("revisit", first) if again else ("response", None))
            if not again and i != 2 and i is not None:
                mine = sorted((c for c in chunks if c["page_id"] == i), key=lambda c: c["chunk"])
                assert b"".join(c["data"] for c in mine) == raw and all(len(c["data"]) <= 700 for c in mine)
                for k, c in enumerate(mine):
                    assert c["payload_digest"] == hashlib.sha256(b"".join(x["data"] for x in mine[: k + 1])).hexdigest()
    folder, files = warc.write(df.limit(0))
    assert warc.read(spark, folder, files).count() == 0


def test_broken_archive_is_told(spark):
    folder, files = warc.write(spark.createDataFrame([(1, "u", "x" * 500)], "page_id long, url string, html string").coalesce(1))
    where, at = file_system(folder)
    name = next(r["name"] for r in files.collect() if r["records"])
    with where.open_input_stream(f"{at}/{name}", compression=None) as f:
        raw = f.read()
    bad = gzip.compress(gzip.decompress(raw).replace(b"xxxx", b"yyyy", 1))
    with pytest.raises(ValueError, match="digest"):
        list(warc.records(io.BytesIO(bad)))


def test_archive_is_one_of_responses_and_revisits(spark):
    rows = [(i, "u", "p" * 200 if i % 2 else f"page {i}") for i in range(12)] + [(1, "u", "p" * 200), (None, "u", "p" * 200)]
    folder, files = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    where, at = file_system(folder)
    ids, types = [], []
    for r in files.collect():
        with where.open_input_stream(f"{at}/{r['name']}", compression=None) as f:
            raw = gzip.decompress(f.read()).decode()
        ids += re.findall("WARC-Record-ID: <(urn:uuid:[0-9a-f-]{36})>", raw)
        types += re.findall("WARC-Type: (.*)\r", raw)
        for n, block in re.findall("Content-Length: ([0-9]+)\r\n\r\n(.*?)\r\n\r\n(?=WARC/|$)", raw, re.S):
            assert int(n) in (len(block), 0) or "HTTP/1.1 200 OK" in block
    assert len(ids) == len(set(ids)) == len(rows) and sorted(types) == ["response"] * 9 + ["revisit"] * 5


def test_a_payload_of_many_mebibytes(spark):
    df = spark.range(2).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.expr("repeat('0123456789abcdef', 4 << 20)").alias("html")).coalesce(1)
    folder, files = warc.write(df)
    got = warc.read(spark, folder, files, data=False).where("last").orderBy("page_id").collect()
    want = hashlib.sha256(b"0123456789abcdef" * (4 << 20)).hexdigest()
    assert [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in got] == [(0, "response", None, 64 << 20, want), (1, "revisit", 0, 64 << 20, want)]
    assert warc.read(spark, folder, files, data=False).where("page_id = 0").count() == 64
