import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.functions import classify, markdown, text
from lodestone.plans import ingest


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "c string").select(column.alias("x")).first()["x"]


def packed(spark, sents, most, overlap, **more):
    return spark.createDataFrame([(sents,)], "s array<string>").select(text.pack("s", most, overlap, **more).alias("x")).first()["x"]


def test_sentences(spark):
    assert one(spark, "One. Two!  Three?\nFour\n\nFive.Six", text.sentences(F.col("c"))) == ["One.", "Two!", "Three?", "Four", "Five.Six"]
    assert one(spark, None, text.sentences(F.col("c"))) == []
    assert one(spark, " \n\t ", text.sentences(F.col("c"))) == []
    assert one(spark, "你好。世界。", text.sentences(F.col("c"))) == ["你好。世界。"]


def test_pack_carries_the_last_word(spark):
    assert packed(spark, ["aaa bbb.", "ccc ddd.", "eee fff."], 17, 5) == ["aaa bbb. ccc ddd.", "ddd. eee fff."]
    assert packed(spark, ["aaa bbb.", "ccc ddd.", "eee fff."], 17, 0) == ["aaa bbb. ccc ddd.", "eee fff."]
    assert packed(spark, ["aaa bbb.", "ccc ddd.", "eee fff."], 17, 6, carry="tail") == ["aaa bbb. ccc ddd.", "c ddd. eee fff."]
    assert packed(spark, [], 10, 5) == []


def test_pack_splits_long_sentences_without_carry(spark):
    assert packed(spark, ["short.", "one two three four", "end."], 10, 5) == ["short.", "one two", "three", "four", "end."]
    assert packed(spark, ["x" * 30], 10, 5) == ["x" * 30]


def test_chunks_check_arguments(spark):
    docs = spark.createDataFrame([(1, "A. B.")], "doc_id long, content string")
    for bad in ({"most": 0}, {"ratio": 1.5}, {"ratio": -0.1}, {"overlap": -5}):
        with pytest.raises(ValueError):
            ingest.chunks(docs, **bad)
    assert [r["point_id"] for r in ingest.chunks(docs).collect()] == ["1_chunk_0"]


def test_byte_split(spark):
    cut = lambda value, most: one(spark, value, text.byte_split(F.col("c"), most))
    assert cut("hello world", 5) == ["hello", " worl", "d"]
    assert cut("สวัสดี", 5) == ["ส", "ว", "ั", "ส", "ด", "ี"]
    assert cut("a😀b", 3) == ["a", "b"]
    assert cut("", 3) == [] and cut(None, 3) == []


def test_byte_split_keeps_all(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("ab é中😀ส\n") for _ in range(rng.randrange(60))),) for _ in range(200)]
    df = spark.createDataFrame(rows, "c string")
    for most in (4, 5, 7, 20):
        for r in df.select("c", text.byte_split(F.col("c"), most).alias("x")).collect():
            sizes = [len(p.encode()) for p in r["x"]]
            assert "".join(r["x"]) == r["c"] and all(n <= most for n in sizes) and all(a + len(p[0].encode()) > most for a, p in zip(sizes, r["x"][1:]))


def test_frequent_words(spark):
    rng = random.Random(5)
    rows = [([rng.choice("abcdef") + rng.choice("xyz") for _ in range(rng.randrange(40))],) for _ in range(80)] + [([],), (None,)]
    for least in (1, 2, 3):
        for r in spark.createDataFrame(rows, "w array<string>").select("w", markdown.frequent(F.col("w"), least).alias("x")).collect():
            counts = Counter(r["w"] or [])
            assert r["x"] == [w for w, n in counts.items() if n >= least]


def test_speech_chunks(spark):
    assert one(spark, "Hi there.", text.speech_chunks("c", 20)) == ["Hi there."]
    assert one(spark, "One two. Three four. Five six.", text.speech_chunks("c", 16)) == ["One two.", "Three four.", "Five six."]
    assert one(spark, " " * 25, text.speech_chunks("c", 10)) == [" " * 10, " " * 10, " " * 5]


def test_query_tokens(spark):
    assert one(spark, "The cat's ไทย go_on 12 1234", text.query_tokens(F.col("c"))) == ["the", "cat", "ไทย", "go_on", "1234"]


def test_language(spark):
    told = lambda v: tuple(one(spark, v, classify.language(F.col("c"))))
    assert told("Hello world") == ("en", 0.91)
    assert told("สวัสดี") == ("th", 1.0)
    assert told("สวัสดี abc")[0] == "mixed"
    assert told("123") == ("en", 0.1) and told("  ") == ("en", 0.0) and told(None) == ("en", 0.0)


def test_domain(spark):
    told = lambda v, **m: tuple(one(spark, v, classify.domain(F.col("c"), **m)))
    assert told("portfolio risk strategy") == ("finance", 0.3)
    assert told("basic") == ("hardware", 0.11)
    assert told("story of a server") == ("hardware", 0.11)
    assert told("xyz") == ("general", 0.0) and told(None) == ("general", 0.0)
    assert told("xyz", mode="manual", manual="law") == ("law", 1.0)


def test_markdown(spark):
    body = "# Top\ntext [a](http://x) ![i](p.png)\n```python\nx = 1\n```\n```\ny\n```\n"
    assert [tuple(x) for x in one(spark, body, markdown.links(F.col("c")))] == [("a", "http://x"), ("i", "p.png")]
    assert [tuple(x) for x in one(spark, body, markdown.code_blocks(F.col("c")))] == [("python", "x = 1"), ("unknown", "y")]
    assert one(spark, body, markdown.title(F.col("c"))) == "Top"
    assert one(spark, "no", markdown.title(F.col("c"))) == "Untitled Document"


def test_key_terms(spark):
    body = "Deep Learning is good. Alpha beta beta beta gamma. `Code Here` Deep Learning"
    assert one(spark, body, markdown.key_terms(F.col("c"))) == ["Deep Learning", "Alpha", "beta"]
    thai = spark.createDataFrame([(["ทดสอบ", "และ", "ทดสอบ", "คน", "คน"],)], "t array<string>")
    assert thai.select(markdown.thai_key_terms(F.col("t")).alias("x")).first()["x"] == ["ทดสอบ"]


def test_front_matter_is_put_once(spark):
    made = markdown.front_matter(F.col("c"), F.lit("general"), F.lit("en"), F.lit("a.pdf"), "2024-01-01T00:00:00Z")
    first = one(spark, "text", made)
    assert first.startswith("---\ndomain: general\n") and first.endswith("text")
    assert one(spark, first, made) == first


def test_models_and_voices():
    assert classify.valid_model("BAAI/bge-m3") and not classify.valid_model("a b")
    assert classify.dimensions("nomic-embed-text") == 768 and classify.dimensions(None) == 1024
