"""Queries of the training-data operators, one each, on their whole tables."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.llm import bagminhash, bpe, html_text, language, packing, periodic, pivots, quality, resampling, secrets, token_files, vectors, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), derive=crc, derived="ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(spark, folder, derive=crc, derived="ids_crc32 long")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digests(vocab, ids, ends):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        names = [sha(x[:-1]) for x in vocab.joined(vocab.names, ids, ends)]  # the last space goes
        return [pa.array(np.diff(ends, prepend=0)), pa.array(names), pa.array([sha(x) for x in vocab.joined(vocab.bytes, ids, ends)])]

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), derive=digests, derived="n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kind = lambda k: F.size(F.filter("findings", lambda f: f["kind"] == k)).cast("long")
    listed = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    base = F.filter("findings", lambda f: f["kind"] != "literal")
    return found.select("doc_id", kind("assign").alias("n_assign"), kind("access").alias("n_access"), kind("hex").alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """Learned from documents that are not held out."""
    return quality.fit(docs, labels.where(~held_out("doc_id")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model).drop("text")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, files = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(spark, folder, files, data=False).where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(table(spark, sf_dir, "embeddings"), 5, "id % 50 = 0")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    texts = html_text.extract(pages, weights=html_text.fit(pages))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(table(spark, sf_dir, "documents"))


def language_model(docs: DataFrame) -> language.Model:
    """Learned from documents that are not held out."""
    return language.fit(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.predict(docs.select("doc_id", "text"), language_model(docs)).drop("text")
    unseen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return out.select("doc_id", F.coalesce(unseen, F.lit(False)).alias("held_out"), "lang_pred", "score")


def looped(docs: DataFrame) -> DataFrame:
    """docs with text repeated from a place on, with a period, in those whose hashed id ends
    with 0: place and period come from the hash. Words are then joined by one space."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.withColumn("g", F.when(h % 10 == 0, F.floor(h / 10)))
    rows = rows.withColumn("w", F.when(F.col("g").isNotNull(), F.array_remove(F.split("text", "[ \\t-\\r]"), "")))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    told = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", place(i))), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), told).otherwise(F.col("text")).alias("text"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digests(words, runs):
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        kept = b" ".join(periodic.unrolled(words, runs))
        return len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()

    names = ("n_runs", "start", "length", "period", "exponent_milli")
    derived = [*[(f"{n} long", pa.int64()) for n in names], ("runs_sha256 string", pa.string()), ("collapsed_sha256 string", pa.string())]
    return periodic.detect(looped(table(spark, sf_dir, "documents").select("doc_id", "text")), derive=digests, derived=derived)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_pack": op1_pack, "op2_token_files": op2_token_files, "op3_cross_polytope": op3_cross_polytope, "op4_bpe": op4_bpe, "op5_pivots": op5_pivots, "op6_secrets": op6_secrets, "op7_quality": op7_quality, "op8_html": op8_html, "op9_warc": op9_warc, "op10_bagminhash": op10_bagminhash, "op11_language": op11_language, "op12_periodic": op12_periodic, "op13_resample": op13_resample}
ORACLE_SQL = {
    "op3_cross_polytope": """
        with recursive v as (select vec_id, label, embedding::double[] as e from embeddings
                   where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
                     and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l as (select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
              where list_cosine_similarity(a.e, b.e) >= 0.93),
        r(x, y) as (select vec_id, vec_id from embeddings union select r.x, l.y from r join l on r.y = l.x),
        c as (select x, min(y) as low from r group by x), n as (select x, count(*) as n from l group by x)
        select vec_id, coalesce(n, 0) as n_links, low as component_id, vec_id = low as kept
        from embeddings join c on c.x = vec_id left join n on n.x = vec_id""",
    "op5_pivots": """
        with v as (select vec_id as id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
                   where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
        s as (select q.id as query_id, c.id as vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
              from v q join v c on q.id % 50 = 0 and c.id <> q.id),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 5""",
    "op10_bagminhash": """
        with recursive w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') as w from documents),
        s as (select doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
                                         when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w),
        c as (select doc_id, g, count(*) as n from s group by doc_id, g),
        t as (select doc_id, sum(n) as n from c group by doc_id),
        p as (select a.doc_id as x, b.doc_id as y, sum(least(a.n, b.n)) as shared from c a join c b on a.g = b.g and a.doc_id <> b.doc_id group by all),
        l as (select x, y from p join t a on a.doc_id = x join t b on b.doc_id = y where shared >= 0.8 * (a.n + b.n - shared)),
        r(x, y) as (select doc_id, doc_id from documents union select r.x, l.y from r join l on r.y = l.x),
        f as (select x, min(y) as low from r group by x)
        select doc_id, low as class_id, doc_id = low as kept from documents join f on f.x = doc_id""",
    "op9_warc": """
        with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
        f as (select d, min(page_id) as first from p where n >= 100 group by d)
        select page_id, n as payload_bytes, p.d as payload_digest,
               case when page_id > first then 'revisit' else 'response' end as record_type,
               case when page_id > first then first end as refers_to
        from p left join f on p.d = f.d and n >= 100""",
    "op13_resample": """
        with recursive poly(i, k, c) as (select i, 0, i from range(256) r(i) union all
                    select i, k + 1, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end from poly where k < 8),
        tab as materialized (select list(c order by i) as tab from poly where k = 8),
        corpus as (select doc_id, row_number() over () as k, 's' as side, text from documents),
        every as (select * from corpus union all select null, row_number() over (), 't', text from benchmark),
        w as materialized (select doc_id, k, side, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from every),
        g as materialized (select k, side, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
                                            list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as g from w),
        d as materialized (select g, hex(encode(g)) as x from (select distinct g from g)),
        h as materialized (select g, xor(list_reduce(list_transform(range(1, len(x), 2), lambda i: ((instr('0123456789ABCDEF', x[i]) - 1) * 16 + instr('0123456789ABCDEF', x[i + 1]) - 1)::bigint),
                                   lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1]), 4294967295), 4294967295) % 10000 as b from d, tab),
        n as materialized (select k, side, b, count(*) as n from g join h using (g) group by all),
        a as (select b, coalesce(sum(n) filter (side = 's'), 0)::double as s, coalesce(sum(n) filter (side = 't'), 0)::double as t from n group by b),
        z as (select sum(s) as s, sum(t) as t from a),
        o as materialized (select b, floor(1000 * ln(((a.t + 1) * (z.s + 10000)) / ((a.s + 1) * (z.t + 10000))))::bigint as gain from a, z),
        e as (select k, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from n join o using (b) where side = 's' group by k),
        r as (select doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
                     coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5) / 4294967296.0::double)))::bigint as score
              from w left join e on e.k = w.k where side = 's'),
        q as (select *, row_number() over (order by score desc, doc_id nulls first, n_features) as rank, count(*) over () as able from r where n_words >= 20)
        select doc_id, n_features, weight, score, case when rank <= 5 * able // 100 then rank end as rank from q
        union all select doc_id, n_features, weight, score, null from r where n_words < 20""",
}
