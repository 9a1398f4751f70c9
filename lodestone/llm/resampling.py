"""Importance resampling towards a target corpus: documents whose n-grams the target has more
often than the corpus are drawn more often.

Texts' words are digits, letters a to z (A to Z lower-cased) and all characters above ASCII;
features are all runs of 1 to 3 consecutive words, hashed to BUCKETS. One pass counts the
buckets of the corpus, one those of the target; a table of BUCKETS gains (log-odds of target
against corpus, smoothed, in thousandths) is broadcast to a second pass that sums each
document's gains. Gumbel noise from a hash of the id turns the highest scores into a draw
without replacement. Scores are sorted as a table over all tasks: a row's rank is its place
in its partition and the sum of the partitions before. All of it is DataFrame functions.

Null and empty texts have no features: weight 0. Rows that repeat an id each get a row, of
their own text; a null id hashes as the empty string and comes first among ties. Without
target texts all gains are those of counts of 0. Extra columns go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.llm.shared import dropped, written

BUCKETS, LONGEST = 10_000, 3
#: What an ASCII character that is in no word becomes; letters become small.
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OTHERS = "".join(c for c in map(chr, range(128)) if not (c.isdigit() or c.isalpha()))


def words(text: Column) -> Column:
    """The words of a text, in order; null has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), _CAPITALS + _OTHERS, _SMALL + " " * len(_OTHERS))
    return F.array_remove(F.split(plain, " "), "")


def features(df: DataFrame, keep: list) -> DataFrame:
    """``keep`` of df (which has a column of words) and a row for each n-gram's bucket; a row
    with a null bucket for a document without words. The words are exploded first and the
    n-grams that begin at a word next, so that no array of all n-grams is built."""
    at = df.select(*keep, "words", F.posexplode_outer("words").alias("pos", "word"))
    after = [F.get("words", F.col("pos") + k) for k in range(1, LONGEST)]
    grams = [F.col("word"), *[F.concat_ws(" ", "word", *after[:k]) for k in range(1, LONGEST)]]
    whole = [F.lit(True), *[a.isNotNull() for a in after]]
    told = F.array(*[F.when(w, g) for w, g in zip(whole, grams, strict=True)])
    rows = at.select(*keep, "pos", F.posexplode(told).alias("more", "gram")).where("gram is not null or (pos is null and more = 0)")
    return rows.select(*keep, (F.crc32(F.col("gram").cast("binary")) % BUCKETS).cast("int").alias("bucket"))


def counted(texts: DataFrame) -> DataFrame:
    """(bucket, n) of all texts (a column ``words``); combined before the shuffle."""
    return features(texts, []).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain) of all BUCKETS buckets, of the counts of both."""
    rows = corpus.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    rows = rows.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    every = Window.partitionBy(F.lit(0))  # BUCKETS rows
    share = lambda n: F.sum(n).over(every).cast("double") + BUCKETS
    odds = ((F.col("t").cast("double") + 1) * share("s")) / ((F.col("s").cast("double") + 1) * share("t"))
    return rows.select("bucket", F.floor(1000 * F.ln(odds)).cast("long").alias("gain"))


def noise(id_text: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, of the hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def weighed(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", seed: int = 42) -> DataFrame:
    """(id, n_words, n_features, weight, score) of each row of docs."""
    # a row's number tells rows apart that repeat an id
    texts = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), words(F.col(text_col)).alias("words"))
    table = written(gains(counted(texts.select("words")), counted(target.select(words(F.col(target_col)).alias("words")))), "gains")
    keep = ["id", "row", "n_words"]
    every = features(texts.withColumn("n_words", F.size("words").cast("long")), keep).join(F.broadcast(table), "bucket", "left")
    sums = every.groupBy(*keep).agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"))
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    out = written(sums.select("id", "n_words", "n_features", "weight", (F.col("weight") + noise(name, seed)).alias("score")), "weighed")
    dropped(table)
    return out


def ranked(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """rows and their ``rank`` (from 1) in an order, up to ``most``; null after it. Sorted by
    ranges over all tasks; the sorted table keeps each row's partition and place, and only
    the partitions' counts are summed in one place."""
    sorted_ = written(rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "sorted")
    part, place = F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = sorted_.groupBy(part).agg(F.count("*").alias("n"))  # a row a partition
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sorted_.select("*", part).join(F.broadcast(sizes.select("part", before.alias("before"))), "part")
    rank = (F.col("before") + place + 1).cast("long")
    return placed.select(*rows.columns, F.when(rank <= most, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least: int = 20, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", seed: int = 42) -> DataFrame:
    """(id, n_features, weight, score, rank) of each row of docs: of those with ``least`` words
    or more, ``percent`` of a hundred are drawn, those of highest score, and have a rank
    from 1; ties go to the smaller id."""
    every = weighed(docs, target, id_col, text_col, target_col, seed)
    able = every.where(F.col("n_words") >= least)
    most = percent * able.count() // 100
    order = [F.col("score").desc(), F.col("id"), F.col("n_features")]
    out = ranked(able, order, most).unionByName(every.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
