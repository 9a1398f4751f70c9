"""Counters, histograms and exposition of request metrics, and batch summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.operators.graph import bounded

#: Pieces that a range of values is cut into, and rows of a group that may be sorted.
PIECES, SMALL = 1024, 1 << 16
# Upper bounds of duration buckets.
BUCKETS = (0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0)
# Names and help texts of the exposition format, in its order.
GAUGES = {"service_up": "Whether the service is up.", "active_requests": "Number of currently active requests."}
COUNTERS = {"requests_total": "Total number of HTTP requests.", "requests_success_total": "Total number of successful requests.", "requests_failed_total": "Total number of failed requests."}
ERROR_RATE = "Current error rate (failed / total requests)."
DURATION = "conversion_duration_seconds"


def by_endpoint(requests: DataFrame) -> DataFrame:
    return requests.groupBy("endpoint", "status").agg(F.count("*").alias("requests"))


def totals(requests: DataFrame) -> DataFrame:
    """One row: total, success (2xx and 3xx), failed, error_rate (0 of nothing)."""
    good = F.coalesce((F.col("status") >= 200) & (F.col("status") < 400), F.lit(False))
    out = requests.agg(F.count("*").alias("total"), F.count_if(good).alias("success"), F.count_if(~good).alias("failed"))
    return out.withColumn("error_rate", F.coalesce(F.try_divide(F.col("failed"), F.col("total")), F.lit(0.0)))


def histogram(requests: DataFrame, value: str = "duration", by: tuple[str, ...] = ()) -> DataFrame:
    """(le, bucket, count, sum): cumulative buckets, a row each, in one pass."""
    bounds = [*[(str(b), F.col(value) <= b) for b in BUCKETS], ("+Inf", F.col(value).isNotNull())]
    told = requests.groupBy(*by).agg(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(n).alias("le"), F.count_if(c).alias("bucket")) for k, (n, c) in enumerate(bounds)]).alias("b"), F.count(value).alias("count"), F.coalesce(F.sum(value), F.lit(0.0)).alias("sum"))
    return told.select(*by, F.explode("b").alias("b"), "count", "sum").select(*by, "b.ord", "b.le", "b.bucket", "count", "sum")


def prometheus(requests: DataFrame, active: int = 0) -> DataFrame:
    """(pos, line): the metrics in text exposition format."""
    t = totals(requests)
    lines = []
    for (name, text), value in zip(GAUGES.items(), ("1", str(active)), strict=True):
        lines += [F.lit(f"# HELP {name} {text}"), F.lit(f"# TYPE {name} gauge"), F.lit(f"{name} {value}")]
    for (name, text), c in zip(COUNTERS.items(), ("total", "success", "failed"), strict=True):
        lines += [F.lit(f"# HELP {name} {text}"), F.lit(f"# TYPE {name} counter"), F.concat(F.lit(f"{name} "), F.col(c).cast("string"))]
    lines += [F.lit(f"# HELP error_rate {ERROR_RATE}"), F.lit("# TYPE error_rate gauge"), F.concat(F.lit("error_rate "), F.format_string("%.6f", "error_rate"))]
    head = t.select(F.posexplode(F.array(*lines)).alias("pos", "line"))
    name = DURATION
    h = histogram(requests)
    rows = h.select((F.lit(100) + F.col("ord")).alias("pos"), F.concat(F.lit(f'{name}_bucket{{le="'), "le", F.lit('"} '), F.col("bucket").cast("string")).alias("line"))
    last = h.where("le = '+Inf'").select(F.posexplode(F.array(F.concat(F.lit(f"{name}_count "), F.col("count").cast("string")), F.concat(F.lit(f"{name}_sum "), F.format_string("%.6f", "sum")))).alias("p", "line")).select((F.lit(200) + F.col("p")).alias("pos"), "line")
    return head.unionByName(rows).unionByName(last)


def batch_summary(results: DataFrame) -> DataFrame:
    """One row: total, successful, failed, success_rate (0 of nothing)."""
    out = results.agg(F.count("*").alias("total"), F.count_if("success").alias("successful"))
    out = out.withColumn("failed", F.col("total") - F.col("successful"))
    return out.withColumn("success_rate", F.coalesce(F.try_divide(F.col("successful"), F.col("total")), F.lit(0.0)))


def latest(history: DataFrame, keep: int = 1000, ts: str = "ts", tie: str = "id") -> DataFrame:
    """The last ``keep`` entries: a top-k, not a global sort."""
    return history.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(keep)


def selected(rows: DataFrame, by: str, value: str, place: Column) -> DataFrame:
    """(by, value): of each group the value at ``place`` (of its count ``n``, from 0) of its
    sorted ones, exactly. Rounds of counts: the range where the value must lie is cut into
    PIECES, whose counts, smallest and largest values are taken where the rows are; the one
    that has the place is the next range. When ranges are small, or hold one value, their
    rows are sorted. So no group is ever sorted whole, and rounds shrink what they look at."""
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(by, F.col(value).cast("double").alias("v"))
    group = rows.groupBy(by).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    ranges = bounded(group.select(by, place.cast("long").alias("place"), "n", "low", "high"))
    here = lambda: rows.join(ranges, by).where(F.col("v").between(F.col("low"), F.col("high")))
    while not ranges.where((F.col("n") > SMALL) & (F.col("low") < F.col("high"))).isEmpty():
        # the ends are pieces of their own, so each round leaves them out whatever lies between;
        # halves are subtracted, as the difference of two doubles may not be finite
        inner = F.floor((F.col("v") / 2 - F.col("low") / 2) / F.nullif(F.col("high") / 2 - F.col("low") / 2, F.lit(0.0)) * PIECES)
        inner = F.greatest(F.lit(0), F.least(F.lit(PIECES - 1), F.coalesce(inner.cast("int"), F.lit(0))))
        piece = F.when(F.col("v") == F.col("low"), -1).when(F.col("v") == F.col("high"), PIECES).otherwise(inner)
        parts = here().groupBy(by, "place", piece.alias("piece")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        w = Window.partitionBy(by).orderBy("piece")  # at most PIECES rows and two
        parts = parts.withColumn("before", F.sum("n").over(w) - F.col("n"))
        ranges = bounded(parts.where((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n"))).select(by, (F.col("place") - F.col("before")).alias("place"), "n", "low", "high"))
    left = here().where("low < high").withColumn("at", F.row_number().over(Window.partitionBy(by).orderBy("v")) - 1)
    return left.where("at = place").select(by, F.col("v").alias(value)).unionByName(ranges.where("low = high").select(by, F.col("low").alias(value)))


def latency(requests: DataFrame, by: str, value: str = "duration") -> DataFrame:
    """Mean, least, most, and the value at index int(0.95 n) of the sorted ones, exactly."""
    rows = requests.where(F.col(value).isNotNull())
    out = rows.groupBy(by).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    p95 = selected(rows, by, value, F.floor(F.col("n") * 0.95)).withColumnRenamed(value, "p95")
    return out.join(p95, by, "left")
