"""Streaming forms of the stateful operators: the same limiter, metrics and upserts on
Structured Streaming sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from lodestone.operators.limiter import MAX_REQUESTS, WINDOW_SECONDS, LogLimiter


class LimiterState(StatefulProcessor):
    """Sliding-log limiter: a client's allowed times are its state."""

    def __init__(self, most: int, window: int):
        self.most, self.window = most, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getValueState("times", "times array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        limiter = LogLimiter(self.most, self.window * 1_000_000)
        if self.times.exists():
            limiter.times.extend(self.times.get()[0])
        all_rows = pd.concat(list(rows)).sort_values(["us", "request_id"])
        taken = [limiter.take(int(us)) for us in all_rows["us"]]
        self.times.update((limiter.state(),))
        yield pd.DataFrame({"client_id": key[0], "request_id": all_rows["request_id"].to_numpy(), "allowed": [t[0] for t in taken]})

    def close(self) -> None:
        pass


def limit_stream(requests: DataFrame, most: int = MAX_REQUESTS, window: int = WINDOW_SECONDS) -> DataFrame:
    """(client_id, request_id, allowed) of a stream (client_id long, ts timestamp, request_id
    long). Needs the RocksDB state store provider. Requests of a micro-batch are taken in
    time order; a client's state is at most ``most`` times."""
    rows = requests.select("client_id", F.unix_micros("ts").alias("us"), "request_id")
    return rows.groupBy("client_id").transformWithStateInPandas(LimiterState(most, window), "client_id long, request_id long, allowed boolean", "append", "none")


def metrics_stream(requests: DataFrame, late: str = "10 minutes", every: str = "1 minute") -> DataFrame:
    """Requests and failures by window of event time, endpoint and status; rows later than
    ``late`` are left out."""
    failed = F.count_if(~F.col("status").between(200, 399))
    return requests.withWatermark("ts", late).groupBy(F.window("ts", every), "endpoint", "status").agg(F.count("*").alias("requests"), failed.alias("failed"))


def upsert_stream(changes: DataFrame, read: Callable[[], DataFrame], merge: Callable[[DataFrame, DataFrame], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Merges each micro-batch into a snapshot: ``write(merge(read(), batch), batch id)``. The
    write must be the same when a batch comes again, as after a failure."""
    return changes.writeStream.foreachBatch(lambda batch, n: write(merge(read(), batch), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
