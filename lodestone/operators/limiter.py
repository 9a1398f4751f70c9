"""Rate limiters. A client's decisions depend on each other, so its requests are taken in
time order; a task streams its clients and holds one client's short state, never its log.

A gap that empties the state makes what comes after it independent of what came before, so a
client's log is cut there into sessions, and tasks get sessions: a client that has most of the
requests is many of them. Gaps are found in the first and last request of each time slot that
a client uses, which are few however many requests there are. A client that never pauses is
one session, as each of its decisions depends on the one before."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

MAX_REQUESTS, WINDOW_SECONDS, SUB_WINDOWS = 100, 60, 10


class LogLimiter:
    """Sliding log: times of allowed requests that are younger than the window; a request
    that finds ``most`` of them is rejected and leaves no trace."""

    def __init__(self, most: int, window_us: int):
        self.most, self.window, self.times = most, window_us, deque()

    def take(self, now: int) -> tuple[bool, int]:
        while self.times and self.times[0] <= now - self.window:
            self.times.popleft()
        ok = len(self.times) < self.most
        if ok:
            self.times.append(now)
        return ok, len(self.times)

    def state(self) -> list[int]:
        return list(self.times)


class CounterLimiter:
    """Sliding counter over sub-windows: the last one's count, fading, and this one's."""

    def __init__(self, most: int, window_us: int, subs: int):
        self.most, self.sub = most, window_us // subs
        self.index = self.now = self.last = 0

    def take(self, at: int) -> tuple[bool, float]:
        index = at // self.sub
        if index != self.index:
            self.last = self.now if index == self.index + 1 else 0
            self.index, self.now = index, 0
        weighted = self.last * (1 - (at % self.sub) / self.sub) + self.now
        ok = weighted < self.most
        self.now += ok
        return ok, weighted


def sessions(rows: DataFrame, slot: int, cut: Column) -> DataFrame:
    """rows (client, us, ...) with ``session``: the number of cuts before it in its client's
    log. ``slot`` is a length in microseconds within which there is none; cut tells of a
    slot's ``first`` and ``slot`` number, and of ``last_before`` and ``slot_before``, those
    of the one before it, whether there is one between them."""
    rows = rows.withColumn("slot", F.floor(F.col("us") / slot))
    used = rows.groupBy("client", "slot").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    w = Window.partitionBy("client").orderBy("slot")
    used = used.withColumn("last_before", F.lag("last").over(w)).withColumn("slot_before", F.lag("slot").over(w))
    number = F.sum(F.when(cut, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(used.select("client", "slot", number.alias("session")), ["client", "slot"]).drop("slot")


def decide(requests: DataFrame, make, client: str, ts: str, tie: str, slot: int, cut: Column) -> DataFrame:
    """(client, tie, allowed, count) of each request by ``make()`` for each client's session."""
    kinds = dict(requests.dtypes)
    rows = requests.where(F.col(client).isNotNull() & F.col(ts).isNotNull()).select(F.col(client).alias("client"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(tie).alias("tie"))
    rows = sessions(rows, slot, cut).select("client", "us", "tie", "session")
    rows = rows.repartition("client", "session").sortWithinPartitions("client", "session", "us", "tie")

    def run(batches):
        held, limiter = None, None
        for batch in batches:
            allowed, counts = [], []
            for c, us, session in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if limiter is None or (c, session) != held:
                    held, limiter = (c, session), make()
                ok, n = limiter.take(us)
                allowed.append(ok)
                counts.append(float(n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(allowed, pa.bool_()), pa.array(counts, pa.float64())], [client, tie, "allowed", "count"])

    return rows.mapInArrow(run, f"`{client}` {kinds[client]}, `{tie}` {kinds[tie]}, allowed boolean, count double")


def log_limit(requests: DataFrame, most: int = MAX_REQUESTS, window: int = WINDOW_SECONDS, client: str = "client_id", ts: str = "ts", tie: str = "request_id") -> DataFrame:
    """Decisions of a sliding log; count is that of allowed requests in the window after it,
    remaining what is left."""
    span = window * 1_000_000
    out = decide(requests, lambda: LogLimiter(most, span), client, ts, tie, span, F.col("first") - F.col("last_before") >= span)
    return out.withColumn("count", F.col("count").cast("long")).withColumn("remaining", F.greatest(F.lit(0), most - F.col("count")).cast("long"))


def counter_limit(requests: DataFrame, most: int = MAX_REQUESTS, window: int = WINDOW_SECONDS, subs: int = SUB_WINDOWS, client: str = "client_id", ts: str = "ts", tie: str = "request_id") -> DataFrame:
    """Decisions of a sliding counter; count is the weighted count that a request finds."""
    span = window * 1_000_000
    return decide(requests, lambda: CounterLimiter(most, span, subs), client, ts, tie, span // subs, F.col("slot") - F.col("slot_before") >= 2)


def offered_load(requests: DataFrame, window: int = WINDOW_SECONDS, client: str = "client_id", ts: str = "ts", tie: str = "request_id") -> DataFrame:
    """(client, tie, offered): how many requests of its client there are in the window that
    ends with each, allowed or not, those of the same time included. A range frame within
    slots of one window, to which the slot before lends its requests: so a client's log is
    cut by time and not held by one task. Requests without client or time go."""
    span = window * 1_000_000
    rows = requests.where(F.col(client).isNotNull() & F.col(ts).isNotNull()).select(F.col(client).alias(client), F.col(tie).alias(tie), F.unix_micros(F.col(ts).cast("timestamp")).alias("__us"))
    slot = F.floor(F.col("__us") / span)
    rows = rows.withColumn("__own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("__slot", F.when(F.col("__own"), slot).otherwise(slot + 1))
    frame = Window.partitionBy(client, "__slot").orderBy("__us").rangeBetween(1 - span, 0)
    return rows.withColumn("offered", F.count("*").over(frame)).where("__own").select(client, tie, "offered")
