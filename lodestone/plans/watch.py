"""Catalogue of indexes, parity checks at intervals, usage alerts, health."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F


@dataclass
class Indexes:
    """Named indexes: what they cover, and for vectors their dimensions. Exact searches
    never need one; ``verify`` says whether tables hold what an index tells."""

    held: dict[str, dict] = field(default_factory=dict)

    def create(self, name: str, kind: str, labels: tuple[str, ...], properties: tuple[str, ...], dimensions: int | None = None) -> bool:
        if name in self.held:
            return False
        self.held[name] = {"name": name, "type": kind, "labels": ",".join(labels), "properties": ",".join(properties), "dimensions": dimensions}
        return True

    def exists(self, name: str) -> bool:
        return name in self.held

    def drop(self, name: str) -> bool:
        return self.held.pop(name, None) is not None

    def verify(self, name: str, nodes: DataFrame) -> bool:
        """Whether nodes (label, ...) have the properties of an index, and vectors of its
        dimensions under its labels."""
        told = self.held.get(name)
        if told is None or not {"label", *told["properties"].split(",")} <= set(nodes.columns):
            return False
        if told["type"] != "VECTOR" or told["dimensions"] is None:
            return True
        wrong = F.lit(False)
        for c in told["properties"].split(","):
            wrong = wrong | (F.col(c).isNotNull() & (F.size(c) != told["dimensions"]))
        return nodes.where(F.col("label").isin(*told["labels"].split(","))).where(wrong).isEmpty()

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([tuple(v.values()) for v in self.held.values()], "name string, type string, labels string, properties string, dimensions int")


class ModelSlot:
    """Room for one model at a time: loading one unloads the one before, under a lock."""

    def __init__(self):
        self._lock = threading.RLock()
        self.kind: str | None = None
        self.model: object | None = None
        self.history: list[tuple[str, str]] = []

    def load(self, kind: str, make: Callable[[], object]) -> object:
        with self._lock:
            if self.kind != kind:
                self.unload()
                self.model = make()
                self.kind = kind
                self.history.append(("load", kind))
            return self.model

    def unload(self) -> bool:
        with self._lock:
            if self.kind is None:
                return False
            self.history.append(("unload", self.kind))
            self.kind = self.model = None
            return True


def approximate(points: DataFrame, query: list[float], k: int, width: float = 0.5, tables: int = 8) -> DataFrame:
    """(id, distance) of about the k nearest points by random projections: faster than an
    exact search and not always the same."""
    from pyspark.ml.linalg import Vectors

    rows = points.where("embedding is not null").select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=width, numHashTables=tables, seed=1).fit(rows)
    return model.approxNearestNeighbors(rows, Vectors.dense(query), k, distCol="distance").select("id", "distance")


class Scheduler:
    """Runs a check every ``interval`` seconds in a thread until it is stopped; a failing
    check is recorded and the next one runs."""

    def __init__(self, check: Callable[[], object], interval: float):
        self.check, self.interval = check, interval
        self.results: list[object] = []
        self._stop = threading.Event()
        self._thread: threading.Thread | None = None

    def start(self) -> bool:
        if self._thread and self._thread.is_alive():
            return False
        self._stop.clear()
        self._thread = threading.Thread(target=self._loop, daemon=True)
        self._thread.start()
        return True

    def _loop(self) -> None:
        while not self._stop.is_set():
            try:
                self.results.append(self.check())
            except Exception as e:
                self.results.append(e)
            self._stop.wait(self.interval)

    def stop(self) -> None:
        self._stop.set()
        if self._thread:
            self._thread.join()


def usage_alerts(history: DataFrame, limit: float, used: str = "used") -> DataFrame:
    """Entries of a usage history over a limit."""
    return history.where(F.col(used) > limit)


def all_healthy(parts: DataFrame, healthy: str = "healthy") -> Column | bool:
    """Whether all parts are; nothing is not."""
    found = parts.agg(F.bool_and(F.coalesce(F.col(healthy), F.lit(False))).alias("h")).first()["h"]
    return bool(found)
