"""Functions on items in parallel; a failing item is a row, not the end."""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame


def retry(call: Callable, tries: int = 3, wait: float = 1.0):
    """``call()``, again after doubling waits while it raises; the last failure is raised."""
    for n in range(tries):
        try:
            return call()
        except Exception:
            if n + 1 == tries:
                raise
            time.sleep(wait * 2**n)


def run_tasks(items: DataFrame, function: Callable[[str], str], item_col: str = "item", tries: int = 1, wait: float = 0.0) -> DataFrame:
    """(item, success, result, error) of ``function`` on each item, on the executors; each is
    tried up to ``tries`` times with doubling waits."""

    def run(batches):
        for batch in batches:
            rows = []
            for item in batch.column(0).to_pylist():
                row = {"item": item, "success": False, "result": None, "error": None}
                for n in range(tries):
                    try:
                        row |= {"success": True, "result": function(item), "error": None}
                        break
                    except Exception as e:
                        row["error"] = f"{type(e).__name__}: {e}"[:500]
                        if n + 1 < tries:
                            time.sleep(wait * 2**n)
                rows.append(row)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("item", pa.string()), ("success", pa.bool_()), ("result", pa.string()), ("error", pa.string())]))

    return items.select(items[item_col].cast("string").alias("item")).mapInArrow(run, "item string, success boolean, result string, error string")
