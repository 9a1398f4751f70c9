"""Token-id output: flat files of unsigned integers with 64-bit document offsets.

A corpus is a folder. Each shard has ``NAME.bin`` (ids, little-endian uint16 or uint32),
``NAME.idx`` (int64, offsets of its documents inside the shard and its end) and
``NAME.ids`` (int64 document ids). ``manifest.json`` lists shards in order with their
bases, the prefix sums of the shards' token counts: a document's place in the corpus is
base + offset, so no task waits for another to know where it writes.

Each task attempt writes files of its own name, and the manifest holds the names of the
attempts that Spark committed; a lost executor or a second attempt leaves files that
nothing reads. Documents lie in ascending id; those without id come first (the manifest
counts them), rows with equal ids by the first characters of their texts. Null and empty
texts have the end id alone. Other columns of the table are ignored.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm.library import encoder
from lodestone.llm.pretokenise import runs, trim
from lodestone.llm.shared import file_system, make_dirs, scratch, width, written

#: Bytes read at once from a store that has no memory mapping, and documents in a batch.
READ, BATCH = 8 << 20, 4096


def write(df: DataFrame, path: str, folder: str | None = None, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the texts of df as a token corpus and returns its folder. One shuffle, by
    ranges of the id; a task streams its range to three files."""
    spark = df.sparkSession
    folder = folder or scratch(spark, "tokens")
    make_dirs(folder)

    def run(batches):
        encode = encoder(path)
        where, at = file_system(folder)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        docs = tokens = nulls = 0
        with where.open_output_stream(f"{at}/{name}.bin") as ids, where.open_output_stream(f"{at}/{name}.idx") as idx, where.open_output_stream(f"{at}/{name}.ids") as keys:
            idx.write(np.zeros(1, "<i8").tobytes())
            for batch in batches:
                nulls += batch.column(0).null_count
                keys.write(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                for _, some in runs(batch.column(1)):
                    flat, ends = encode.encoded(some, end)
                    ends = tokens + ends
                    idx.write(ends.astype("<i8").tobytes())
                    ids.write(flat.astype(flat.dtype.newbyteorder("<"), copy=False).tobytes())
                    docs, tokens = docs + len(some), int(ends[-1])
        trim()
        yield pa.RecordBatch.from_pylist([{"shard": shard, "name": name, "docs": docs, "nulls": nulls, "tokens": tokens, "dtype": np.dtype(encode.dtype).name}])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    # one id, or one text of it, may have many rows: ranges go on through both
    parts = rows.repartitionByRange(width(df), "id", F.substring("text", 1, 32), "row").sortWithinPartitions("id", "text", "row").select("id", "text")
    done = written(parts.mapInArrow(run, "shard long, name string, docs long, nulls long, tokens long, dtype string"), "manifest")
    base, shards = 0, []
    for row in done.orderBy("shard").collect():  # one row for each shard
        shards.append({"name": row["name"], "base": base, "docs": row["docs"], "nulls": row["nulls"], "tokens": row["tokens"], "dtype": row["dtype"]})
        base += row["tokens"]
    where, at = file_system(folder)
    with where.open_output_stream(f"{at}/manifest.json") as f:
        f.write(json.dumps({"tokens": base, "shards": shards}).encode())
    return folder


def manifest(folder: str) -> dict:
    where, at = file_system(folder)
    with where.open_input_stream(f"{at}/manifest.json") as f:
        return json.loads(f.read())


class Shard:
    """Documents of one shard. Local and mounted files are memory-mapped; from another
    store, ranges are read as they are asked for, which goes well in document order."""

    def __init__(self, folder: str, told: dict):
        from pyarrow import fs

        where, at = file_system(folder)
        self.dtype, self.tokens = np.dtype(told["dtype"]).newbyteorder("<"), told["tokens"]
        self.local = isinstance(where, fs.LocalFileSystem)
        read = lambda kind: np.memmap(f"{at}/{told['name']}.{kind}", "<i8", "r") if self.local else np.frombuffer(where.open_input_file(f"{at}/{told['name']}.{kind}").read(), "<i8")
        self.offsets = read("idx")
        self.ids = read("ids") if told["docs"] else np.empty(0, "<i8")
        if self.local:
            self.flat = np.memmap(f"{at}/{told['name']}.bin", self.dtype, "r") if self.tokens else np.empty(0, self.dtype)
        else:
            self.file, self.first, self.held = where.open_input_file(f"{at}/{told['name']}.bin"), 0, np.empty(0, self.dtype)

    def __len__(self) -> int:
        return len(self.ids)

    def __getitem__(self, i: int) -> np.ndarray:
        a, b = int(self.offsets[i]), int(self.offsets[i + 1])
        if self.local:
            return self.flat[a:b]
        if a < self.first or b > self.first + len(self.held):
            size = self.dtype.itemsize
            self.first, self.held = a, np.frombuffer(self.file.read_at(max((b - a) * size, READ // size * size), a * size), self.dtype)
        return self.held[a - self.first : b - self.first]


def read(spark: SparkSession, folder: str, id_col: str = "doc_id", derive=None, derived: str = "ids array<long>") -> DataFrame:
    """One row for each document: its id, start (ids of all documents before it),
    n_tokens, and what ``derive(ids)`` returns as the one column that ``derived``
    declares (by default the ids). A task reads a shard."""
    shards = manifest(folder)["shards"]
    derive = derive or (lambda ids: ids.astype(np.int64))
    column = derived.split(" ")[0]

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                shard = Shard(folder, shards[k])
                for a in range(0, len(shard), BATCH):
                    b = min(a + BATCH, len(shard))
                    ends = np.asarray(shard.offsets[a : b + 1])
                    ids = np.asarray(shard.ids[a:b])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, mask=np.arange(a, b) < shards[k]["nulls"]), pa.array(shards[k]["base"] + ends[:-1]), pa.array(np.diff(ends)), pa.array([derive(shard[i]) for i in range(a, b)])],
                        [id_col, "start", "n_tokens", column],
                    )

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, {derived}")
