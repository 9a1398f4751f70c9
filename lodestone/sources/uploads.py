"""A data source of files in pieces: files of a folder are planned as partitions, read in
pieces of bounded size, checked by their first bytes, and left at a cap, so no row and no
task holds a whole file."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.sources.tables import UPLOAD_MB

#: Bytes of a piece, and of the files that a partition reads.
PIECE, PARTITION = 1 << 20, 128 << 20
MAGIC = b"%PDF"
SCHEMA = "path string, number int, data binary, bytes long, status int"
_KINDS = pa.schema([("path", pa.string()), ("number", pa.int32()), ("data", pa.binary()), ("bytes", pa.int64()), ("status", pa.int32())])
#: Statuses: taken, not of the kind, too large, not readable.
TAKEN, BAD, LARGE, FAILED = 200, 400, 413, 500


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class UploadReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.kinds = tuple("." + k.strip().lower() for k in options.get("extensions", "pdf").split(","))
        self.piece, self.cap = int(options.get("piece", PIECE)), int(options.get("cap", UPLOAD_MB << 20))
        self.magic = options.get("magic", MAGIC.decode()).encode()
        self.split = int(options.get("partition", PARTITION))
        if self.piece < max(1, len(self.magic)):
            raise ValueError("a piece must hold the first bytes that tell the kind")

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder if "://" in self.folder or self.folder.startswith("file:") else "file://" + self.folder)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        where, path = self._store()
        found = [f for f in where.get_file_info(fs.FileSelector(path)) if f.is_file and f.base_name.lower().endswith(self.kinds)]
        out, held, size = [], [], 0
        for f in sorted(found, key=lambda f: f.path):
            cost = min(f.size or 0, self.cap) + (1 << 16)  # a file costs its opening too
            if held and size + cost > self.split:
                out.append(Files(held))
                held, size = [], 0
            held.append(f.path)
            size += cost
        return [*out, Files(held)]

    def _pieces(self, where, path: str):
        """Rows of one file: its pieces, then one that tells how it ended."""
        total, number = 0, 0
        try:
            with where.open_input_stream(path) as stream:
                while data := stream.read(self.piece):
                    if not number and not data.startswith(self.magic):
                        return (yield path, None, None, len(data), BAD)
                    total += len(data)
                    if total > self.cap:
                        return (yield path, None, None, total, LARGE)
                    yield path, number, data, len(data), None
                    number += 1
        except OSError:
            return (yield path, None, None, total, FAILED)
        yield path, None, None, total, TAKEN if number else BAD

    def read(self, partition: Files):
        where, _ = self._store()
        for path in partition.paths:
            for row in self._pieces(where, path):
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _KINDS, strict=True)], schema=_KINDS)


class UploadSource(DataSource):
    """Format "uploads": rows (path, number, data, bytes, status) of the files of a folder.
    A file's pieces are numbered from 0, with a null status; a last row without data tells
    its status and the bytes that were read: 200, 400 without the first bytes of its kind or
    when empty, 413 above the cap (what came before it was read already), 500 if it cannot be
    read. Options: extensions, piece, cap, magic, partition (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "uploads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> UploadReader:
        return UploadReader(dict(self.options))


def uploads(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The pieces and statuses of a folder's files. Folders that pyarrow opens: local ones,
    hdfs, s3, gs."""
    spark.dataSource.register(UploadSource)
    return spark.read.format("uploads").options(**{k: str(v) for k, v in options.items()}).load(folder)


def accepted(pieces: DataFrame) -> DataFrame:
    """(path, number, data) of the files that were taken whole."""
    good = pieces.where(F.col("status") == TAKEN).select("path")
    return pieces.where("status is null").join(good, "path", "left_semi").select("path", "number", "data")


def statuses(pieces: DataFrame) -> DataFrame:
    """(path, status, bytes, pieces): a row a file."""
    rows = pieces.groupBy("path").agg(F.max("status").alias("status"), F.max(F.when(F.col("status").isNotNull(), F.col("bytes"))).alias("bytes"), F.count("number").alias("pieces"))
    return rows.where("status is not null")


def write_files(parts: DataFrame, head: Column, folder: str) -> int:
    """Writes files of parts (name, id, data): ``head``, then the data by id. A file is
    streamed by one task, which holds a part of it at a time, under a name of its own that it
    is moved from, so a task that fails or runs again leaves whole files. Returns how many files there are."""
    from lodestone.sources.tables import make_folder

    make_folder(folder)
    rows = parts.select("name", "id", "data", head.cast("binary").alias("head")).repartition("name").sortWithinPartitions("name", "id")

    def run(batches):
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(folder)
        name, out, part, count = None, None, "", 0

        def finish():
            out.close()
            where.move(part, f"{path}/{name}")  # a file is there when it is whole

        for batch in batches:
            for told, data, head in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if told != name:
                    if out:
                        finish()
                    name, part, count = told, f"{path}/.{uuid.uuid4().hex}", count + 1
                    out = where.open_output_stream(part)
                    out.write(head)
                out.write(data)
        if out:
            finish()
        yield pa.RecordBatch.from_pydict({"n": [count]})

    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
