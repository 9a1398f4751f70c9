"""WARC archives as a chunked record table.

A payload is never held as one record outside the row that brings it: Spark cuts it into
chunk rows (record id, chunk number, bytes), a task streams them into per-record gzip
members, and the reader streams them out again as chunk rows with the byte count and
SHA-256 so far; the row marked ``last`` has those of the full payload, and the reader
checks it against the record's header. The digest in the header is Spark's, of the row's
payload, as equal payloads must be known before any is written.

Records whose payloads are equal and have ``least`` bytes or more: the one of smallest id
is a response (an HTTP response with the payload as its body), the others are revisits of
it without payload (its digest and length are in their headers). Record ids are unique;
the row's id is in a header of its own. Null payloads are empty. Rows that repeat an id with
the same payload have the same type; a row without id is a response. Other columns are
ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm.shared import dropped, file_system, looked_up, make_dirs, scratch, small, written

CHUNK = 1 << 20
#: Rows and bytes of a batch that the reader hands to Spark.
ROWS, BYTES = 4096, 4 << 20
CHUNKS = "page_id long, url string, record_type string, refers_to long, chunk int, last boolean, payload_bytes long, payload_digest string"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def revisits(records: DataFrame, least: int) -> DataFrame:
    """(id, payload_digest, refers_to) of the records that revisit another, written. Keys
    alone are grouped and joined."""
    keys = written(records.where(F.col("payload_bytes") >= least).select("id", "payload_digest"), "payloads")
    first = keys.groupBy("payload_digest").agg(F.min("id").alias("refers_to"), F.max("id").alias("most"), F.count("*").alias("n"))
    first = written(first.where("most > refers_to").drop("most"), "firsts")
    again = looked_up(keys, first, "payload_digest", keys.count()).where("id > refers_to")
    again = written(again.select("id", "payload_digest", "refers_to").distinct(), "revisits")
    dropped(keys, first)
    return again


def chunk_rows(df: DataFrame, id_col: str, url_col: str, payload_col: str, least: int, size: int) -> DataFrame:
    """The records of df as chunk rows, those of a record together and in order."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    records = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    records = records.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    again = revisits(records, least)
    # payloads stay where they are while the revisits are few
    records = records.join(F.broadcast(again) if small(again) else again, ["id", "payload_digest"], "left")
    body = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    records = records.select("id", "url", "payload_bytes", "payload_digest", "refers_to", body.alias("body"))
    last = F.floor((F.greatest(F.octet_length("body"), F.lit(1)) - 1) / size).cast("int")
    rows = records.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    return rows.select("id", "url", "payload_bytes", "payload_digest", "refers_to", "chunk", F.substring("body", F.col("chunk") * size + 1, F.lit(size)).alias("data"))


def header(row: dict, record: str, date: str) -> bytes:
    """The head of a record, that of its HTTP response included."""
    revisit = row["refers_to"] is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{record}>", f"WARC-Date: {date}"]
    if row["id"] is not None:
        lines.append(f"X-Row-ID: {row['id']}")
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + row["url"].replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha256:{row['payload_digest']}")
    lines.append(f"X-Payload-Length: {row['payload_bytes']}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Row-ID: {row['refers_to']}"]
    block = b"" if revisit else HTTP % row["payload_bytes"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {0 if revisit else len(block) + row['payload_bytes']}", "", ""]
    return "\r\n".join(lines).encode() + block


def write(df: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, chunk: int = CHUNK, date: str = "1970-01-01T00:00:00Z") -> tuple[str, DataFrame]:
    """Writes a record for each row of df; returns the folder and the table of its files
    (name, records). A task attempt writes a file of its own name, and the table has the
    attempts that were committed."""
    spark = df.sparkSession
    folder = folder or scratch(spark, "warc")
    make_dirs(folder)

    def run(batches):
        where, at = file_system(folder)
        name = uuid.uuid4()
        file = f"part-{TaskContext.get().partitionId():06d}-{name.hex}.warc.gz"
        records, packer = 0, None
        with where.open_output_stream(f"{at}/{file}", compression=None) as out:
            for batch in batches:
                told = batch.drop_columns(["data"])
                for k in range(batch.num_rows):
                    row = {c: told.column(c)[k].as_py() for c in told.schema.names}
                    if row["chunk"] == 0:
                        if packer:
                            out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                        out.write(packer.compress(header(row, str(uuid.uuid5(name, str(records))), date)))
                        records += 1
                    out.write(packer.compress(batch.column("data")[k].as_buffer()))
            if packer:
                out.write(packer.compress(b"\r\n\r\n") + packer.flush())
        yield pa.RecordBatch.from_pylist([{"name": file, "records": records}])

    rows = chunk_rows(df, id_col, url_col, payload_col, least, chunk)
    return folder, written(rows.mapInArrow(run, "name string, records long"), "warc-files")


def records(stream, size: int = CHUNK):
    """Chunk rows of one archive, read as a stream."""
    with gzip.GzipFile(fileobj=stream) as f:
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                continue
            head = {}
            while (line := f.readline().rstrip(b"\r\n")):
                key, _, value = line.partition(b": ")
                head[key.decode()] = value.decode()
            number = lambda key: int(head[key]) if key in head else None  # noqa: B023, E731
            url = head.get("WARC-Target-URI")
            row = {
                "page_id": number("X-Row-ID"), "url": url and url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%"),
                "record_type": head["WARC-Type"], "refers_to": number("X-Refers-To-Row-ID"),
            }
            told, left = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["Content-Length"])
            if row["record_type"] == "revisit":
                yield row | {"chunk": 0, "last": True, "payload_bytes": number("X-Payload-Length"), "payload_digest": told, "data": b""}
                continue
            while (line := f.readline()) not in (b"\r\n", b""):  # the HTTP head
                left -= len(line)
            left -= len(line)
            digest, done, k = hashlib.sha256(), 0, 0
            while True:
                data = f.read(min(size, left))
                if len(data) < min(size, left):
                    raise ValueError(f"record {row['page_id']} is cut short")
                digest.update(data)
                left, done = left - len(data), done + len(data)
                if not left and digest.hexdigest() != told:
                    raise ValueError(f"record {row['page_id']} does not have the digest that its header tells")
                yield row | {"chunk": k, "last": not left, "payload_bytes": done, "payload_digest": digest.hexdigest(), "data": data}
                if not left:
                    break
                k += 1


def read(spark: SparkSession, folder: str, files: DataFrame, data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of the archives in ``files``; without ``data``, the bytes stay out."""
    fields = [f.split(" ")[0] for f in CHUNKS.split(", ")] + ["data"] * data
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), *[pa.binary()] * data]

    def run(batches):
        where, at = file_system(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with where.open_input_stream(f"{at}/{name}", compression=None) as stream:
                    for row in records(stream, chunk):
                        rows.append([row[f] for f in fields])
                        size += len(row["data"]) if data else 0
                        if len(rows) == ROWS or size >= BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], fields)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], fields)

    n = max(1, files.count())
    return files.select("name").repartition(n).mapInArrow(run, CHUNKS + ", data binary" * data)
