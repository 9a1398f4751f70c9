"""Parquet tables, file scans, uploads, and file sinks."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Files that a conversion takes, by extension.
EXTENSIONS = ("pdf", "pub")
BATCH_MB, UPLOAD_MB = 500, 100
PDF_MAGIC = "25504446"  # %PDF


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the one that the driver and all executors share,
    spark.checkpoint.dir; where that is unset, a local one if all tasks run here."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def make_folder(uri: str) -> None:
    where, path = FileSystem.from_uri(uri)
    where.create_dir(path, recursive=True)


def scan_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS, max_mb: int | None = BATCH_MB, content: bool = False, ordered: bool = True) -> DataFrame:
    """Files of a folder by path: path, length, and content if asked for (the metadata
    scan alone opens no file). Larger files than ``max_mb`` are left out. Without ``ordered``
    files stay where they are read, in no order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    files = files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*extensions))
    if max_mb is not None:
        files = files.where(F.col("length") <= max_mb * 1048576)
    files = files.select("path", "length", *(["content"] if content else []))
    return files.orderBy("path") if ordered else files


def upload_status(content: Column, cap_mb: int = UPLOAD_MB) -> Column:
    """HTTP status of an uploaded file: 400 without PDF magic, 413 over the cap, else 200."""
    magic = F.hex(F.substring(content, 1, 4)) == PDF_MAGIC
    return F.when(content.isNull() | ~magic, F.lit(400)).when(F.octet_length(content) > cap_mb * 1048576, F.lit(413)).otherwise(F.lit(200))


def safe_path(path: str, base: str) -> bool:
    """Whether a path lies in a base folder, compared by components."""
    base, path = os.path.realpath(base), os.path.realpath(path)
    return os.path.commonpath([base, path]) == base


Converter = Callable[[str, bytes], tuple[str, int]]
DOCUMENT = pa.schema([("path", pa.string()), ("success", pa.bool_()), ("output", pa.string()), ("text", pa.string()), ("pages", pa.int64()), ("error", pa.string())])


def by_extension(pdf: Converter, to_pdf: Callable[[str, bytes], bytes] | None = None) -> Converter:
    """A converter that goes by a file's extension: .pdf by ``pdf``, .pub by ``to_pdf`` first
    (an error without it); others succeed with an empty text."""

    def run(path: str, content: bytes) -> tuple[str, int]:
        kind = path.lower().rsplit(".", 1)[-1]
        if kind == "pub":
            if to_pdf is None:
                raise ValueError("no converter for .pub files")
            return pdf(path, to_pdf(path, content))
        return pdf(path, content) if kind == "pdf" else ("", 0)

    return run


def first_of(*converters: Converter) -> Converter:
    """Converters in order: the first that does not fail; after all a text that names the file."""

    def run(path: str, content: bytes) -> tuple[str, int]:
        for f in converters:
            try:
                return f(path, content)
            except Exception:  # noqa: S112  the next one is asked
                continue
        return f"Extracted content from {os.path.basename(path)} — placeholder for actual PDF text extraction", 0

    return run


def convert(files: DataFrame, converter: Converter) -> DataFrame:
    """(path, success, output, text, pages, error) of each file (path, content); a failure is
    a row. ``output`` is the path of a file that was taken, null for others."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                taken = path if path.lower().rsplit(".", 1)[-1] in EXTENSIONS else None
                try:
                    text, pages = converter(path, content)
                    rows.append({"path": path, "success": True, "output": taken, "text": text.strip(), "pages": int(pages), "error": None})
                except Exception as e:  # one bad file is a result, not the end of the batch
                    rows.append({"path": path, "success": False, "output": None, "text": "", "pages": 0, "error": f"{type(e).__name__}: {e}"[:500]})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, DOCUMENT)

    return files.select("path", "content").mapInArrow(run, "path string, success boolean, output string, text string, pages long, error string")


def convert_folder(spark: SparkSession, folder: str, out: str, converter: Converter, max_mb: int | None = BATCH_MB) -> int:
    """Converts the PDF and PUB files of a folder to Markdown files in another one; returns
    how many gave a text."""
    done = convert(scan_files(spark, folder, max_mb=max_mb, content=True, ordered=False), converter).where("success and text <> ''")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return write_files(done.select(name.alias("name"), F.col("text").alias("content")), out)


def ensure_collection(spark: SparkSession, path: str, dimensions: int, metric: str = "cosine") -> bool:
    """Makes an empty table of points if there is none, with its dimensions and metric in the
    schema; returns whether it did. One that is there must have the same."""
    from pyspark.sql import types as T

    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        told = spark.read.parquet(path).schema["embedding"].metadata
        if (told.get("dimensions"), told.get("metric")) != (dimensions, metric):
            raise ValueError(f"{path} has {told}")
        return False
    vector = T.StructField("embedding", T.ArrayType(T.FloatType()), True, {"dimensions": dimensions, "metric": metric})
    schema = T.StructType([T.StructField("point_id", T.StringType()), T.StructField("doc_id", T.StringType()), T.StructField("chunk_id", T.IntegerType()), T.StructField("content", T.StringType()), vector])
    spark.createDataFrame([], schema).write.parquet(path)
    return True


def text_slices(text: Column, size: int = 1024) -> Column:
    """A text as slices of ``size`` characters; null and empty texts have none."""
    n = F.ceil(F.char_length(text) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def script_name(topic: Column, language: Column, created: Column) -> Column:
    """File name of a script: word characters of the topic, language and time."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(topic, r"(?U)[^\w\s-]", "")), " ", "_")
    return F.concat(plain, F.lit("_"), language, F.lit("_"), F.regexp_replace(F.substring(created, 1, 19), ":", "-"), F.lit(".txt"))


def write_dataset(results: DataFrame, path: str, instruction: str) -> None:
    """Instruction rows as JSON lines, by path: {instruction, input, output}."""
    rows = results.where("success").orderBy("path").select(F.lit(instruction).alias("instruction"), F.lit("").alias("input"), F.col("text").alias("output"))
    rows.write.mode("overwrite").json(path)


def write_files(docs: DataFrame, folder: str, name_col: str = "name", text_col: str = "content", suffix: str = ".md") -> int:
    """Texts as UTF-8 files, one a row, ``name`` and suffix below ``folder``; returns how
    many. A file is written under a name of its own and then moved, so that a task that is
    run again, or fails halfway, leaves whole files."""

    def run(batches):
        where, at = FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + os.path.abspath(folder))
        where.create_dir(at, recursive=True)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = f"{at}/.{uuid.uuid4().hex}"
                with where.open_output_stream(part) as f:
                    f.write((text or "").encode("utf-8", "surrogatepass"))
                where.move(part, f"{at}/{name}{suffix}")
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["name"])

    return docs.select(F.col(name_col).alias("name"), F.col(text_col).alias("text")).where("name is not null").mapInArrow(run, "name string").count()
