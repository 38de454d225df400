"""Helpers shared by the operators: the shared folder, staged tables, and text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets a fresh folder under the
    machine's temp folder. On a cluster a missing setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there, so a lost
    executor costs no more than its running tasks."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column begins with it."""
    while any(c.lower().startswith(name) for c in columns):
        name = "_" + name
    return name


def fold(id_col: Column, k: int) -> Column:
    """crc32 of the id as text, mod ``k``; -1 for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % k, F.lit(-1))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow file system and path of a shared folder (file, hdfs, s3, gs ...)."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def publish(fs: pafs.FileSystem, path: str, write) -> None:
    """Write a file under another name, then move it: a task that runs twice leaves one file."""
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with fs.open_output_stream(part) as out:
        write(out)
    fs.move(part, path)


def open_buffer(fs: pafs.FileSystem, path: str) -> pa.Buffer:
    """The whole file: memory-mapped if it is local, else read."""
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.memory_map(path).read_buffer()
    with fs.open_input_file(path) as f:
        return f.read_buffer()


def parts(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``max_bytes`` of ``column`` (a longer text comes alone)."""
    for batch in batches:
        sizes = batch.column(column)
        sizes = pc.fill_null(pc.binary_length(sizes), 0).to_pylist()
        first = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > max_bytes:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += n
        if first < batch.num_rows:
            yield batch.slice(first)


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts of a batch as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; null is empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


