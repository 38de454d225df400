"""Operator 10: token-id files with Elias-Fano document boundaries.

One file for each range of ids, numbered in id order, in the shared folder::

    ids of all documents, end ids included (uint16, or uint32 for a large vocabulary)
    Elias-Fano sequence of boundaries: 0 and the end of each document, in ids
    document ids (int64; those of the null documents are 0)
    footer: documents, null documents, ids, bytes of an id, the magic word (5 x int64)

There is no table of 64-bit offsets: a boundary is a select on the high bits. A file is written
as a stream under a temporary name and moved into place, so a task that runs again replaces its
own file. Files are read back by memory map.

Null text: no ids but the end id. Null id: sorted first, its ``doc_id`` stays null. Equal ids
and repeated rows are documents of their own, in the order of the input. An empty table gives
no file and no row. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm.common import filesystem, open_buffer, parts, publish, shared_path, staged, strings, table
from mailsift.llm.elias_fano import EliasFano
from mailsift.llm.tokens import END_ID, default_path, encoder

#: Units kept by a task's encoder: the rows are sorted beside it, in the same memory.
CACHE_UNITS = 400_000
MAGIC = int.from_bytes(b"EFTOKEN1", "little")
_END = np.array([END_ID], "<u4").tobytes()


def shard_path(path: str, shard: int) -> str:
    return f"{path}/shard-{shard:06d}.eftok"


def write_shard(fs, path: str, batches: Iterator[pa.RecordBatch], tokenizer: str) -> tuple[int, int]:
    """Write one file from sorted (id, text) batches; documents and ids written."""
    enc = encoder(tokenizer, CACHE_UNITS)
    kind = "<u2" if enc.vocab_size <= 1 << 16 else "<u4"
    names: list[int] = []
    lengths: list[int] = [0]
    nulls = 0

    def write(out) -> None:
        nonlocal nulls
        for batch in batches:
            for part in parts(iter([batch]), "text"):
                for name, text in zip(part.column("id").to_pylist(), strings(part, "text")):
                    ids = np.frombuffer(enc.encode(text) + _END, "<u4")
                    out.write(ids.astype(kind).tobytes())
                    nulls += name is None
                    names.append(name or 0)
                    lengths.append(len(ids))
        ends = np.cumsum(np.array(lengths, np.int64))
        pad = -int(ends[-1]) * np.dtype(kind).itemsize % 8
        out.write(b"\0" * pad + EliasFano.of(ends).to_bytes() + np.array(names, "<i8").tobytes())
        out.write(np.array([len(names), nulls, ends[-1], np.dtype(kind).itemsize, MAGIC], "<i8").tobytes())

    publish(fs, path, write)
    return len(names), sum(lengths)


class TokenFile:
    """A token-id file, mapped: boundaries by select, ids by slice."""

    def __init__(self, buffer: pa.Buffer):
        self.n, self.nulls, self.n_ids, width, magic = np.frombuffer(buffer, "<i8", 5, buffer.size - 40).tolist()
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        self.ids = np.frombuffer(buffer, f"<u{width}", self.n_ids)
        at = self.n_ids * width + -self.n_ids * width % 8
        self.ends, at = EliasFano.from_buffer(buffer, at)
        self.names = np.frombuffer(buffer, "<i8", self.n, at)

    def bounds(self, first: int, last: int) -> np.ndarray:
        """Boundaries of the documents from ``first`` to ``last`` (exclusive): one more than these."""
        return self.ends.access(np.arange(first, last + 1)).astype(np.int64)


def write_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` in ascending id order; one row for each file: shard, documents, ids.

    The rows are dealt by ranges of (id, place in the input), so that one id with a third of all
    rows is spread over several files.
    """
    # ids as long: a file holds 64-bit integers
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("id", "place").sortWithinPartitions("id", "place").select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        shard = TaskContext.get().partitionId()
        fs, folder = filesystem(path)
        fs.create_dir(folder, recursive=True)

        def all_batches():
            yield first
            yield from batches

        n, ids = write_shard(fs, shard_path(folder, shard), all_batches(), tokenizer)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": [n], "n_ids": [ids]})

    return staged(rows.mapInArrow(write, "shard int, n_docs long, n_ids long"), "token-files")


def read_files(files: DataFrame, path: str) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32.

    ``files`` has a row for each file (its size is the number of tasks that wrote, whatever the
    rows), so the starts of the files are summed in one small window.
    """
    from pyspark.sql import Window

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    slots = max(1, files.sparkSession.sparkContext.defaultParallelism * 2)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(path)
        for batch in batches:
            for shard, base in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist()):
                file = TokenFile(open_buffer(fs, shard_path(folder, shard)))
                for first in range(0, file.n, 4096):
                    last = min(file.n, first + 4096)
                    at = file.bounds(first, last)
                    crc = [zlib.crc32(file.ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                    known = np.arange(first, last) >= file.nulls  # nulls come first
                    yield pa.RecordBatch.from_arrays([
                        pa.array(file.names[first:last], mask=~known), pa.array(base + at[:-1]),
                        pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])

    return starts.select("shard", "base").repartition(slots, "shard").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    files = write_files(table(spark, sf_dir, "documents"), path, default_path())
    return read_files(files, path)
