"""Operator 11: vector codes by slice-and-intersect bitmasks.

A vector becomes integers, floor(1024 * x), cut into ``PARTS`` consecutive parts; each part is coded
by the nearest of up to 256 codebook entries (squared Euclidean distance, ties to the lower index).
The codebooks start as the parts of the 256 smallest vec_ids and are moved ``ROUNDS`` times to the
componentwise floored means of their parts.

The nearest entry is found exactly by masks. For each position inside a part the entries'
coordinates are sorted, and place k carries the mask (four uint64 words) of the first k entries in that
order. A window [x - r, x + r] is then the exclusive or of two masks, and the AND over the positions
gives exactly the entries inside the box. The search begins with an initial radius that is an upper
bound: the least distance to the entries that lie next to the query in one of the positions. A box of that
radius holds every entry that is as near or nearer, ties included, so distances are worked
out for its members only.

Each of the passes reads the integers written once to the shared folder; a task returns at
most one row of sums for each entry and position, so what reaches the driver is the codebook,
256 * dimension numbers, whatever the table's size.

Dropped: null vectors, vectors with null or non-finite components, and those of another length than the
first kept one (least vec_id; null ids come last, equal ids are ordered by their vectors). A length
that 4 doesn't divide is cut as evenly as whole positions go. Integers are clipped so far out that
the squared distances still fit into a long (beyond +-185,000 at 64 components). Null ids and repeated rows: a row
each. Fewer than 256 rows: as many entries. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm.common import staged, table

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Parts whose masks are intersected at once.
_QUERIES = 2048


class Codebook:
    """Entries of one part position, with their sorted coordinates and prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, width = entries.shape
        self.order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, self.order, axis=0)
        bit = np.zeros((n, ENTRIES // 64), np.uint64)
        bit[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        zero = np.zeros((1, ENTRIES // 64), np.uint64)
        self.prefix = [np.concatenate([zero, np.bitwise_or.accumulate(bit[self.order[:, d]], axis=0)]) for d in range(width)]
        self.all = np.bitwise_or.reduce(bit, axis=0)

    def _distance(self, parts: np.ndarray, entry: np.ndarray) -> np.ndarray:
        apart = parts - self.entries[entry]
        return np.einsum("ij,ij->i", apart, apart)

    def bound(self, parts: np.ndarray) -> np.ndarray:
        """Initial radius, squared: the least distance to an entry next to the query in some position."""
        best = self._distance(parts, np.zeros(len(parts), np.int64))
        for d in range(parts.shape[1]):
            at = np.minimum(np.searchsorted(self.sorted[:, d], parts[:, d]), len(self.entries) - 1)
            np.minimum(best, self._distance(parts, self.order[at, d]), out=best)
        return best

    def candidates(self, parts: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, entry) pairs inside the boxes of radius sqrt(square)."""
        radius = np.ceil(np.sqrt(square.astype(np.float64)) * (1 + 1e-12)).astype(np.int64)
        mask = np.repeat(self.all[None], len(parts), axis=0)
        for d in range(parts.shape[1]):
            low = np.searchsorted(self.sorted[:, d], parts[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[:, d], parts[:, d] + radius, "right")
            mask &= self.prefix[d][high] ^ self.prefix[d][low]
        bits = np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(len(parts), -1), axis=1, bitorder="little")
        return np.nonzero(bits)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each part."""
        code, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        for k in range(0, len(parts), _QUERIES):
            some = parts[k:k + _QUERIES]
            query, entry = self.candidates(some, self.bound(some))
            apart = self._distance(some[query], entry)
            first = np.searchsorted(query, np.arange(len(some)))  # each box holds the entry of its bound
            least = np.minimum.reduceat(apart, first)
            hit = np.flatnonzero(apart == least[query])
            code[k:k + _QUERIES] = entry[hit[np.searchsorted(query[hit], np.arange(len(some)))]]
            error[k:k + _QUERIES] = least
        return code, error


def cuts(dim: int) -> list[int]:
    return [dim * k // PARTS for k in range(PARTS + 1)]


def _integers(dim: int):
    """Vectors as little-endian int64 components."""
    limit = math.isqrt((2**63 - 1) // max(1, dim)) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            whole = np.clip(np.floor(np.clip(flat, -limit, limit) * SCALE), -limit, limit).astype("<i8").reshape(batch.num_rows, dim)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([x.tobytes() for x in whole], pa.binary())],
                                             ["vec_id", "label", "whole"])
    return run


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("whole").to_pylist()), "<i8").reshape(batch.num_rows, dim)


def _sums(books: list[np.ndarray], dim: int):
    """Rows (part, entry, position, sum, n): what a task's parts add to each entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, ready = cuts(dim), [Codebook(b) for b in books]
        total = [np.zeros_like(b) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            whole = _matrix(batch, dim)
            for p, book in enumerate(ready):
                part = whole[:, bounds[p]:bounds[p + 1]]
                code, _ = book.nearest(part)
                np.add.at(total[p], code, part)
                count[p] += np.bincount(code, minlength=len(count[p]))
        for p in range(PARTS):
            used = np.flatnonzero(count[p])
            width = total[p].shape[1]
            shape = len(used) * width
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(shape, p, np.int32)), pa.array(np.repeat(used, width).astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(used))),
                 pa.array(total[p][used].ravel()), pa.array(np.repeat(count[p][used], width))], ["part", "entry", "position", "sum", "n"])
    return run


def _encode(books: list[np.ndarray], dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, ready = cuts(dim), [Codebook(b) for b in books]
        for batch in batches:
            whole = _matrix(batch, dim)
            found = [book.nearest(whole[:, bounds[p]:bounds[p + 1]]) for p, book in enumerate(ready)]
            code = np.column_stack([c for c, _ in found]).astype(np.uint8)
            error = sum(e for _, e in found)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()),
                                              pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])
    return run


def moved(books: list[np.ndarray], whole: DataFrame, dim: int) -> list[np.ndarray]:
    """The codebooks after one round: floored means of the parts of each entry; unused ones stay."""
    sums = whole.mapInArrow(_sums(books, dim), "part int, entry int, position int, sum long, n long") \
        .groupBy("part", "entry", "position").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"), F.sum("n").alias("n"))
    new = [b.copy() for b in books]
    for r in sums.collect():  # entries * dimension rows at most
        new[r.part][r.entry, r.position] = int(r["sum"]) // r.n
    return new


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of every kept row."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).alias("label"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.where(F.coalesce(~bad, F.lit(False)))
    order = [F.col("vec_id").asc_nulls_last(), "embedding"]
    first = kept.orderBy(*order).select(F.size("embedding").alias("n")).first()
    dim = first.n if first else 0
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    fields = f"vec_id {kinds['vec_id']}, label {kinds['label']}"
    kept = kept.where(F.size("embedding") == dim)
    whole = staged(kept.mapInArrow(_integers(dim), f"{fields}, whole binary"), "integers")
    seeds = [next(_integers(dim)(iter([pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([r.embedding], pa.list_(pa.float64()))], ["vec_id", "label", "embedding"])])))
             for r in kept.orderBy(*order).limit(ENTRIES).collect()]
    start = np.concatenate([_matrix(s, dim) for s in seeds]) if seeds else np.zeros((0, dim), np.int64)
    bounds = cuts(dim)
    books = [np.ascontiguousarray(start[:, a:b]) for a, b in zip(bounds, bounds[1:])]
    for _ in range(rounds if seeds else 0):
        books = moved(books, whole, dim)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    coded = staged(whole.mapInArrow(_encode(books, dim), f"{fields}, code string, error long"), "codes")
    errors = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(errors, F.col("label").eqNullSafe(F.col("_label"))) \
        .select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings")).drop("label")
