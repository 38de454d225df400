"""Operator 5: SimHash near-duplicates by bit-sliced comparison.

Fingerprint: 64 majority bits over the XXH64 hashes (seed 42) of a text's word shingles. Two
fingerprints link if they differ in at most ``RADIUS`` bits; classes are the connected
components of these links.

Equal fingerprints are one row from the first shuffle on, however many documents have them. To
find links between different ones, the 64 bits are cut into ``RADIUS + 2`` blocks: two
fingerprints that link agree in two blocks at least, so they meet in one of the buckets keyed by
two blocks. Inside a bucket the fingerprints are stored as bit planes (word p, k holds bit p of
64 fingerprints); a query's differences are added up plane by plane in carry-save counters, 64
distances at a time, and a block of 64 is abandoned once all its distances exceed the radius.
What leaves a task is a spanning forest of a bucket's links, never all its pairs.

A bucket of more than ``BUCKET`` fingerprints is not compared as a whole: its members are keyed
anew by each fingerprint at distance 0 or 1 from them. Two members at distance 2 or less share
such a key, and no key has more than 65 members, so this is exact for any bucket (RADIUS 2).

Null text: as empty, fingerprint zero, which links like any other. Null id: the row stays; it has
its class's least id, null if no member has one. Repeated rows and ids: a row each. An empty table
gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from mailsift.llm.common import LOWER, fresh, parts, staged, table, utf8
from mailsift.llm.components import connected_components

WORDS = 3
RADIUS = 2
SEED = 42
BUCKET = 2048
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Cells (a query against 64 fingerprints) compared at once.
_CELLS = 1 << 15


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of a UTF-8 text, as an unsigned 64-bit integer."""
    found = text.translate(LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    first, last, n = starts[:len(found) - k + 1].tolist(), ends[k - 1:].tolist(), len(found) - k + 1
    for at in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at:at + (1 << 16)], last[at:at + (1 << 16)])], np.uint64)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", words: int = WORDS, out: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a (signed) long in the new column ``out``."""
    schema = StructType([*docs.schema.fields, StructField(out, LongType())])
    rows = docs.withColumn(out, F.lit(0).cast("long"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, text_col):
            fp = np.array([fingerprint(t, words) for t in utf8(part, text_col)], np.uint64).view(np.int64)
            yield part.set_column(part.num_columns - 1, out, pa.array(fp))

    return rows.mapInArrow(add, schema)


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes: [p, k] holds bit p of the fingerprints 64 k to 64 k + 63."""
    lanes = np.zeros(-(-len(fps) // 64) * 64, "<u8")
    lanes[:len(fps)] = fps
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def near_pairs(fps: np.ndarray, planes: np.ndarray, query: np.ndarray, word: np.ndarray, radius: int):
    """(query, lane) pairs at distance ``radius`` or less among the cells (query[i], word[i])."""
    width = radius.bit_length()
    counter = [np.zeros(len(query), np.uint64) for _ in range(width)]
    over = np.zeros(len(query), np.uint64)
    asked = fps[query]
    for p in range(64):
        carry = planes[p, word] ^ (np.uint64(0) - ((asked >> np.uint64(p)) & np.uint64(1)))
        for k in range(width):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if p % 8 == 7:
            far = over | _exceeds(counter, radius)
            live = far != _ALL
            if not live.all():
                query, word, over, asked = query[live], word[live], over[live], asked[live]
                counter = [c[live] for c in counter]
    near = ~(over | _exceeds(counter, radius))
    cell, bit = np.nonzero(np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return query[cell], word[cell] * 64 + bit


def _exceeds(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is over the radius: compared bit by bit from the top."""
    more = np.zeros_like(counter[0])
    same = ~more
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            same &= counter[k]
        else:
            more |= same & counter[k]
            same &= ~counter[k]
    return more


def forest(fps: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """Least linked member (as a place in ``fps``) of each fingerprint; buckets lie side by side."""
    planes = planes_of(fps)
    end = np.cumsum(sizes)
    begin = end - sizes
    of = np.repeat(np.arange(len(sizes)), sizes)
    first = np.arange(len(fps)) >> 6  # a pair is compared once: with the lanes from its own on
    cells = ((end[of] - 1) >> 6) - first + 1
    parent = np.arange(len(fps))
    upto = np.cumsum(cells)
    at = 0
    while at < len(fps):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _CELLS, "right")))
        n = cells[at:stop]
        query = np.repeat(np.arange(at, stop), n)
        word = first[query] + np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n)
        a, b = near_pairs(fps, planes, query, word, radius)
        keep = (b > a) & (b < end[of[a]])
        a, b = a[keep], b[keep]
        while len(a):
            ra, rb = parent[a], parent[b]
            differ = ra != rb
            if not differ.any():
                break
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent = up
        at = stop
    assert (parent >= begin[of]).all()
    return parent


def _link(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("fps")
            sizes = np.diff(lists.offsets.to_numpy())
            fps = lists.flatten().to_numpy().view(np.uint64)
            parent = forest(fps, sizes, radius)
            moved = np.flatnonzero(parent != np.arange(len(fps)))
            yield pa.RecordBatch.from_arrays([pa.array(fps[moved].view(np.int64)), pa.array(fps[parent[moved]].view(np.int64))], ["a", "b"])
    return run


def bucket_keys(fp: Column, radius: int) -> Column:
    """Keys (pair of blocks, their bits) under which a fingerprint looks for others."""
    n = radius + 2
    cuts = [64 * k // n for k in range(n + 1)]
    block = [F.shiftrightunsigned(fp, cuts[k]).bitwiseAND(F.lit((1 << cuts[k + 1] - cuts[k]) - 1)) for k in range(n)]
    return F.array(*[F.struct(F.lit(i).alias("pair"), block[x].alias("x"), block[y].alias("y"))
                     for i, (x, y) in enumerate(combinations(range(n), 2))])


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that join all fingerprints within ``radius`` of each other; ``distinct`` has
    each fingerprint once, in ``fp``."""
    keyed = distinct.select("fp", F.explode(bucket_keys(F.col("fp"), radius)).alias("key"))
    sizes = staged(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    met = keyed.join(sizes, "key")
    small = met.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
    edges = small.mapInArrow(_link(radius), "a long, b long")
    if sizes.where(F.col("n") > bucket).isEmpty():
        return edges
    if radius != 2:
        raise ValueError("buckets over the bound are split for a radius of 2 only")
    # one fingerprint lies in several large buckets; once is enough
    large = met.where(F.col("n") > bucket).select("fp").distinct()
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")) for k in range(64)])
    rekeyed = large.select("fp", F.explode(near).alias("key")).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    return edges.union(rekeyed.where(F.size("fps") > 1).select("fps").mapInArrow(_link(radius), "a long, b long"))


def classes(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id) of every fingerprint, from rows (doc_id, fp); a class is known by
    its root, one of its fingerprints."""
    distinct = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = connected_components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fps = staged(with_fingerprint(rows, words=words).select("doc_id", "fp"), "simhash")
    return fps.join(classes(fps, radius), "fp", "left") \
        .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` with one of each class: that with the least id (null last, equal ids:
    the one with the least fingerprint; repeated rows: one of them)."""
    fp = fresh("_simhash", docs.columns)
    marked = staged(with_fingerprint(docs, text_col, words, fp), "marked")
    ids = marked.select(F.col(id_col).alias("doc_id"), F.col(fp).alias("fp"))
    member = ids.join(classes(ids, radius), "fp")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("fp").alias("fp"))
    kept = member.groupBy("root").agg(F.min(order).alias("o")).select(F.col("o.id").alias(fp + "_id"), F.col("o.fp").alias(fp + "_fp"))
    same = marked[id_col].eqNullSafe(kept[fp + "_id"]) & (marked[fp] == kept[fp + "_fp"])
    first = Window.partitionBy(id_col, fp).orderBy(fp)
    return marked.join(kept, same, "left_semi").withColumn(fp + "_nth", F.row_number().over(first)) \
        .where(F.col(fp + "_nth") == 1).select(*docs.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
