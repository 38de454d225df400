"""Operator 9: benchmark decontamination by a prefix-filtered join of word windows.

A window is ``WINDOW`` consecutive words of a benchmark item (an item of fewer words is one
window). A document holds a window if its words stand there one after the other. That is
containment of similarity 1, so one prefix token is enough for each window: the word that the
fewest documents hold, counted over all documents.

Neither side is sent whole anywhere. What tasks get are three bit arrays of ``2 ** BITS`` bits, 4 MB each whatever the
benchmark's size: of the windows' words (to count them), of their prefix tokens, and of
(window, place of its token). One pass over the documents finds the prefix tokens; for each place
that a window has its token at, the positional bound (the window begins and ends inside the text) and the
length bound (only lengths that windows with that place have) leave candidate windows, known by a
rolling hash over the words, and the third array drops nearly all that are no windows. The candidates are then
joined with the windows by Spark on the hash and compared word by word, and windows with items by
another join, so a window that many items share is one row until then. A bit set by chance costs a candidate
that the join drops; a benchmark far beyond the arrays' size costs more of them, never a result.

Null text: no words. Items without words: no windows. A null item id: its windows count for hits,
the id is left out of the list. Repeated documents: a row each; repeated items: as one. An empty
table on either side: no rows, or no hits. Columns other than the named ones are kept as they
are by ``mark`` and dropped by the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm.common import parts, staged, table, utf8

WINDOW = 10
#: Size of a bit array, as a power of two.
BITS = 25
#: Word hashes that a process keeps.
_KNOWN = 1 << 19
#: Odd multiplier of the rolling hash, and its inverse modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
#: Lower-cases A-Z and turns what is no word character into a space; bytes from 128 on are kept.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Hashes(dict):
    """Word -> XXH64 with seed 42, as ``xxhash64`` of Spark gives it."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _KNOWN:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word, 42)
        return out


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def rolling(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, back): the hash of the words [i, i + n) is (sums[i + n] - sums[i]) * back[i], modulo 2 ** 64."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _powers(_BASE, len(hashes)), out=sums[1:])
    return sums, _powers(_BACK, len(hashes))


def place_bit(key: np.ndarray, before: np.ndarray | int, bits: int) -> np.ndarray:
    """Bit of a window whose token stands ``before`` words after its start."""
    mixed = (key ^ (np.atleast_1d(before).astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(_BASE)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def word_bit(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes & np.uint64((1 << bits) - 1)).astype(np.int64)


def has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def bit_array(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """The bits of a column of places, put together by Spark in pieces of 4 KB."""
    out = np.zeros(1 << bits - 3, np.uint8)
    pieces = rows.groupBy(F.bitmap_bucket_number(column).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(column)).alias("bits"))
    for r in pieces.collect():  # 2 ** bits bits at most, 4 MB; bucket 0 holds place 0 alone, others end at a multiple of 32,768
        set_ = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")
        at = np.flatnonzero(set_) + (r.piece - 1) * 32768 + 1 if r.piece else np.zeros(1, np.int64)
        np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out


def windows_of(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct (item, window) rows; a window is its words joined by spaces."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            items, found = [], []
            for item, text in zip(batch.column("item").to_pylist(), utf8(batch, "text")):
                words = words_of(text)
                some = {b" ".join(words[i:i + window]) for i in range(max(1, len(words) - window + 1))} if words else ()
                found += [w.decode() for w in some]
                items += [item] * len(some)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(found, pa.string())], ["item", "window"])

    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, "item string, window string").distinct()


def word_counts(docs: DataFrame, text_col: str, wanted, bits: int) -> DataFrame:
    """(word, n): documents that hold each word, by its hash, of the words in the bit array."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, held = Hashes(), np.empty(0, np.uint64), []
        n = np.empty(0, np.int64)
        for batch in parts(batches, "text"):
            for text in utf8(batch, "text"):
                words = set(words_of(text))
                hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                held.append(hashes[has(wanted.value, word_bit(hashes, bits))])
            # one row a word and task
            every = np.concatenate([total, *held])
            total, at = np.unique(every, return_inverse=True)
            n = np.bincount(at, np.concatenate([n, np.ones(len(every) - len(n), np.int64)]), len(total)).astype(np.int64)
            held = []
        yield pa.RecordBatch.from_arrays([pa.array(total.view(np.int64)), pa.array(n)], ["word", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word long, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def with_prefix(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(window, n, before, token): words of each window, and its rarest word with its place."""
    words = windows.select("window", F.posexplode(F.split("window", " ")).alias("at", "w")).withColumn("word", F.xxhash64("w"))
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w", "at")
    return words.join(counts, "word", "left").groupBy("window") \
        .agg(F.count("*").cast("int").alias("n"), F.min(F.struct(rank.alias("rank"), "at", "word")).alias("x")) \
        .select("window", "n", F.col("x.at").alias("before"), F.col("x.word").alias("token"))


def _keyed(bits: int):
    """Windows with their rolling hash and their places in the bit arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            key = np.zeros(batch.num_rows, np.uint64)
            for k, window in enumerate(utf8(batch, "window")):
                words = window.split(b" ")
                sums, _ = rolling(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
                key[k] = sums[-1]
            before, token = batch.column("before").to_numpy(), batch.column("token").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("window", "n", "before")), pa.array(key.view(np.int64)), pa.array(word_bit(token, bits)),
                                              pa.array(place_bit(key, before, bits))], ["window", "n", "before", "key", "token_bit", "place_bit"])
    return run


def _candidates(columns: list[str], text_col: str, tokens, places, shapes: list[tuple[int, int]], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = Hashes(), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        struct = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("window", pa.string())]))
        for batch in parts(batches, text_col):
            n_words, found = [], []
            for text in utf8(batch, text_col):
                words = words_of(text)
                n_words.append(len(words))
                hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                at = np.flatnonzero(has(tokens.value, word_bit(hashes, bits)))
                mine: dict[tuple[int, int], int] = {}
                if len(at):
                    sums, back = rolling(hashes)
                    for before, n in shapes:
                        start = at[(at >= before) & (at - before + n <= len(words))] - before
                        key = (sums[start + n] - sums[start]) * back[start]
                        some = has(places.value, place_bit(key, before, bits))
                        mine.update(zip(zip(start[some].tolist(), [n] * int(some.sum())), key[some].view(np.int64).tolist()))
                found.append([{"start": a, "n": n, "key": key, "window": b" ".join(words[a:a + n]).decode()} for (a, n), key in mine.items()])
            ids = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), ids, pa.array(n_words, pa.int64()), pa.array(found, struct)],
                                             [*columns, "_row", "_words", "_found"])
    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[x for span in merged([(h["start"], h["start"] + h["n"]) for h in hits]) for x in span] for hits in batch.column("hits").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(spans, pa.list_(pa.int64()))], ["_row", "_spans"])


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
         window: int = WINDOW, prefix: str = "hit_", keep: list[str] | None = None,
         bits: int = BITS) -> DataFrame:
    """The columns ``keep`` (default: all) of ``docs`` with ``hit_words`` (words of the text), ``hit_spans`` (from, to, from, to ... in
    words: what lies inside benchmark windows) and ``hit_items`` (ids as text)."""
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    item_windows = staged(windows_of(benchmark, item_col, item_text_col, window), "item-windows")
    windows = item_windows.select("window").distinct()
    words = windows.select(F.explode(F.split("window", " ")).alias("w")).select(F.xxhash64("w").bitwiseAND(F.lit((1 << bits) - 1)).alias("at")).distinct()
    send = spark.sparkContext.broadcast  # arrays of 2 ** bits bits
    wanted = send(bit_array(words, "at", bits))
    counts = staged(word_counts(docs, text_col, wanted, bits), "word-counts")
    wanted.unpersist()
    keyed = staged(with_prefix(windows, counts).mapInArrow(_keyed(bits), "window string, n int, before int, key long, token_bit long, place_bit long"), "windows")
    shapes = [(r.before, r.n) for r in keyed.select("before", "n").distinct().collect()]  # window * (window + 1) / 2 at most

    # the operator's own columns come by place, so those of docs may have any names
    plain = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*plain)
    text, kept = plain[docs.columns.index(text_col)], [plain[docs.columns.index(c)] for c in keep]
    rows = rows.withColumn(text, F.col(text).cast("string")) if dict(rows.dtypes)[text] != "string" else rows
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    schema = f"{fields}, _row long, _words long, _found array<struct<start:int,n:int,key:long,window:string>>"
    tokens, places = send(bit_array(keyed, "token_bit", bits)), send(bit_array(keyed, "place_bit", bits))
    found = staged(rows.select(*dict.fromkeys([*kept, text])).mapInArrow(_candidates(kept, text, tokens, places, shapes, bits), schema), "found")
    tokens.unpersist()
    places.unpersist()
    hits = staged(found.select("_row", F.explode("_found").alias("x")).select("_row", "x.*")
                  .join(keyed.select("key", "window"), ["key", "window"]).select("_row", "start", "n", "window"), "hits")
    spans = hits.groupBy("_row").agg(F.collect_list(F.struct("start", "n")).alias("hits")).mapInArrow(_spans, "_row long, _spans array<long>")
    items = hits.select("_row", "window").distinct().join(item_windows, "window").where("item is not null") \
        .groupBy("_row").agg(F.array_sort(F.collect_set("item")).alias("_items"))
    marks = spans.join(items, "_row", "left")
    return found.drop("_found").join(marks, "_row", "left").select(
        *[F.col(c).alias(name) for c, name in zip(kept, keep)], F.col("_words").alias(f"{prefix}words"),
        F.coalesce("_spans", F.array().cast("array<long>")).alias(f"{prefix}spans"),
        F.coalesce("_items", F.array().cast("array<string>")).alias(f"{prefix}items"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    # ends less starts
    n_hit = F.when(F.size("hit_spans") > 0, F.aggregate(
        "hit_spans", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).cast("long").alias("sign")),
        lambda acc, x: F.struct((acc["sum"] + x * acc["sign"]).alias("sum"), (-acc["sign"]).alias("sign")))["sum"]).otherwise(0)
    return marked.select("doc_id", F.col("hit_words").alias("n_words"), n_hit.cast("long").alias("n_hit"),
                         F.size("hit_items").cast("long").alias("n_items"),
                         F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"),
                         (F.size("hit_spans") > 0).alias("contaminated"))
