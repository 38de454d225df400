"""Operator 12: alignment of two tokenizations by divide and conquer at shared cuts.

Tokenizer A (byte-level BPE) encodes " " + text, tokenizer B (sentencepiece, which adds the space itself) encodes
text; both cover the same bytes. Byte offsets where tokens of both end are shared cuts; they part
the tokens into groups. ``shared_cuts`` finds them: it goes to the middle of an interval, looks for a common
end near it by bisecting the other side's ends, and goes on with both halves; an interval without
a common end inside is a leaf group. All open intervals of a chunk take a step at once.

Both tokenizers cut before a single space between two other characters: A's rule for words begins a
piece there, and B has no piece with a space after another character (tested when it is loaded; else whole
texts are encoded). So such places are shared cuts of their own, known before any token is: the intervals to
begin with. A text is split there into units; each distinct unit of a chunk is encoded and aligned
once, and a document is the sequence of its units. White space of any other form stays inside a
unit. Special tokens' strings are plain text. A's ids come from ``tiktoken`` with the ranks of the
JSON file's own merges where these are a plain byte-level BPE, else from ``tokenizers``; tests hold them equal.

An id pair's count is the number of documents that hold it linked. Documents are taken in chunks of
about ``CHUNK`` bytes (a longer text is a chunk of its own); a chunk is one row with the distinct
pairs of its units and the units of each document. Counts are summed over all chunks in a
shuffle of (pair, documents of the chunk); then each chunk asks once for each of its distinct pairs, so a
pair that is in every document is asked for once a chunk, and works out its documents' sums from
the answers. Nothing is sent to all tasks. Only pairs and counts are rows of Spark: the units of the documents,
megabytes a chunk, wait for the answers in a file of the shared folder for each chunk. The links of a large group are
counted as products of its distinct ids, not occurrence by occurrence.

Null and empty texts, and texts whose tokens do not give back their bytes on either side: zeros and ''.
Repeated rows and ids, null ids: a row each, each counted as a document. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import ctypes
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mailsift.llm.common import filesystem, open_buffer, parts, publish, shared_path, staged, strings, table

#: Bytes of text in a chunk.
CHUNK = 2 << 20
#: Units encoded at once.
_UNITS = 1 << 14
#: Links of a group up to which each is listed.
LISTED = 4096
_SPLIT = re.compile(r"(?<=\S) (?=\S)")
_BYTE = re.compile(r"<0x([0-9A-Fa-f]{2})>")
#: Fixed value: the byte-level tokenizer's rule for pieces of text.
_PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Columns of a chunk that are rows of Spark.
_SENT = ["chunk", "pairs", "docs"]
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def shared_cuts(a: np.ndarray, b: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of A's token ends are ends of B too, from ascending ends of both and intervals of places in
    ``a``: [begin, end) holds the ends inside an interval, whose borders are shared already."""
    cut = np.zeros(len(a), bool)
    begin, end = begin[begin < end], end[begin < end]
    mid, step = (begin + end) >> 1, np.zeros(len(begin), np.int64)
    while len(begin):
        # near the middle: at it, one to the right, one to the left, two to the right ...
        at = mid + np.where(step & 1, (step + 1) >> 1, -(step >> 1))
        inside = (at >= begin) & (at < end)
        ends = a[np.where(inside, at, 0)]
        k = np.minimum(np.searchsorted(b, ends), len(b) - 1)
        hit = inside & (b[k] == ends)
        cut[at[hit]] = True
        more = ~hit & ((mid + (step >> 1) + 1 < end) | (mid - (step >> 1) - 1 >= begin))
        low, high = np.concatenate([begin[hit], at[hit] + 1]), np.concatenate([at[hit], end[hit]])
        low, high = low[low < high], high[low < high]
        mid = np.concatenate([mid[more], (low + high) >> 1])
        step = np.concatenate([step[more] + 1, np.zeros(len(low), np.int64)])
        begin, end = np.concatenate([begin[more], low]), np.concatenate([end[more], high])
    return cut


def _byte_letters() -> dict[str, int]:
    """Letter of a byte-level vocabulary -> byte: printable Latin-1 stands for itself, the other bytes
    take the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranked(path: str, token_bytes: dict[int, bytes]) -> tiktoken.Encoding | None:
    """The JSON file's BPE as a ranked vocabulary, if its ids follow its merges and it has no other steps."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type", "BPE") != "BPE" or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space") \
            or spec.get("normalizer") or any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "ignore_merges")):
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get(x + y, -1) for x, y in merges]
    if made != sorted(set(made)) or not made or made[0] < 256:
        return None
    ranks = {token_bytes[i]: i for i in [i for i in model["vocab"].values() if len(token_bytes[i]) == 1] + made}
    if sum(len(x) == 1 for x in ranks) != 256:
        return None
    return tiktoken.Encoding("ranked", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})


class Aligned:
    """Aligned units, numbered: ``ok`` (bytes given back), counts, groups as text, and their links as rows
    (unit, pair ``a << 32 | b``, times) in order of units."""

    def __init__(self, n: int):
        self.ok = np.ones(n, bool)
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(n, np.int64) for _ in range(4))
        self.groups: list[str] = [""] * n
        self.unit = self.pair = self.times = np.empty(0, np.int64)


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        tokenizer = Tokenizer.from_file(a_path)
        tokenizer.encode_special_tokens = True
        letters = _byte_letters()
        self.a_bytes = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
                        for t, i in tokenizer.get_vocab().items()}
        self.ranked = _ranked(a_path, self.a_bytes)
        self.a = None if self.ranked else tokenizer
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode()
                        for i, p in enumerate(names)]
        self.splits = not any("▁" in p.lstrip("▁") for p in names)
        self.a_len = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.a_len[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        most = max(len(self.a_len), len(self.b_len))
        self.written = np.array([[f"{i}{after}" for i in range(most)] for after in (",", "|", ";", "")], object)

    def split(self, text: str) -> list[str]:
        """Units of a text, each without the space before it."""
        return _SPLIT.split(text) if self.splits else [text]

    def _ids(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each unit on both sides."""
        if self.ranked:
            a = [self.ranked.encode_ordinary(" " + u) for u in units]
        else:
            a = [e.ids for e in self.a.encode_batch([" " + u for u in units], add_special_tokens=False)]
        return a, self.b.encode(units, num_threads=1)

    def align(self, units: list[str]) -> Aligned:
        some = [self._align(units[k:k + _UNITS]) for k in range(0, len(units), _UNITS)]
        if len(some) == 1:
            return some[0]
        out = Aligned(0)
        for name in ("ok", "n_a", "n_b", "n_groups", "n_links", "pair", "times"):
            setattr(out, name, np.concatenate([getattr(out, name), *(getattr(x, name) for x in some)]))
        out.unit = np.concatenate([out.unit, *(x.unit + k * _UNITS for k, x in enumerate(some))])
        out.groups = [g for x in some for g in x.groups]
        return out

    def _align(self, units: list[str]) -> Aligned:
        out = Aligned(len(units))
        a, b = self._ids(units)
        bytes_ = [(" " + u).encode() for u in units]
        if b"".join(bytes_) != b"".join([self.b_bytes[i] for x in b for i in x]) or b"".join(bytes_) != b"".join([self.a_bytes[i] for x in a for i in x]):
            for k, want in enumerate(bytes_):
                if b"".join([self.a_bytes[i] for i in a[k]]) != want or b"".join([self.b_bytes[i] for i in b[k]]) != want:
                    out.ok[k], a[k], b[k] = False, [], []
        n_a, n_b = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
        out.n_a, out.n_b = n_a, n_b
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64, n) for x, n in ((a, n_a.sum()), (b, n_b.sum())))
        if not len(ids_a):
            return out
        ends_a, ends_b = np.cumsum(self.a_len[ids_a]), np.cumsum(self.b_len[ids_b])
        upto = np.cumsum(n_a)
        last = upto[out.ok] - 1  # a unit's end is shared
        cut = shared_cuts(ends_a, ends_b, (upto - n_a)[out.ok], last)
        cut[last] = True
        places = np.flatnonzero(cut)
        groups = len(places)
        of_a = np.searchsorted(places, np.arange(len(ids_a)))
        of_b = np.searchsorted(ends_a[places], ends_b)
        in_a, in_b = np.bincount(of_a, minlength=groups), np.bincount(of_b, minlength=groups)
        before_a, before_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        unit = np.searchsorted(upto, places, "right")
        out.n_groups = np.bincount(unit, minlength=len(units))
        np.add.at(out.n_links, unit, in_a * in_b)
        # groups as text: A's tokens of a group, then B's
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        after = np.zeros(len(order), np.int64)
        at_a, at_b = np.arange(len(ids_a)) + before_b[of_a], np.arange(len(ids_b)) + (before_a + in_a)[of_b]
        order[at_a], order[at_b] = ids_a, ids_b
        after[at_a[places]] = 1
        ends = before_a + in_a + before_b + in_b
        after[ends - 1] = 2
        after[ends[np.append(unit[1:] != unit[:-1], True)] - 1] = 3
        written = self.written[after, order].tolist()
        sizes = (n_a + n_b).tolist()
        out.groups = ["".join(written[stop - n:stop]) for n, stop in zip(sizes, accumulate(sizes))]
        # links
        large = in_a * in_b > LISTED
        n = np.where(large[of_a], 0, in_b[of_a])
        first = np.repeat(before_b[of_a] - np.cumsum(n) + n, n) + np.arange(n.sum())
        found = [(np.repeat(unit[of_a], n), np.repeat(ids_a, n) << 32 | ids_b[first], np.ones(len(first), np.int64))]
        for g in np.flatnonzero(large):
            x, x_n = np.unique(ids_a[before_a[g]:before_a[g] + in_a[g]], return_counts=True)
            y, y_n = np.unique(ids_b[before_b[g]:before_b[g] + in_b[g]], return_counts=True)
            found.append((np.full(len(x) * len(y), unit[g]), (x[:, None] << 32 | y).ravel(), (x_n[:, None] * y_n).ravel()))
        out.unit, out.pair, out.times = map(np.concatenate, zip(*found))
        if large.any():
            by = np.argsort(out.unit, kind="stable")
            out.unit, out.pair, out.times = out.unit[by], out.pair[by], out.times[by]
        return out


def aligner(a_path: str, b_path: str) -> Aligner:
    """This process's aligner for two tokenizer files, loaded once."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def _one(values) -> pa.Array:
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _distinct(doc: np.ndarray, item: np.ndarray, items: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, item) and how often each occurs."""
    met, times = np.unique(doc * max(1, items) + item, return_counts=True)
    return met // max(1, items), met % max(1, items), times


def _give_back() -> None:
    """Freed memory back to the system: a worker waits, with what it holds, beside the joins that follow."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _chunks(a_path: str, b_path: str, chunk: int):
    def row(on: Aligner, batch: pa.RecordBatch, serial: int) -> pa.RecordBatch:
        index: dict[str, int] = {}
        texts = [on.split(t) if t else [] for t in strings(batch, "text")]
        known = [[index.setdefault(u, len(index)) for u in units] for units in texts]
        del texts
        sizes = np.array([len(x) for x in known], np.int64)
        flat = np.fromiter(chain.from_iterable(known), np.int64, sizes.sum())
        units = on.align(list(index))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        whole = np.ones(len(sizes), bool)
        whole[doc[~units.ok[flat]]] = False  # a unit that does not give back its bytes: no tokens
        sha = [hashlib.sha256(";".join([units.groups[u] for u in x]).encode()).hexdigest() if x and ok else "" for x, ok in zip(known, whole.tolist())]
        del known
        flat, doc = flat[whole[doc]], doc[whole[doc]]
        doc, unit, times = _distinct(doc, flat, len(index))
        stats = np.zeros((4, len(sizes)), np.int64)
        for values, of_unit in zip(stats, (units.n_a, units.n_b, units.n_groups, units.n_links)):
            np.add.at(values, doc, times * of_unit[unit])
        # pairs of the units, numbered; documents that hold each
        n_links = np.bincount(units.unit, minlength=len(index))
        pairs, pair_at = np.unique(units.pair, return_inverse=True)
        n = n_links[unit]
        place = np.repeat((np.cumsum(n_links) - n_links)[unit] - np.cumsum(n) + n, n) + np.arange(n.sum())
        _, held, _ = _distinct(np.repeat(doc, n), pair_at[place], len(pairs))
        many = np.flatnonzero(units.times > 1)
        return pa.RecordBatch.from_arrays(
            [pa.array([serial]), _one(batch.column("doc_id")), *map(_one, stats), _one(pa.array(sha, pa.string())),
             _one(np.bincount(doc, minlength=len(sizes)).astype(np.int32)), _one(unit.astype(np.int32)), _one(times.astype(np.int32)),
             _one(n_links.astype(np.int32)), _one(pair_at.astype(np.int32)), _one(many.astype(np.int32)), _one(units.times[many]),
             _one(pairs), _one(np.bincount(held, minlength=len(pairs)).astype(np.int32))],
            ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "sha", "doc_units", "unit", "times", "unit_pairs", "pair_at", "many_at", "many", "pairs", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = aligner(a_path, b_path)
        first = (TaskContext.get().taskAttemptId() if TaskContext.get() else 0) << 32  # a task that runs again has chunks of its own
        for serial, batch in enumerate((b for whole in batches for b in parts([whole], "text", chunk)), first):
            yield row(on, batch, serial)
        del batches
        _give_back()
    return run


def _kept(rows, path: str):
    """The chunks of ``rows`` with their pairs and counts alone; the rest of each in a file named by its number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(path)
        fs.create_dir(folder, recursive=True)
        for row in rows(batches):
            rest = row.select([c for c in row.schema.names if c not in _SENT])

            def write(out):
                with pa.ipc.new_file(out, rest.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
                    file.write_batch(rest)

            publish(fs, f"{folder}/{row.column('chunk')[0].as_py()}", write)
            yield row.select(_SENT)
    return run


def _long(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _sums(id_kind: pa.DataType, path: str):
    """Chunks' numbers with the counts of their pairs -> rows of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(path)
        for batch in batches:
            for k, chunk in enumerate(batch.column("chunk").to_pylist()):
                rest = pa.ipc.open_file(open_buffer(fs, f"{folder}/{chunk}")).get_batch(0)
                row = dict(zip(rest.schema.names, rest.columns))
                sizes, unit, times = _long(row["doc_units"]), _long(row["unit"]), _long(row["times"])
                asked, of_unit = batch.column("asked").slice(k, 1).flatten(), _long(row["unit_pairs"])
                at, count, best = (asked.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                order = np.argsort(at)
                pair_at = _long(row["pair_at"])
                links = np.ones(len(pair_at), np.int64)
                links[_long(row["many_at"])] = _long(row["many"])
                of = np.repeat(np.arange(len(of_unit)), of_unit)
                doc = np.repeat(np.arange(len(sizes)), sizes)

                def total(of_pair: np.ndarray) -> np.ndarray:
                    by_unit = np.zeros(len(of_unit), np.int64)
                    np.add.at(by_unit, of, links * of_pair[order][pair_at])
                    out = np.zeros(len(sizes), np.int64)
                    np.add.at(out, doc, times * by_unit[unit])
                    return out

                yield pa.RecordBatch.from_arrays(
                    [row["doc_id"].flatten().cast(id_kind), *(row[c].flatten() for c in ("n_a", "n_b", "n_groups", "n_links")),
                     pa.array(total(best.astype(np.int64))), pa.array(total(count.astype(np.int64))), row["sha"].flatten()],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
    return run


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType
    path = shared_path(docs.sparkSession, "units")
    chunks = staged(rows.mapInArrow(_kept(_chunks(a_path, b_path, chunk), path), "chunk long, pairs array<long>, docs array<int>"), "chunks")
    each = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "x")) \
        .select("chunk", "at", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    counts = pair_counts(each)
    answers = each.select("chunk", "at", "pair").join(counts, "pair") \
        .groupBy("chunk").agg(F.collect_list(F.struct("at", "n", "best")).alias("asked"))
    none = F.array().cast("array<struct<at:int,n:long,best:boolean>>")
    ready = chunks.select("chunk").join(answers, "chunk", "left").withColumn("asked", F.coalesce("asked", none))
    from pyspark.sql.pandas.types import to_arrow_type

    return ready.mapInArrow(_sums(to_arrow_type(kind), path), f"doc_id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                            "count_sum long, groups_sha256 string")


def pair_counts(each: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold each pair, and whether no pair of the same A id has more."""
    counts = staged(each.groupBy("pair").agg(F.sum("docs").alias("n")), "pair-counts")
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
