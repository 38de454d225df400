"""Operator 7: language-model scores from an Elias-Fano n-gram trie.

The trie has two levels, each in several files of the shared folder, memory-mapped by every task:

- words: the sorted 62-bit hashes of all training tokens as an Elias-Fano sequence (a word's
  place is its id) and the running sum of their counts as another, so counts are exact;
- successors: the ids of the words with successors, monotone pointers to each one's range, and
  all ranges in one monotone sequence: a range's ids are counted on from the last value of the
  range before it. A pair is found by a successor search from that base in the range of its
  context. Beside it lie two bytes with the quantised probability.

A pair's probability is p(w | v) = (1 - ALPHA) c(v w) / (c(v) + MU) + b(v) p(w), where p(w) is the
base's smoothed unigram probability and b(v) = (MU + ALPHA c(v)) / (c(v) + MU) is what the first
part leaves over (ALPHA of the mass at least, all of it for an unknown context). The two bytes hold
the first part in steps of 1 / ``STEPS`` of a decade, down to 10^-31.9, below the share of any 64-bit
count, so the error is the same at every size; the rest follows from the first level.

All training texts are counted. Words are counted in each task and summed in a shuffle of
(hash, count). Pairs are sorted and counted in each task in arrays of about ``FLUSH`` pairs, cut
by successor file, and merged one file at a time. A file takes the pairs of many contexts, and
those of a word that occurs ``FREQUENT`` times are dealt over ``SPREAD`` files; a pair that fills
the corpus is one counted pair from the first task on. The number of files grows
with the corpus, their size doesn't. Files are written under a temporary name and moved.

Hashes stand for words: two of V words collide with a probability of about V^2 / 2^63.

Null text: as empty, the end token alone. Null id: in no fold, so learned from. An empty training
set: V and N are 0, every base term is log10(1). Repeated rows: counted and scored row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm.common import LOWER, filesystem, fold, open_buffer, parts, publish, shared_path, staged, table, utf8
from mailsift.llm.elias_fano import EliasFano

MU = 3.0
ALPHA = 0.4
STEPS = 2048
FLUSH = 1_000_000
PAIRS_PER_FILE = 2_000_000
WORDS_PER_FILE = 1_000_000
SPREAD = 8
FREQUENT = 4096
_BITS = 62


class Hashes(dict):
    """Word -> 62-bit hash, kept up to ``room`` words."""

    def __init__(self, room: int = 300_000):
        super().__init__()
        self.room = room

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.room:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word) >> 64 - _BITS
        return out


#: A word never holds a line break, so this is no word's hash but by collision.
END = xxhash.xxh64_intdigest(b"\n") >> 64 - _BITS


def tokens(texts: list[bytes], hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens side by side, each text closed by the end token; tokens of each text."""
    out, sizes = [], []
    for text in texts:
        words = text.translate(LOWER).split()
        out.append(np.fromiter(map(hashes.__getitem__, words), np.int64, len(words)))
        out.append(_END_ARRAY)
        sizes.append(len(words) + 1)
    return np.concatenate(out) if out else np.zeros(0, np.int64), np.array(sizes, np.int64)


_END_ARRAY = np.array([END], np.int64)


def count_words(texts: DataFrame) -> DataFrame:
    """(h, n) of every token of the column ``text``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = Hashes(), [], 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True) if held else (np.zeros(0, np.int64), None)
            total = np.bincount(n, np.concatenate([y for _, y in held]), len(h)).astype(np.int64) if held else h
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(total)], ["h", "n"])

        for batch in parts(batches, "text"):
            h, n = np.unique(tokens(utf8(batch, "text"), hashes)[0], return_counts=True)
            held.append((h, n))
            size += len(h)
            if size > FLUSH:
                yield out()
                held, size = [], 0
        yield out()

    return texts.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def write_words(counts: DataFrame, path: str, files: int) -> list[int]:
    """Write the first level; number of words of each file (hash ranges, so ids are in hash order)."""
    width = -(-(1 << _BITS) // files)

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("h")
        number = int(frame["h"].iloc[0]) // width
        fs, folder = filesystem(path)
        fs.create_dir(folder, recursive=True)
        ends = np.concatenate(([0], np.cumsum(frame["n"].to_numpy())))
        data = EliasFano.of(frame["h"].to_numpy()).to_bytes() + EliasFano.of(ends).to_bytes()
        publish(fs, f"{folder}/words-{number:06d}", lambda out: out.write(data))
        return pd.DataFrame({"file": [number], "n": [len(frame)]})

    done = counts.withColumn("file", F.floor(F.col("h") / F.lit(width)).cast("int")) if files == 1 else \
        counts.withColumn("file", F.expr(f"cast(h div {width} as int)"))
    sizes = {r["file"]: r["n"] for r in done.groupBy("file").applyInPandas(write, "file int, n long").collect()}
    return [sizes.get(k, 0) for k in range(files)]


class Words:
    """The first level, mapped: ids and counts by hash."""

    def __init__(self, path: str, sizes: list[int]):
        fs, folder = filesystem(path)
        self.width = -(-(1 << _BITS) // len(sizes))
        self.first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.files = []
        for k, n in enumerate(sizes):
            if n:
                buffer = open_buffer(fs, f"{folder}/words-{k:06d}")
                hashes, at = EliasFano.from_buffer(buffer)
                self.files.append((hashes, EliasFano.from_buffer(buffer, at)[0]))
            else:
                self.files.append(None)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1: unknown) and count of each hash, in ascending order."""
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        cuts = np.searchsorted(h, np.arange(1, len(self.files)) * self.width) if len(self.files) > 1 else []
        for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(h)])):
            if self.files[k] is None or a == b:
                continue
            hashes, ends = self.files[k]
            at = hashes.next_geq(h[a:b])
            known = np.flatnonzero(at < hashes.n)
            known = known[hashes.access(at[known]) == h[a:b][known].astype(np.uint64)]
            place = at[known]
            ids[a + known] = self.first[k] + place
            counts[a + known] = (ends.access(place + 1) - ends.access(place)).astype(np.int64)
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of ids in ascending order."""
        out = np.zeros(len(ids), np.int64)
        cuts = np.searchsorted(ids, self.first)
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b:
                place, ends = ids[a:b] - self.first[k], self.files[k][1]
                out[a:b] = (ends.access(place + 1) - ends.access(place)).astype(np.int64)
        return out


def file_of(left: np.ndarray, right: np.ndarray, count: np.ndarray, files: int) -> np.ndarray:
    """Successor file of each pair of ids; ``count``: of the left word."""
    mixed = (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return (mixed.astype(np.int64) + np.where(count >= FREQUENT, right % SPREAD, 0)) % files


def pairs(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(word before, word) of every token; the end token stands before a text's first word."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(sizes) - sizes] = end
    return before, ids


def count_pairs(texts: DataFrame, path: str, sizes: list[int], files: int) -> DataFrame:
    """(file, left, right, n): sorted arrays of counted pairs, as bytes, one row for each task and file or more."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hashes = Words(path, sizes), Hashes()
        end = int(words.find(_END_ARRAY)[0][0])
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            left, right = (np.concatenate([p[k] for p in held]) for k in (0, 1))
            held.clear()
            order = np.lexsort((right, left))
            left, right, n = _counted(left[order], right[order], np.ones(len(order), np.int64))
            contexts, of = np.unique(left, return_inverse=True)
            file = file_of(left, right, words.counts(contexts)[of], files)
            order = np.argsort(file, kind="stable")
            cuts = np.searchsorted(file[order], np.arange(files + 1))
            rows = [(k, order[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows], pa.int32()), pa.array([np.diff(left[at], prepend=0).tobytes() for _, at in rows], pa.binary()),
                 pa.array([right[at].tobytes() for _, at in rows], pa.binary()), pa.array([n[at].tobytes() for _, at in rows], pa.binary())],
                ["file", "left", "right", "n"])

        for batch in parts(batches, "text"):
            flat, lengths = tokens(utf8(batch, "text"), hashes)
            known, place = np.unique(flat, return_inverse=True)
            held.append(pairs(words.find(known)[0][place], lengths, end))
            if sum(len(p[0]) for p in held) > FLUSH:
                yield out()
        if held:
            yield out()

    return texts.mapInArrow(count, "file int, left binary, right binary, n binary")


def _counted(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted pairs with the counts of equal ones summed."""
    if not len(left):
        return left, right, n
    first = np.flatnonzero(np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
    return left[first], right[first], np.add.reduceat(n, first)


def successor_file(contexts: np.ndarray, begin: np.ndarray, right: np.ndarray, n: np.ndarray, counts: np.ndarray) -> bytes:
    """A file of the second level: contexts with their counts, where each one's pairs begin, the
    pairs' words and counts."""
    # each range goes on from the last value of the range before
    last = right[np.r_[begin[1:] - 1, len(right) - 1]] + 1
    base = np.cumsum(last) - last
    size = np.diff(np.r_[begin, len(right)])
    share = (1 - ALPHA) * n / (np.repeat(counts, size) + MU)
    codes = np.rint(-np.log10(share) * STEPS).astype(np.uint16)
    return b"".join(EliasFano.of(x).to_bytes() for x in (contexts, np.r_[begin, len(right)], right + np.repeat(base, size))) + codes.tobytes()


def write_successors(counted: DataFrame, path: str, sizes: list[int]) -> DataFrame:
    """Merge the counted pairs of each file and write it; (file, n) of each."""
    def write(frame: pd.DataFrame) -> pd.DataFrame:
        number = int(frame["file"].iloc[0])
        left = np.concatenate([np.cumsum(np.frombuffer(x, np.int64)) for x in frame["left"]])
        right = np.concatenate([np.frombuffer(x, np.int64) for x in frame["right"]])
        n = np.concatenate([np.frombuffer(x, np.int64) for x in frame["n"]])
        order = np.lexsort((right, left))
        left, right, n = _counted(left[order], right[order], n[order])
        contexts, begin = np.unique(left, return_index=True)
        data = successor_file(contexts, begin, right, n, Words(path, sizes).counts(contexts))
        fs, folder = filesystem(path)
        publish(fs, f"{folder}/successors-{number:06d}", lambda out: out.write(data))
        return pd.DataFrame({"file": [number], "n": [len(right)]})

    return staged(counted.groupBy("file").applyInPandas(write, "file int, n long"), "successors")


class Successors:
    """One file of the second level, mapped."""

    def __init__(self, buffer: pa.Buffer):
        self.contexts, at = EliasFano.from_buffer(buffer)
        self.begin, at = EliasFano.from_buffer(buffer, at)
        self.values, at = EliasFano.from_buffer(buffer, at)
        self.codes = np.frombuffer(buffer, np.uint16, self.values.n, at)

    def share(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The first part of each pair's probability, 0 if the pair is unknown; by ascending left."""
        out = np.zeros(len(left))
        first = np.flatnonzero(np.r_[True, left[1:] != left[:-1]])
        asked, pairs_of = left[first], np.diff(np.r_[first, len(left)])
        at = self.contexts.next_geq(asked)
        known = at < self.contexts.n
        known[known] = self.contexts.access(at[known]) == asked[known].astype(np.uint64)
        at = at[known]
        begin, end = (self.begin.access(at + k).astype(np.int64) for k in (0, 1))
        base = np.zeros(len(at), np.int64)
        later = begin > 0
        base[later] = self.values.access(begin[later] - 1).astype(np.int64) + 1
        some = np.flatnonzero(np.repeat(known, pairs_of))
        pairs_of = pairs_of[known]
        wanted = (right[some] + np.repeat(base, pairs_of)).astype(np.uint64)
        place = self.values.next_geq(wanted)
        hit = np.flatnonzero(place < np.repeat(end, pairs_of))
        hit = hit[self.values.access(place[hit]) == wanted[hit]]
        out[some[hit]] = 10.0 ** (-self.codes[place[hit]].astype(float) / STEPS)
        return out


class Model:
    """Where the trie lies and its totals; files are mapped when a task first needs them."""

    def __init__(self, path: str, sizes: list[int], files: int, n: int, v: int):
        self.path, self.sizes, self.files, self.n, self.v = path, sizes, files, n, v
        self.words: Words | None = None
        self.successors: dict[int, Successors | None] = {}

    def _file(self, k: int) -> Successors | None:
        if k not in self.successors:
            fs, folder = filesystem(self.path)
            at = f"{folder}/successors-{k:06d}"
            self.successors[k] = Successors(open_buffer(fs, at)) if fs.get_file_info(at).is_file else None
        return self.successors[k]

    def score(self, texts: list[bytes], hashes: Hashes) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score and score of each text."""
        if self.words is None:
            self.words = Words(self.path, self.sizes)
        flat, lengths = tokens(texts, hashes)
        known, place = np.unique(flat, return_inverse=True)
        ids, counts = self.words.find(known)
        chance = (counts + 0.5) / (self.n + 0.5 * (self.v + 1)) if self.n else np.ones(len(known))
        text = np.repeat(np.arange(len(texts)), lengths)
        total = lambda x: np.bincount(text, x, len(texts))
        end = self.words.find(_END_ARRAY)[0][0]
        left, right = pairs(ids[place], lengths, end)
        # c(v) of each token's context; an unknown context leaves the unigram
        before, _ = pairs(counts[place], lengths, self.words.find(_END_ARRAY)[1][0])
        p = chance[place] * (MU + ALPHA * before) / (before + MU) + self._shares(left, right, before)
        return lengths, total(counts[place] > 0).astype(np.int64), total(np.log10(chance)[place]), total(np.log10(np.minimum(p, 1.0)))

    def _shares(self, left: np.ndarray, right: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The first parts of the pairs, looked up file by file in order."""
        out = np.zeros(len(left))
        ask = np.flatnonzero((left >= 0) & (right >= 0))
        left, right = left[ask], right[ask]
        file = file_of(left, right, count[ask], self.files)
        if self.files * self.v < 1 << 31 and self.v < 1 << 31:
            order = np.argsort((file * self.v + left) << 31 | right)  # one key is sorted faster
        else:
            order = np.lexsort((right, left, file))
        left, right, file = left[order], right[order], file[order]
        new = np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])] if len(left) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        found = np.zeros(len(first))
        cuts = np.searchsorted(file[first], np.arange(self.files + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            if open_file := self._file(int(k)):
                mine = first[cuts[k]:cuts[k + 1]]
                found[cuts[k]:cuts[k + 1]] = open_file.share(left[mine], right[mine])
        out[ask[order]] = found[np.cumsum(new) - 1]
        return out


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Count all texts of ``docs`` and write the trie to the shared folder."""
    path = shared_path(docs.sparkSession, "trie")
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = staged(count_words(texts), "words")
    v, n = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    sizes = write_words(counts, path, max(1, -(-v // WORDS_PER_FILE)))
    files = max(SPREAD, -(-n // PAIRS_PER_FILE))
    if n:
        write_successors(count_pairs(texts, path, sizes, files), path, sizes)
    return Model(path, sizes, files, n, v)


def score(docs: DataFrame, model: Model, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with n_tokens, n_known, base_score and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a path and a few numbers
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    kept = rows.columns[:-1]
    schema = rows.drop("_text").schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in parts(batches, "_text", 6 << 20):
            found = sent.value.score(utf8(batch, "_text"), hashes)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *map(pa.array, found)], [*kept, *schema.names[len(kept):]])

    return rows.mapInArrow(run, schema)


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 5) == 1
    model = fit(docs.where(~held_out))
    scored = score(docs, model, [F.col("doc_id"), held_out.alias("held_out")])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
