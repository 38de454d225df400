"""Operator 6: toxicity by a convolutional text classifier trained in numpy.

A word's embedding is the sum of three rows of hashed tables: of the whole word and of its first
``PREFIXES`` bytes, so an unseen ending still finds its stem. Filters of ``WIDTHS`` words slide over the text; each filter's largest value
over the whole text (max pooling) goes to a logistic output. Embeddings start from the log odds
of a bucket's words among toxic and other training texts, then all weights are trained by Adam.

Thresholds are calibrated by language on all labelled, not held-out rows that the weights never saw:
a quarter of them, by hash of the id, and all others beyond the training bounds (with fewer than 5
toxic rows in that quarter, all labelled rows). Their scores are counted in bins of 1 / ``BINS``; the
counts of a label are weighted to its share among all labelled rows of the language, fitted ones too,
so the cut does not depend on the bounds. It is the cut of best F1 for each language that has
``LEAST`` toxic rows there, else the common one. A score is shifted so that its language's threshold
is at 0.3. The language is guessed from the text's own words, at calibration and at scoring; the
column ``lang`` is only read with the training labels. All texts are scored once; the raw scores
(two numbers a row) are written and read again for calibration and result.

The model is fitted on at most ``TRAIN_ROWS`` toxic and as many other rows, of each at most
``TRAIN_WORDS`` words (segments spread over a longer text); both bounds hold for training only.
Scoring reads whole texts.

Null or empty text: no window passes, a low score that the model learns like any other. Null
labels are not learned from; of a repeated label the larger counts. Without toxic rows every
score is 0, without other rows 1. Null id: unlabelled, not held out. Repeated rows: a row each.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm.common import fold, parts, staged, table, utf8
from mailsift.llm.op9_decontamination import words_of

BITS = 16
BUCKETS = 1 << BITS
PREFIXES = (4, 6)
TABLES = 1 + len(PREFIXES)
EMBEDDING_RATE = 0.2
DIM = 6
WIDTHS = (1, 2, 3)
FILTERS = 6
TRAIN_ROWS = 3000
TRAIN_WORDS = 4096
EPOCHS = 4
BATCH = 64
LEAST = 20
ASIDE = 4
BINS = 64
CUT = 0.3


class Hashes(dict):
    """Word -> its buckets in all tables, in one number; kept up to ``room`` words."""

    def __init__(self, room: int = 300_000):
        super().__init__()
        self.room = room

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.room:
            self.clear()
        out = xxhash.xxh32_intdigest(word) % BUCKETS
        for k, n in enumerate(PREFIXES, 1):
            out |= zlib.crc32(word[:n], k) % BUCKETS << k * BITS
        self[word] = out
        return out

    def of(self, text: bytes) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def bucket(words: np.ndarray, k: int) -> np.ndarray:
    """The words' rows in table ``k``."""
    return words >> k * BITS & BUCKETS - 1


class Convolution:
    """Hashed embeddings, filters of several widths, max pooling and a logistic output."""

    def __init__(self, seed: int = 3):
        dice = np.random.default_rng(seed)
        self.tables = [dice.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32) for _ in range(TABLES)]
        self.filters = [dice.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[:, 0, 0] = 1.0  # the first filter of each width starts by adding up log odds
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        out = np.full((len(WIDTHS), FILTERS), 0.05, np.float32)
        out[:, 0] = 1.0
        self.out = out.ravel()
        self.out_bias = np.full(1, -4.0, np.float32)

    def embed(self, words: np.ndarray) -> np.ndarray:
        return sum(t[bucket(words, k)] for k, t in enumerate(self.tables))

    def pooled(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest value of each filter in each text (0 at least), and where it was reached.

        ``words`` has all texts side by side; a window reaching past its text's end is left out
        by reading zero vectors there, and a text without words pools to zero.
        """
        e = self.embed(words)
        n = len(words)
        features = np.zeros((len(sizes), len(WIDTHS), FILTERS), np.float32)
        where = []
        full = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[full]
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # words up to the text's end
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            at = np.zeros((len(sizes), FILTERS), np.int64)
            if n:
                value = e @ f[0]
                for j in range(1, w):
                    inside = left > j
                    value[:n - j][inside[:n - j]] += (e[j:] @ f[j])[inside[:n - j]]
                value += self.bias[k]
                best = np.maximum.reduceat(value, starts, axis=0)
                text = np.repeat(np.arange(len(full)), sizes[full])
                row, col = np.nonzero(value == best[text])
                at[full[text[row[::-1]]], col[::-1]] = row[::-1]  # the first of equals is written last
                features[full, k] = np.maximum(best, 0)
            where.append(at)
        return features, where

    def logits(self, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        features, _ = self.pooled(words, sizes)
        return features.reshape(len(sizes), -1) @ self.out + self.out_bias[0]

    def train(self, texts: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> None:
        dice = np.random.default_rng(seed)
        weight = len(labels) / 2 / np.bincount(labels.astype(int), minlength=2)  # both classes weigh alike
        state: dict[str, list[np.ndarray]] = {}
        step = 0

        def adam(name: str, value: np.ndarray, grad: np.ndarray, rate: float) -> None:
            m, v = state.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

        for _ in range(EPOCHS):
            order = dice.permutation(len(texts))
            for first in range(0, len(order), BATCH):
                some = order[first:first + BATCH]
                step += 1
                words = np.concatenate([texts[i] for i in some])
                sizes = np.array([len(texts[i]) for i in some])
                features, where = self.pooled(words, sizes)
                flat = features.reshape(len(some), -1)
                chance = 1 / (1 + np.exp(-(flat @ self.out + self.out_bias[0])))
                error = ((chance - labels[some]) * weight[labels[some].astype(int)]).astype(np.float32) / len(some)
                back = (error[:, None] * self.out).reshape(features.shape) * (features > 0)
                ends = np.cumsum(sizes)
                gradients = [np.zeros_like(f) for f in self.filters]
                for k, (w, f) in enumerate(zip(WIDTHS, self.filters)):
                    for j in range(w):
                        at = where[k] + j
                        valid = (at < ends[:, None]) & (sizes > 0)[:, None]
                        g = np.where(valid, back[:, k], 0)
                        token = words[np.minimum(at, max(0, len(words) - 1))] if len(words) else at
                        gradients[k][j] = np.einsum("tfd,tf->df", self.embed(token), g)
                        to_words = -EMBEDDING_RATE * np.einsum("tf,df->tfd", g, f[j])  # plain descent: few rows are touched
                        for i, table_of in enumerate(self.tables):
                            np.add.at(table_of, bucket(token, i), to_words)
                out_gradient = error @ flat
                for k, f in enumerate(self.filters):
                    adam(f"f{k}", f, gradients[k], 0.002)
                adam("bias", self.bias, back.sum(0), 0.002)
                adam("out", self.out, out_gradient, 0.01)
                adam("out_bias", self.out_bias, error.sum(keepdims=True), 0.02)


def log_odds(texts: list[np.ndarray], labels: np.ndarray, which, smooth: float = 10.0) -> np.ndarray:
    """Log odds of a bucket among toxic and other texts (half of them, as tables add up); 0 if unseen."""
    held = np.zeros((2, BUCKETS))
    for text, label in zip(texts, labels.astype(int)):
        held[label, np.unique(which(text))] += 1
    n = np.bincount(labels.astype(int), minlength=2)[:, None]
    share = (held / n + smooth / n.sum()) / (1 + smooth / n.sum())
    return np.log(share[1] / share[0]).astype(np.float32) / 2


def best_cut(bins: np.ndarray, toxic: np.ndarray, others: np.ndarray) -> float:
    """The cut of best F1 from (weighted) rows by ascending bin of the logit, in the middle of the gap below it."""
    some = np.flatnonzero(toxic + others > 0)
    bins, toxic, others = bins[some][::-1], toxic[some][::-1], others[some][::-1]
    hits = np.cumsum(toxic)
    f1 = 2 * hits / (hits + np.cumsum(others) + hits[-1])
    k = int(np.argmax(f1))
    low = bins[k + 1] + 1 if k + 1 < len(bins) else bins[k] - BINS
    return float((bins[k] + low) / 2 / BINS)


def cuts_of(counts: list[tuple[int, int, int, int, int]], languages: int) -> np.ndarray:
    """Each language's cut from rows (language, bin, toxic, labelled rows, those not fitted on)."""
    table_of = np.array(counts, np.int64).reshape(-1, 5)
    bins, place = np.unique(table_of[:, 1], return_inverse=True)
    labelled, apart = np.zeros((2, languages, 2, len(bins)))
    np.add.at(labelled, (table_of[:, 0], table_of[:, 2], place), table_of[:, 3])
    np.add.at(apart, (table_of[:, 0], table_of[:, 2], place), table_of[:, 4])
    if not apart.sum((0, 2)).all():
        apart = labelled  # no row of a label is left

    def cut(all_rows: np.ndarray, rows: np.ndarray) -> float:
        return best_cut(bins, *(rows * (all_rows.sum(1) / np.maximum(rows.sum(1), 1))[:, None])[::-1])

    if not labelled.sum((0, 2)).all():
        return np.zeros(languages)
    common = cut(labelled.sum(0), apart.sum(0))
    return np.array([cut(labelled[k], apart[k]) if apart[k, 1].sum() >= LEAST and (apart[k, 0].sum() or not labelled[k, 0].sum()) else common
                     for k in range(languages)])


class Model:
    def __init__(self, texts: list[np.ndarray], labels: np.ndarray, languages: list[str]):
        self.constant = None if len(set(labels.tolist())) == 2 else float(len(labels) > 0 and labels[0])
        if self.constant is not None:
            return
        self.languages = sorted(set(languages))
        place = {x: i for i, x in enumerate(self.languages)}
        counts = np.zeros((BUCKETS, len(self.languages)))
        for text, lang in zip(texts, languages):
            np.add.at(counts[:, place[lang]], bucket(text, 0), 1)
        self.language_log = np.log((counts + 0.1) / (counts.sum(0) + 0.1 * BUCKETS)).astype(np.float32)
        net = self.net = Convolution()
        for k in range(TABLES):
            net.tables[k][:, 0] = log_odds(texts, labels, lambda t, k=k: bucket(t, k))
        net.train(texts, labels.astype(np.float32))

    def logits(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Guessed language and raw score of each text."""
        sizes = np.array([len(t) for t in texts])
        logit = self.net.logits(np.concatenate(texts) if len(texts) else np.zeros(0, np.int64), sizes)
        return np.array([int(self.language_log[bucket(t, 0)].sum(0).argmax()) for t in texts], np.int32), logit.astype(np.float64)


def labelled_rows(labels: DataFrame, usable: Column) -> DataFrame:
    """(doc_id, toxic) of every labelled id once."""
    return labels.where("doc_id is not null and toxic in (0, 1)").where(usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def picked_ids(once: DataFrame, rows: int = TRAIN_ROWS) -> tuple[DataFrame, bool]:
    """(doc_id, toxic) to fit on: at most ``rows`` ids of either label in hash order of the id, without
    the quarter set aside; and whether there is one."""
    aside = F.pmod(F.xxhash64("doc_id"), F.lit(ASIDE)) == 0
    n = {(r["a"], r["toxic"]): r["n"] for r in once.groupBy(aside.alias("a"), "toxic").agg(F.count("*").alias("n")).collect()}
    apart = n.get((True, 1), 0) >= 5 and all(n.get(k) for k in ((True, 0), (False, 0), (False, 1)))
    free = once.where(~aside) if apart else once
    picked = [free.where(F.col("toxic") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for x in (0, 1)]
    return staged(picked[0].union(picked[1]), "fitted"), apart


def training_rows(docs: DataFrame, picked: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(toxic, lang, words) of the picked ids, in hash order of the id."""
    order = F.xxhash64("doc_id")
    few = F.broadcast(picked)  # 2 x rows ids at most: bounded whatever the table
    found = docs.join(few, "doc_id").select("doc_id", "toxic", F.coalesce("lang", F.lit("")).alias("lang"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in parts(batches, "text"):
            out = []
            for text in utf8(batch, "text"):
                words = hashes.of(text)
                if len(words) > TRAIN_WORDS:
                    pieces = np.array_split(words, -(-len(words) // 256))
                    step = len(pieces) * 256 / TRAIN_WORDS
                    words = np.concatenate([pieces[int(i * step)] for i in range(TRAIN_WORDS // 256)])
                out.append(words.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())], ["doc_id", "toxic", "lang", "words"])

    kind = dict(found.dtypes)
    return found.mapInArrow(cut, f"doc_id {kind['doc_id']}, toxic {kind['toxic']}, lang string, words binary") \
        .orderBy(order, "words").limit(2 * rows)  # repeated ids add no more than that


def fit(docs: DataFrame, picked: DataFrame) -> Model:
    rows = training_rows(docs, picked).collect()
    return Model([np.frombuffer(r.words, "<i8") for r in rows], np.array([r.toxic for r in rows]), [r.lang for r in rows])


def raw_scores(docs: DataFrame, model: Model, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with the guessed language's number and the raw score, written once."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    kept = rows.columns[:-1]
    schema = rows.drop("_text").schema.add("_language", "integer").add("_logit", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in parts(batches, "_text", 1 << 20):
            language, logit = sent.value.logits([hashes.of(t) for t in utf8(batch, "_text")])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(language), pa.array(logit)],
                                             [*kept, "_language", "_logit"])

    return staged(rows.mapInArrow(run, schema), "toxicity")


def calibrate(scores: DataFrame, once: DataFrame, picked: DataFrame, apart: bool, languages: int) -> np.ndarray:
    """Each language's cut, from counts of all labelled rows by language, bin and label."""
    bin_of = F.floor(F.least(F.greatest("_logit", F.lit(-50.0)), F.lit(50.0)) * BINS).alias("bin")
    fitted = F.broadcast(picked.select("doc_id", F.lit(0).alias("new")))
    rows = scores.select("doc_id", "_language", bin_of).join(once, "doc_id").join(fitted, "doc_id", "left")
    new = F.coalesce("new", F.lit(1)) if apart else F.lit(1)
    counts = rows.groupBy("_language", "bin", "toxic").agg(F.count("*").alias("n"), F.sum(new).alias("new")).collect()
    return cuts_of([tuple(r) for r in counts], languages)


def predict(docs: DataFrame, labels: DataFrame, usable: Column, keep: list[Column]) -> DataFrame:
    """The columns ``keep``, of which one is ``doc_id``, with score and predicted; learned from the usable labels."""
    once = labelled_rows(labels, usable)
    picked, apart = picked_ids(once)
    model = fit(docs, picked)
    if model.constant is not None:
        rows, score = docs.select(*keep), F.lit(model.constant)
    else:
        rows = raw_scores(docs, model, keep)
        cuts = calibrate(rows, once, picked, apart, len(model.languages))
        shifted = F.col("_logit") - F.get(F.array(*map(F.lit, cuts.tolist())), F.col("_language")) + math.log(CUT / (1 - CUT))
        score = 1 / (1 + F.exp(-F.least(F.greatest(shifted, F.lit(-30.0)), F.lit(30.0))))
    return rows.withColumn("score", score).withColumn("predicted", (F.col("score") >= CUT).cast("int")).drop("_language", "_logit")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    held_out = fold(F.col("doc_id"), 4) == 2
    return predict(docs, table(spark, sf_dir, "labels"), ~held_out, [F.col("doc_id"), held_out.alias("held_out")])
