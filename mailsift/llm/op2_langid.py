"""Operator 2: language identification by words first, then shorter and shorter n-grams.

A known word scores its log frequency in each language. An unseen word is looked up as character
5-grams (with ``<`` and ``>`` at its ends); if none of them is known, as 4-grams, and so on down
to single letters. It scores the mean of the known ones, so every word weighs alike. A text's
score is the sum over all its words; ties go to the first language in alphabetical order.

The model is fitted on about ``TRAIN_ROWS`` labelled rows of each language (Bernoulli, seeded),
and keeps ``TOP_WORDS`` words and ``TOP_GRAMS`` n-grams of each order for each language: these
parameters bound what reaches the driver and the tasks. Prediction reads whole texts.

Null text or a text without a letter: ``und``, score 0. Null language: not learned from. No
labelled rows at all: ``und`` everywhere. Null id: in no fold, so learned from, not held out.
Repeated rows: a row each. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailsift.llm.common import fold, parts, staged, strings, table

TRAIN_ROWS = 5000
TOP_WORDS = 30_000
TOP_GRAMS = 8_000
ORDERS = (5, 4, 3, 2, 1)
SMOOTH = 0.1
UNKNOWN = "und"
#: Letters with their marks; numeric signs are none.
_WORD = regex.compile(r"\p{M}*\p{L}[\p{L}\p{M}]*")
_PLAIN = re.compile("[A-Za-z]+")
#: Words after which more of a text makes the score no surer.
_SURE = 20


def words_of(text: str) -> list[str]:
    return (_PLAIN if text.isascii() else _WORD).findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    padded = f"<{word}>" if n > 1 else word
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over rows (lang, text)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def out():
            for lang, c in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()),
                                                  pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])
            found.clear()

        for batch in parts(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), strings(batch, "text")):
                found.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, found.values())) > 300_000:
                yield from out()
        yield from out()

    return docs.select("lang", "text").mapInArrow(count, "lang string, word string, n long") \
        .groupBy("lang", "word").agg(F.sum("n").alias("n"))


def count_grams(words: DataFrame) -> DataFrame:
    """(lang, word, n, size) of the n-grams of counted words."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: Counter = Counter()
            for lang, word, n in frame.itertuples(index=False):
                for size in ORDERS:
                    for g in grams(word, size):
                        found[lang, g, size] += n
            yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["lang", "word", "size", "n"])

    return words.select("lang", "word", "n").mapInPandas(count, "lang string, word string, size int, n long") \
        .groupBy("lang", "word", "size").agg(F.sum("n").alias("n"))


class Table:
    """Log frequency of each entry in each language."""

    def __init__(self, counts: pd.DataFrame, languages: list[str]):
        column = {x: i for i, x in enumerate(languages)}
        entries, row = np.unique(counts["word"].to_numpy(object).astype(str), return_inverse=True) if len(counts) else (np.array([]), [])
        n = np.zeros((len(entries), len(languages)))
        np.add.at(n, (row, [column[x] for x in counts["lang"]]), counts["n"].to_numpy())
        self.row = {str(e): i for i, e in enumerate(entries)}
        self.log = np.log((n + SMOOTH) / (n.sum(0) + SMOOTH * (len(entries) + 1)))


class Scores(dict):
    """Word -> row of ``log``; unseen words are scored by backoff and kept up to ``room`` rows."""

    def __init__(self, words: Table, tables: list[tuple[int, Table]], room: int = 200_000):
        super().__init__(words.row)
        self.known, self.tables = len(words.row), tables
        self.log = np.zeros((self.known + room, words.log.shape[1]))
        self.log[:self.known] = words.log
        self.words = words

    def backoff(self, word: str) -> np.ndarray:
        for size, grams_of in self.tables:
            rows = [r for g in grams(word, size) if (r := grams_of.row.get(g)) is not None]
            if rows:
                return grams_of.log[rows].mean(0)
        return np.zeros(self.log.shape[1])

    def __missing__(self, word: str) -> int:
        row = len(self)
        if row >= len(self.log):
            self.clear()
            self.update(self.words.row)
            raise KeyError(word)  # the text is scored anew
        self.log[row] = self.backoff(word)
        self[word] = row
        return row

    def of(self, words: list[str]) -> np.ndarray:
        total = np.zeros(self.log.shape[1])
        for first in range(0, len(words), 50_000):
            some = words[first:first + 50_000]
            try:
                rows = [self[w] for w in some]
            except KeyError:
                rows = [self[w] for w in some]
            total += self.log[rows].sum(0)
        return total


class Model:
    """A fitted language identifier: bounded tables, sent to the tasks."""

    def __init__(self, words: pd.DataFrame, gram_counts: pd.DataFrame):
        self.languages = sorted(set(words["lang"]))
        self.words = Table(words, self.languages)
        self.grams = [(n, Table(gram_counts[gram_counts["size"] == n], self.languages)) for n in ORDERS]
        self.scores: Scores | None = None

    def __getstate__(self):
        return self.__dict__ | {"scores": None}

    def predict(self, text: str) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.languages:
            return UNKNOWN, 0.0
        if self.scores is None:
            self.scores = Scores(self.words, self.grams)
        total = self.scores.of(words) * min(1.0, _SURE / len(words))
        chance = np.exp(total - total.max())
        best = int(chance.argmax())
        return self.languages[best], float(chance[best] / chance.sum())


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", rows: int = TRAIN_ROWS, seed: int = 7) -> Model:
    """Fit on about ``rows`` rows of each language of ``docs``."""
    known = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null")
    sizes = known.groupBy("lang").count().collect()  # one row for each language
    sample = known.sampleBy("lang", {r["lang"]: min(1.0, rows / r["count"]) for r in sizes}, seed) if sizes else known
    words = staged(count_words(sample), "words")
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top_words = words.withColumn("k", F.row_number().over(best)).where(F.col("k") <= TOP_WORDS).drop("k")
    best = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "word")
    top_grams = count_grams(words).withColumn("k", F.row_number().over(best)).where(F.col("k") <= TOP_GRAMS).drop("k")
    return Model(top_words.toPandas(), top_grams.toPandas())


def predict(docs: DataFrame, model: Model, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    kept = rows.columns[:-1]
    schema = rows.drop("_text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "_text"):
            found = [sent.value.predict(t) for t in strings(batch, "_text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array([x for x, _ in found], pa.string()),
                                              pa.array([s for _, s in found], pa.float64())], [*kept, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    return predict(docs, fit(docs.where(~held_out)), [F.col("doc_id"), held_out.alias("held_out")])
