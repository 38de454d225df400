"""A training-data pipeline over ``documents``: quality rules, near-duplicates, benchmark
decontamination, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; the result is
written as Parquet and read again before the next one. All stages but the last return the
columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm.common import fresh, staged, table
from mailsift.llm.op1_secrets import redact
from mailsift.llm.op3_packing import cut_pieces, pack
from mailsift.llm.op5_simhash import drop_near_duplicates
from mailsift.llm.op8_quality import filter_quality
from mailsift.llm.op9_decontamination import mark
from mailsift.llm.tokens import default_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that with the least id."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    prefix = fresh("_hit_", docs.columns)
    marked = mark(docs, table(spark, sf_dir, "benchmark"), prefix=prefix)
    return marked.where(F.size(prefix + "spans") == 0).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced; ``n_chars`` follows the text."""
    clean = redact(docs)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        length = F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(kind)
        clean = clean.withColumn("n_chars", length)
    return clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences."""
    return pack(cut_pieces(docs, default_path()))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("packing", packing)]

#: XXH64 fingerprints and a tokenizer's ids: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"stage-{name}")
    return docs
