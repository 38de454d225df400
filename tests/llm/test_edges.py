"""Every query and pipeline stage on awkward and on empty tables."""

from collections import Counter

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from mailsift.llm.queries import QUERIES
from tests.llm.conftest import TEXTS

ONE_ROW_EACH = sorted(set(QUERIES) - {"op3_packing", "op4_html", "op11_codes", "op13_embeddings"})


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_a_row_for_every_document(spark, odd, name):
    ids = pq.read_table(f"{odd}/documents.parquet", columns=["doc_id"])["doc_id"].to_pylist()
    rows = QUERIES[name](spark, odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(ids)
    rest = [c for c in rows[0].asDict() if c not in ("doc_id", "component_id")]
    assert all(r[c] is not None for r in rows for c in rest)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def test_pages(spark, odd):
    rows = QUERIES["op4_html"](spark, odd).collect()
    assert len(rows) == 12
    assert {(r.text, r.n_chars) for r in rows} >= {("", 0), ("Title\nSome & more text", 22)}


def test_pipeline(spark, odd, empty):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, odd)
        assert docs.columns == columns, name
        assert {r[0] for r in docs.select("_q_text", "_s_doc", "_simhash").distinct().select("_q_text").collect()} <= {"clash"}
    assert "password=aabbccddee11" not in "".join(r.text or "" for r in docs.collect())
    assert corpus_pipeline.run(spark, odd).count() > 0
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_stages_take_effect(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = [r.text for r in stages["quality"](spark, docs, odd).collect()]
    assert "word" not in kept and "stutter " * 30 not in kept and "" not in kept and None not in kept
    once = stages["near_duplicates"](spark, docs, odd).collect()
    assert sum(r.text == TEXTS[4] for r in once) == 1 and sum(not (r.text or "").strip() for r in once) == 1
    clean = [r.text for r in stages["decontaminate"](spark, docs, odd).collect()]
    assert TEXTS[4] not in clean and "word" in clean and None in clean
    redacted = {r.doc_id: r.text for r in stages["secrets"](spark, docs, odd).collect()}
    assert redacted[8].count("[REDACTED]") == 6 and "hunter22" not in redacted[8]  # url, pwd, user, password, access, hex
    assert redacted[9] == TEXTS[9] and redacted[0] is None and redacted[15] == TEXTS[15]
