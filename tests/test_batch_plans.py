"""What batch searches send and shuffle: no exploded dictionary, no hit for each query that shares a token."""

from pyspark.sql import functions as F

from mailsift.operators import batch as B
from mailsift.plans.registry import QUERIES
from mailsift.session import materialize
from tests.conftest import SF001

CRITERIA = "query_id long, mailbox_id string, clause_id long, kind string, name string, value string, lo long, hi long"


def broadcast_parts(df):
    """Plan lines below each broadcast."""
    lines, out = df._jdf.queryExecution().executedPlan().toString().splitlines(), []
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth = line.index("BroadcastExchange")
            for below in lines[k + 1:]:
                if len(below) - len(below.lstrip(" :+-")) <= depth:
                    break
                out.append(below)
    return out


def test_match_terms_never_sends_the_exploded_dictionary(spark):
    d = materialize(spark.range(500).select(F.lit("BODY").alias("field"), F.concat(F.lit("TERM"), F.col("id").cast("string")).alias("term")), "dict")
    grams = materialize(B.gram_index(d), "grams")
    qterms = spark.createDataFrame([("BODY", "7"), ("BODY", "M4"), ("BODY", ""), ("BODY", "RM12"), ("FROM", "7")], "field string, qterm string")
    tm = B.match_terms(d, qterms.distinct(), grams, B.gram_statistics(grams))
    sent = broadcast_parts(tm)
    assert sent and not any("term#" in line for line in sent if "FileScan" in line and "qterm#" not in line)
    terms = ["TERM" + str(i) for i in range(500)]
    assert {(r.field, r.term, r.qterm) for r in tm.collect()} == {("BODY", t, q) for t in terms for q in ("7", "M4", "", "RM12") if q in t}


def test_any_unites_the_queries_of_a_message_before_it_gives_rows(spark):
    post = spark.createDataFrame([(m, u, "BODY", t) for m, u, t in [
        ("a", 1, "ALPHA"), ("a", 1, "BETA"), ("a", 2, "GAMMA"), ("b", 1, "ALPHABET"), ("b", 3, "X"), ("b", 3, "X"), (None, 4, "ALPHA"), ("b", None, "BETA")]],
        "mailbox_id string, uid long, field string, term string")
    state = post.select("mailbox_id", "uid", F.array().cast("array<string>").alias("flags"), F.lit(1).cast("long").alias("size"),
                        F.lit(None).cast("timestamp_ntz").alias("internal_date")).distinct()
    words = ["alpha beta", "gamma", "x", "alpha", "none"]
    rows = [(q, [None, "a", "b"][q % 3], 0, "body", None, words[q % 5], None, None) for q in range(200)]
    rows += [(7, None, 1, "body", None, "x", None, None)]
    for some in (rows, rows[:200]):
        found = B.search_batch(post, state, spark.createDataFrame(some, CRITERIA))
        assert "bit_or" in found._jdf.queryExecution().optimizedPlan().toString()
        got = [tuple(r) for r in found.collect()]
        held = {(m, u, t) for m, u, _, t in post.collect()}
        want = {(q, m, u) for q, mb, _, _, _, v, _, _ in some for m, u, t in held if mb in (None, m) and any(w in t for w in v.upper().split())}
        assert len(got) == len(set(got)) and set(got) == want


def test_held_tokens_tests_terms_one_by_one(spark):
    post = spark.createDataFrame([("a", 1, "BODY", "AB"), ("a", 1, "BODY", "CD"), ("a", 1, "TO", "E\0F"), ("a", 2, "BODY", "B"), (None, 1, "BODY", "AB")],
                                 "mailbox_id string, uid long, field string, term string")
    asked = [(1, "a", 1, "BODY", "B"), (2, "a", 1, "BODY", "BC"), (3, "a", 1, "BODY", "B\0C"), (4, "a", 1, "TO", "E\0F"), (5, "a", 1, "CC", ""),
             (6, "a", 2, "BODY", ""), (6, "a", 2, "BODY", ""), (7, None, 1, "BODY", "AB"), (8, "a", 2, "BODY", "A")]
    got = B.held_tokens(post, spark.createDataFrame(asked, "query_id long, mailbox_id string, uid long, field string, qterm string"))
    assert {r.query_id for r in got.collect()} == {1, 4, 6}
    assert "array_join" in got._jdf.queryExecution().optimizedPlan().toString()


def test_one_term_search_shuffles_no_postings_it_does_not_ask_for(spark):
    found = QUERIES["B2b_dictionary_search"](spark, SF001)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # fields and terms of the documents, once; the matching terms come from a file
    assert "SortMergeJoin" not in plan and plan.count("Generate explode") == 2


def test_bitmap_query_finds_the_first_uid_of_any_word(spark):
    bits = spark.createDataFrame([(1 << k,) for k in range(63)] + [(-(2**63),), (-1,), (-2,), (-(2**63) + 8,)], "b long")
    low = F.expr("bit_count(~b & coalesce(try_subtract(b, 1L), 9223372036854775807L))")
    old = F.expr("filter(sequence(0, 63), i -> (shiftright(b, i) & 1L) = 1L)[0]")
    assert bits.where(low != old).count() == 0
    plan = QUERIES["W1b_bitmap_blocks"](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" in plan and "filter(" not in plan
