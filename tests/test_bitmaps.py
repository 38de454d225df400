"""Blocks of posting bitmaps: same postings, same uids as the row form, one exchange and no join."""

import random

import pytest
from pyspark.sql import functions as F

from mailsift.operators import bitmaps as M
from mailsift.operators import criteria as C
from mailsift.operators.ingest import build_postings, build_state
from mailsift.operators.search import search, union_uids
from mailsift.schema import POSTINGS
from mailsift.session import new_scratch_path
from mailsift.sources.adapters import mail_docs
from tests.conftest import MB1, MB3, SF001


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def docs_index(spark):
    docs = mail_docs(spark, SF001)
    p, s = build_postings(docs).cache(), build_state(docs).cache()
    return p, s, spark.read.parquet(M.write_blocks(p, new_scratch_path(spark, "blocks")))


def test_blocks_hold_the_postings(spark, docs_index):
    p, _, blocks = docs_index
    key = ["mailbox_id", "field", "term", "uid"]
    back = M.block_postings(blocks)
    assert back.exceptAll(p.select(*back.columns)).isEmpty() and p.select(*back.columns).exceptAll(back).isEmpty()
    assert blocks.groupBy("mailbox_id", "field", "term", "bucket").count().where("count > 1").isEmpty()
    assert sorted(back.columns) == sorted(key)


def test_borders_negative_and_repeated_uids(spark):
    uids = [0, 1, 63, 64, 32767, 32768, -1, -64, -32769, 2**63 - 1, -2**63, 5, 5]
    p = spark.createDataFrame([("m", "BODY", "T", u) for u in uids], POSTINGS)
    blocks = M.build_blocks(p)
    assert rows(M.block_postings(blocks), "uid") == [(u,) for u in sorted(set(uids))]
    assert blocks.agg(F.max(F.size("words"))).first()[0] <= 512
    s = p.select("mailbox_id", "uid").distinct()
    assert rows(M.search_blocks(blocks, s, "m", [C.not_(C.body_contains("x"))], "all"), "uid") == [(u,) for u in sorted(set(uids))]
    nulls = p.select("mailbox_id", "field", "term", F.lit(None).cast("long").alias("uid"))
    assert M.build_blocks(nulls).isEmpty() and M.build_blocks(p.limit(0)).isEmpty()
    assert rows(M.search_blocks(M.build_blocks(p.limit(0)), s.limit(0), "m", [C.body_contains("t")]), "uid") == []


def random_tree(dice, depth=3):
    if depth == 0 or dice.random() < 0.3:
        return dice.choice([C.body_contains(dice.choice(["que", "und", "the", "maison", "zzz", "a"])), C.flag_set("DELETED"), C.flag_unset("FLAGGED"),
                            C.size_gt(dice.choice([300, 2000])), C.size_lt(900), C.all_(), C.uid_ranges([(10, 90)]), C.body_contains("")])
    if dice.random() < 0.25:
        return C.not_(random_tree(dice, depth - 1))
    return dice.choice([C.and_, C.or_])(*[random_tree(dice, depth - 1) for _ in range(dice.randint(1, 3))])


@pytest.mark.parametrize("seed", range(8))
def test_random_trees_equal_the_row_form(docs_index, seed):
    p, s, blocks = docs_index
    dice = random.Random(seed)
    trees, match = [random_tree(dice) for _ in range(2)], dice.choice(["any", "all"])
    mailbox = dice.choice([None, "src1", ["src0", "src2"]])
    want = rows(search(p, s, mailbox, trees, match), "mailbox_id", "uid")
    assert rows(M.search_blocks(blocks, s, mailbox, trees, match), "mailbox_id", "uid") == want
    counts = {m: n for m, n in rows(M.count_matches(blocks, s, mailbox, trees, match), "mailbox_id", "n")}
    assert counts == {m: sum(x[0] == m for x in want) for m in {x[0] for x in want}}


def test_header_criteria_on_the_fixture_mail(fixture_index):
    p, s = fixture_index
    blocks = M.build_blocks(p)
    for mailbox, criteria in [(MB1, [C.header_contains("Subject", "test")]), (MB1, [C.header_exists("Subject"), C.size_lt(100)]),
                              (MB3, [C.text_contains("custard")]), (None, [C.address_contains("To", "test3")]), (MB1, [C.all_()]),
                              (MB1, [C.body_contains("other.*2", regex=True)])]:
        for match in ("any", "all"):
            assert rows(M.search_blocks(blocks, s, mailbox, criteria, match), "mailbox_id", "uid") == rows(search(p, s, mailbox, criteria, match), "mailbox_id", "uid")


def test_union_of_sets(docs_index):
    p, s, _ = docs_index
    parts = [p.where(F.col("term").contains("QUE")), s.where("uid % 3 = 0"), p.where("false")]
    assert rows(M.union_words(*parts), "mailbox_id", "uid") == rows(union_uids(*parts), "mailbox_id", "uid")


def test_a_tree_takes_one_exchange_and_no_join(docs_index):
    _, s, blocks = docs_index
    state = s.sparkSession.read.parquet(_written(s))
    tree = [C.or_(C.and_(C.body_contains("que"), C.not_(C.body_contains("der"))), C.size_lt(300)), C.not_(C.flag_set("DELETED"))]
    plan = M.search_blocks(blocks, state, None, tree, "all")._jdf.queryExecution().sparkPlan().toString()
    prepared = M.search_blocks(blocks, state, None, tree, "all")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and prepared.count("Exchange hashpartitioning") == 1
    one = M.search_blocks(blocks, state, "src1", [C.body_contains("que")])._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(term,QUE)" in one and "EqualTo(mailbox_id,src1)" in one and "SortMergeJoin" not in one


def _written(df):
    path = new_scratch_path(df.sparkSession, "state")
    df.write.parquet(path)
    return path


def test_lists_are_collected_by_term_first(spark):
    p = spark.createDataFrame([(f"m{u % 2}", "BODY", t, u) for u in (1, 70, 40000) for t in ("ONE", "TWO")], POSTINGS)
    blocks = M.build_blocks(p)
    assert blocks.columns == ["mailbox_id", "field", "term", "bucket", "words"]
    aggregates = [x for x in blocks._jdf.queryExecution().sparkPlan().toString().splitlines() if "ObjectHashAggregate" in x]
    # Spark sorts by the first eight bytes of the first key, which fields and mailboxes share
    assert aggregates and all("keys=[term" in x for x in aggregates)
    assert rows(M.block_postings(blocks), "mailbox_id", "term", "uid") == rows(p, "mailbox_id", "term", "uid")
