"""Batches of boolean trees, `*` clauses and range clauses = loops of single searches."""

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from mailsift.operators import batch as B
from mailsift.operators import criteria as C
from mailsift.operators import intervals as I
from mailsift.operators import trees as T
from mailsift.operators.ingest import load_index, rebuild_index
from mailsift.operators.search import search
from mailsift.session import new_scratch_path
from mailsift.sources.adapters import mail_conv, mail_docs, mail_orders
from mailsift.operators.ingest import build_state
from tests.conftest import SF001

STAR = 2**63 - 1


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def us(ts):
    return int(ts.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)


def criterion(node):
    """The same tree for a single search."""
    if isinstance(node, list):
        return C.uid_ranges([(r["lo"], r["hi"]) for r in node])
    if isinstance(node, dict):
        k, value, lo, hi = node["kind"], node.get("value"), node.get("lo"), node.get("hi")
        simple = {"body": C.body_contains, "text": C.text_contains, "flag_set": C.flag_set, "flag_unset": C.flag_unset}
        if k in simple:
            return simple[k](value)
        if k in ("header", "address"):
            return (C.header_contains if k == "header" else C.address_contains)(node["name"], value)
        if k == "exists":
            return C.header_exists(node["name"])
        if k == "uid":
            return C.uid_ranges([(lo, hi)])
        if k == "date_between":
            as_ts = lambda x: F.timestamp_micros(F.lit(x)).cast("timestamp_ntz")
            return C.StateCriterion(lambda: F.col("internal_date").between(as_ts(lo), as_ts(hi)), f"date {lo} {hi}")
        return {"size_eq": C.size_eq, "size_lt": C.size_lt, "size_gt": C.size_gt}[k](lo) if k != "all" else C.all_()
    op, *kids = node
    return C.not_(criterion(kids[0])) if op == "not" else (C.and_ if op == "and" else C.or_)(*map(criterion, kids))


LEAVES = [{"kind": "body", "value": "the"}, {"kind": "body", "value": "re a"}, {"kind": "text", "value": "user"}, {"kind": "body", "value": "..."}, {"kind": "header", "name": "Subject", "value": "conv"},
          {"kind": "exists", "name": "Cc"}, {"kind": "address", "name": "From", "value": "assistant@example.org"}, {"kind": "flag_set", "value": "SEEN"}, {"kind": "flag_unset", "value": "\\FLAGGED"},
          {"kind": "uid", "lo": 1, "hi": 2}, {"kind": "uid", "lo": STAR, "hi": STAR}, [{"kind": "uid", "lo": 0, "hi": 0}, {"kind": "uid", "lo": 3, "hi": 9}],
          [{"kind": "uid", "lo": 0, "hi": 0}, {"kind": "uid", "lo": STAR, "hi": STAR}], {"kind": "size_lt", "lo": 200}, {"kind": "size_gt", "lo": 300}, {"kind": "size_eq", "lo": 120}, {"kind": "all"},
          {"kind": "date_between", "lo": 0, "hi": us(dt.datetime(2024, 6, 1))}]


def random_tree(dice, depth):
    if depth == 0 or dice.random() < 0.25:
        return dice.choice(LEAVES)
    op = dice.choice(["and", "or", "not"])
    return (op, *[random_tree(dice, depth - 1) for _ in range(1 if op == "not" else dice.randint(2, 4))])


@pytest.fixture(scope="module")
def conv(spark):
    return load_index(spark, rebuild_index(mail_conv(spark, SF001), new_scratch_path(spark, "ix")))


def loop(ix, queries):
    out = set()
    for q, mailbox, tree in queries:
        out |= {(q, r.mailbox_id, r.uid) for r in search(ix.postings, ix.state, mailbox, [criterion(tree)], match="all").collect()}
    return out


def test_trees_equal_single_searches(spark, conv):
    dice = random.Random(5)
    ix = conv
    queries = [(k, dice.choice([None, "3", "7", "none"]), random_tree(dice, k % 4)) for k in range(36)]
    queries += [(100 + k, "3", leaf) for k, leaf in enumerate(LEAVES)] + [(200 + k, "5", ("not", leaf)) for k, leaf in enumerate(LEAVES)]
    crit, programs = T.compile_batch(spark, queries)
    rows = T.search_trees(ix.postings, ix.state, crit, programs, ix.dictionary, ix.grams, ix.gram_stats).collect()
    assert len(rows) == len(set(rows))
    assert {tuple(r) for r in rows} == loop(ix, queries)


def test_more_clauses_than_a_word(spark, conv):
    tree = ("or", *[("and", {"kind": "uid", "lo": k, "hi": k}, ("not", {"kind": "size_eq", "lo": k})) for k in range(70)])
    crit, programs = T.compile_batch(spark, [(1, "3", tree), (2, None, ("not", tree))])
    got = T.search_trees(conv.postings, conv.state, crit, programs, conv.dictionary, conv.grams, conv.gram_stats)
    assert {tuple(r) for r in got.collect()} == loop(conv, [(1, "3", tree), (2, None, ("not", tree))])


def test_programs_need_little_stack():
    deep = {"kind": "all"}
    for k in range(200):
        deep = ("and" if k % 2 else "or", {"kind": "uid", "lo": k, "hi": k}, deep)
    _, program = T.compile_tree(deep)
    assert len(program) == 401
    with pytest.raises(ValueError):
        T.compile_tree(("xor", {"kind": "all"}))


@pytest.mark.parametrize("match", ["any", "all"])
def test_star_clauses_in_flat_batches(spark, conv, match):
    star, body = {"kind": "uid", "lo": STAR, "hi": STAR}, {"kind": "body", "value": "the"}
    cases = [[star], [body, star], [star, {"kind": "uid", "lo": 1, "hi": 1}], [[{"kind": "uid", "lo": 0, "hi": 0}, star], body], [{"kind": "all"}, body]]
    rows, want = [], set()
    for q, clauses in enumerate(cases):
        for k, clause in enumerate(clauses):
            rows += [(q, "3", k, r["kind"], None, r.get("value"), r.get("lo"), r.get("hi")) for r in (clause if isinstance(clause, list) else [clause])]
        want |= {(q, r.mailbox_id, r.uid) for r in search(conv.postings, conv.state, "3", [criterion(c) for c in clauses], match=match).collect()}
    got = B.search_batch(conv.postings, conv.state, spark.createDataFrame(rows, T.CRITERIA), match, conv.dictionary, conv.grams, conv.gram_stats)
    assert {tuple(r) for r in got.collect()} == want


def test_range_clauses_meet_messages_without_a_nested_loop(spark):
    st = build_state(mail_orders(spark, SF001)).select("mailbox_id", "uid", "flags", "size", "internal_date").cache()
    dice = random.Random(2)
    days = us(dt.datetime(1992, 1, 1))
    rows = []
    for q in range(10_000):
        a, b = sorted(dice.randint(-10, 7000) for _ in range(2))
        kind = dice.choice(I.RANGE_KINDS)
        lo, hi = (a, a + dice.choice([0, 3, b])) if kind != "date_between" else (days + a * 40_000_000_000, days + b * 40_000_000_000)
        rows.append((q, dice.choice([None, None, "13", "370"]), 0, kind, None, None, lo, hi))
    crit = spark.createDataFrame(rows, T.CRITERIA)
    got = I.range_hits(st, crit)
    assert "NestedLoop" not in plan_text(got) and "Cartesian" not in plan_text(got)
    sums = {r.query_id: (r.n, r.s) for r in got.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("uid").alias("s")).collect()}
    messages = [(r.mailbox_id, r.uid, r.size, us(r.internal_date)) for r in st.collect()]
    test = {"uid": lambda m, lo, hi: lo <= m[1] <= hi, "size_eq": lambda m, lo, hi: m[2] == lo, "size_lt": lambda m, lo, hi: m[2] is not None and m[2] < lo,
            "size_gt": lambda m, lo, hi: m[2] is not None and m[2] > lo, "date_between": lambda m, lo, hi: lo <= m[3] <= hi}
    for q, mailbox, _, kind, _, _, lo, hi in rows[:600]:
        hit = [m[1] for m in messages if (mailbox is None or m[0] == mailbox) and test[kind](m, lo, hi)]
        assert sums.get(q, (0, None)) == (len(hit), sum(hit) if hit else None), (q, kind, lo, hi)


def test_buckets_of_many_messages_and_clauses(spark, monkeypatch):
    """Buckets by the number of messages, found without a condition for each: the join's method stays short enough to be compiled."""
    rows = [(str(u % 3), u, [], None if u % 5 == 0 else u % 40, dt.datetime(2020, 1, 1) + dt.timedelta(days=u * u % 97)) for u in range(3000)]
    rows += rows[:10] + [("1", 7, [], 5, None)] * 2
    st = spark.createDataFrame(rows, "mailbox_id string, uid long, flags array<string>, size long, internal_date timestamp_ntz").cache()
    first = us(dt.datetime(2020, 1, 1))
    clauses = [(q, None if q % 2 else str(q % 5), 0, I.RANGE_KINDS[q % len(I.RANGE_KINDS)], None, None, q * 3, q * 3 + q % 70) for q in range(40)]
    clauses += [(q, None if q % 2 else "1", 0, "date_between", None, None, first + q * 86_400_000_000, first + (q + 3) * 86_400_000_000) for q in range(-2, 40)]
    clauses += [(90, None, 0, "uid", None, None, -(2**63), 2**63 - 1), (91, None, 0, "uid", None, None, 9, 8), (None, None, 0, "uid", None, None, 2, 2)]
    crit = spark.createDataFrame(clauses, T.CRITERIA)
    inside = {"uid": lambda m, lo, hi: lo <= m[1] <= hi, "size_eq": lambda m, lo, hi: m[3] == lo, "size_lt": lambda m, lo, hi: m[3] is not None and m[3] < lo,
              "size_gt": lambda m, lo, hi: m[3] is not None and m[3] > lo, "date_between": lambda m, lo, hi: m[4] is not None and lo <= us(m[4]) <= hi}
    want = sorted((repr(c[0]), m[0], m[1]) for c in clauses for m in rows if c[1] in (None, m[0]) and inside[c[3]](m, c[6], c[7]))
    for sent, per_bucket in ((100_000, 1024), (0, 1)):
        monkeypatch.setattr(I, "SENT", sent)
        monkeypatch.setattr(I, "ROWS", per_bucket)
        got = I.range_hits(st, crit)
        assert plan_text(got).count("CASE WHEN") < 100 and "NestedLoop" not in plan_text(got)
        assert sorted((repr(r.query_id), r.mailbox_id, r.uid) for r in got.select("query_id", "mailbox_id", "uid").collect()) == want
    none = I.range_hits(st, crit.where("false"))
    assert none.columns == ["query_id", "clause_id", "mailbox_id", "uid"] and none.count() == 0
    assert I.range_hits(st.where("false"), crit).count() == 0
