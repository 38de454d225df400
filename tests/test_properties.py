"""Properties from the test strategy: batch = loop of single searches, incremental replay =
rebuild, adding twice = once, dictionary plan = plain plan, range join = brute force."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mailsift.functions.text import tokenize, tokenize_py
from mailsift.operators import batch as B
from mailsift.operators import criteria as C
from mailsift.operators import maintain as M
from mailsift.operators.delta import LogIndex
from mailsift.operators.ingest import build_postings, build_state, load_index, rebuild_index, term_dictionary
from mailsift.operators.search import search
from mailsift.schema import CHANGES
from mailsift.session import new_scratch_path
from mailsift.sources.adapters import mail_changes, mail_conv, mail_docs
from tests.conftest import MB1, MB3, SF001


def keyset(df, cols=("mailbox_id", "uid")):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_python_and_spark_tokenizers_agree(spark):
    texts = ["Hello World, it's 12:00:00 on e.mail@foo.org and http://x.example.com/a?b=1",
             "Straße naïve café — ünïcödé 東京 l'été", "a@localhost x.y.z 3.14"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(tokenize("t")).collect()]
    assert got == [tokenize_py(t) for t in texts]


def test_add_twice_is_add_once(spark, fixture_messages):
    once = keyset(build_postings(fixture_messages), ("mailbox_id", "field", "term", "uid"))
    twice_df = build_postings(fixture_messages.unionByName(fixture_messages), dedup="global")
    twice = [tuple(r) for r in twice_df.select("mailbox_id", "field", "term", "uid").collect()]
    assert len(twice) == len(set(twice)) and set(twice) == once


def test_batch_equals_single_searches(spark, fixture_index):
    p, s = fixture_index
    rows = [
        (1, MB3, 0, "body", None, "CUSTARD rhubard", None, None),
        (2, MB1, 0, "text", None, "body", None, None),
        (3, MB1, 0, "header", "Subject", "test", None, None),
        (4, MB1, 0, "flag_set", None, "deleted", None, None),
        (5, MB1, 0, "uid", None, None, 1, 2),
        (5, MB1, 1, "body", None, "otherbody", None, None),
        (6, MB1, 0, "exists", "Subject", None, None, None),
        (6, MB1, 1, "size_lt", None, None, 100, None),
        (7, None, 0, "address", "To", "test3", None, None),
    ]
    crit = spark.createDataFrame(rows, "query_id long, mailbox_id string, clause_id long, kind string, "
                                       "name string, value string, lo long, hi long")
    singles = {
        1: (MB3, [C.body_contains("CUSTARD rhubard")]), 2: (MB1, [C.text_contains("body")]),
        3: (MB1, [C.header_contains("Subject", "test")]), 4: (MB1, [C.flag_set("deleted")]),
        5: (MB1, [C.uid_ranges([(1, 2)]), C.body_contains("otherbody")]),
        6: (MB1, [C.header_exists("Subject"), C.size_lt(100)]), 7: (None, [C.address_contains("To", "test3")]),
    }
    for match in ("any", "all"):
        got = keyset(B.search_batch(p, s, crit, match=match), ("query_id", "mailbox_id", "uid"))
        want = set()
        for qid, (mb, crits) in singles.items():
            want |= {(qid, m, u) for m, u in keyset(search(p, s, mb, crits, match=match))}
        assert got == want, match


def test_batch_on_documents_matches_loop(spark):
    ix = load_index(spark, rebuild_index(mail_docs(spark, SF001), new_scratch_path(spark, "ix")))
    words = ["the", "und", "que", "tion", "de", "zzzq"]
    rows = [(i, None, j, "body", None, w, None, None)
            for i, ws in enumerate([words[:2], words[1:4], words[3:]]) for j, w in enumerate(ws)]
    crit = spark.createDataFrame(rows, "query_id long, mailbox_id string, clause_id long, kind string, "
                                       "name string, value string, lo long, hi long")
    got = keyset(B.search_batch(ix.postings, ix.state, crit, "all", ix.dictionary, ix.grams, ix.gram_stats),
                 ("query_id", "mailbox_id", "uid"))
    want = set()
    for i, ws in enumerate([words[:2], words[1:4], words[3:]]):
        res = search(ix.postings, ix.state, None, [C.body_contains(w) for w in ws], match="all")
        want |= {(i, m, u) for m, u in keyset(res)}
    assert got == want


def test_dictionary_plan_equals_plain_plan(spark):
    p = build_postings(mail_docs(spark, SF001, with_flags=False))
    qterms = spark.createDataFrame([("BODY", "TION"), ("BODY", "E"), ("BODY", "QU")], "field string, qterm string")
    tm = B.match_terms(term_dictionary(p), qterms)
    via_dict = {(r.mailbox_id, r.uid, r.qterm) for r in
                p.join(tm, ["field", "term"]).select("mailbox_id", "uid", "qterm").distinct().collect()}
    plain = set()
    for q in ("TION", "E", "QU"):
        plain |= {(m, u, q) for m, u in keyset(p.where(F.col("term").contains(q)))}
    assert via_dict == plain


def test_replay_equals_rebuild(spark):
    """Folding the log in two batches (merge of folds) = folding it at once."""
    ch = mail_changes(spark, SF001)
    whole = M.fold_changes(ch)
    cut = ch.agg(F.percentile_approx("seq", 0.5)).first()[0]
    # second half first: late events must lose against newer ones
    merged = M.merge_folds(M.fold_changes(ch.where(F.col("seq") > cut)), M.fold_changes(ch.where(F.col("seq") <= cut)))
    cols = ["mailbox_id", "uid", "flags"]
    assert sorted(map(tuple, M.live_flags(whole).select(cols).collect())) == \
        sorted(map(tuple, M.live_flags(merged).select(cols).collect()))



@pytest.mark.parametrize("compact_after", [None, 0, 1])
def test_log_index_in_any_order(spark, compact_after):
    """Batches of the log in any order, one of them repeated, with or without a compaction
    between them, give the index of the live messages."""
    ch = mail_changes(spark, SF001)
    ch = ch.withColumn("body", F.when(F.col("op") == "add", F.concat(F.lit("msg n"), F.col("seq").cast("string"))))
    ix = LogIndex(spark, new_scratch_path(spark, "log-index"))
    for n, third in enumerate((2, 0, 1)):
        part = ch.where(F.col("seq") % 9 >= 3 * third).where(F.col("seq") % 9 < 3 * third + 3)
        ix.append(part, n)
        ix.append(part, n)
        if n == compact_after:
            ix.compact()
    whole = M.fold_changes(ch)
    live = whole.where(M.is_live())
    got = ix.index()
    assert keyset(got.state) == keyset(live)
    want = {(r.mailbox_id, r.uid, f"N{r.last_add}") for r in live.collect()}
    body = got.postings.where((F.col("field") == "BODY") & F.col("term").startswith("N"))
    assert sorted((r.mailbox_id, r.uid, r.term) for r in body.collect()) == sorted(want) and want
    flags = {(r.mailbox_id, r.uid): r.flags for r in M.live_flags(whole).collect()}
    assert {(r.mailbox_id, r.uid): r.flags for r in got.state.collect()} == flags
    # dictionary and trigrams are those of an index built anew from the live postings
    anew = term_dictionary(got.postings)
    as_rows = lambda df, *cols: sorted(map(tuple, df.select(*cols).collect()))
    assert as_rows(got.dictionary, "field", "term", "df") == as_rows(anew, "field", "term", "df")
    assert as_rows(got.grams, "field", "term", "gram", "df") == as_rows(B.gram_index(anew), "field", "term", "gram", "df")
    assert as_rows(got.gram_stats, "field", "gram", "n", "docs") == as_rows(B.gram_statistics(B.gram_index(anew)), "field", "gram", "n", "docs")
    bound = ix.index(exact=False)
    above = {(r.field, r.term): r.df for r in bound.dictionary.collect()}
    assert all(above[r.field, r.term] >= r.df for r in anew.collect())
    for some in (got, bound):
        for text in ("msg", "n1", "9"):
            plain = some.search(None, [C.body_contains(text)])
            assert keyset(some.search(None, [C.body_contains(text)], use_dictionary=True)) == keyset(plain)


def test_log_index_with_a_half_written_batch(spark):
    """A batch that is not written whole is not seen; writing it again completes it."""
    ix = LogIndex(spark, new_scratch_path(spark, "log-index"))
    row = lambda seq, uid, body: (seq, None, "add", "m", uid, None, None, body, None)
    first, second = (spark.createDataFrame([row(n, n, f"word{n}")], CHANGES) for n in (1, 2))
    ix.append(first, 0)
    ix.append(second, 1)
    ix._mark("batches", 1, False)
    assert keyset(ix.index().state) == {("m", 1)} and [r.term for r in ix.dictionary().collect()] == ["WORD1"]
    ix.append(second, 1)
    assert keyset(ix.index().state) == {("m", 1), ("m", 2)} and ix.dictionary().count() == 2


def test_range_updates_fold_their_own_mailboxes(spark):
    """Other mailboxes' rows meet the ranges' mailboxes before the fold."""
    ix = LogIndex(spark, new_scratch_path(spark, "log-index"))
    rows = [(k, None, "add", f"m{k % 5}", k, None, None, f"word{k}", None) for k in range(50)]
    ix.append(spark.createDataFrame(rows, CHANGES))
    boxes = spark.createDataFrame([("m1",)], "mailbox_id string")
    plan = ix.state(boxes)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")  # the join is below the fold
    ix.delete(spark.createDataFrame([("m1", 0, 20, 99)], "mailbox_id string, lo long, hi long, seq long"))
    assert keyset(ix.index().state) == {(f"m{k % 5}", k) for k in range(50) if not (k % 5 == 1 and k <= 20)}


def test_log_index_awkward_batches(spark):
    """An empty index, an empty batch, a delete of an unknown key and NULL flags."""
    ix = LogIndex(spark, new_scratch_path(spark, "log-index"))
    assert ix.index().postings.count() == 0 and ix.index().state.count() == 0
    rows = [(1, None, "add", "m", 1, None, None, "alpha", None), (2, None, "add", "m", 2, ["seen"], None, None, 5),
            (3, None, "delete", "m", 9, None, None, None, None)]
    changes = spark.createDataFrame(rows, CHANGES)
    ix.append(changes.limit(0))
    ix.append(changes)
    assert keyset(ix.index().state) == {("m", 1), ("m", 2)}
    ix.update_flags(spark.createDataFrame([("m", 0, None, 4, ["draft"])], "mailbox_id string, lo long, hi long, seq long, flags array<string>"))
    ix.delete(spark.createDataFrame([("m", None, 1, 5), ("none", 0, 9, 6)], "mailbox_id string, lo long, hi long, seq long"))
    got = ix.index()
    assert [(r.uid, r.flags) for r in got.state.collect()] == [(2, ["\\DRAFT"])] and got.postings.count() == 0
    ix.compact()
    ix.append(changes)        # a late copy of the whole log changes nothing
    assert keyset(ix.index().state) == {("m", 2)} and ix.index().postings.count() == 0


def test_range_join_equals_brute_force(spark):
    st = build_state(mail_conv(spark, SF001))
    far = spark.createDataFrame([("1", 4 * 10**12)], "mailbox_id string, uid long")
    st = st.select("mailbox_id", "uid").unionByName(far)
    ranges = spark.createDataFrame([("1", 0, 1), ("1", 0, 2**63 - 1), ("2", 3, 10**12), ("2", 4, 5), ("5", 2, 2),
                                    ("9", 5, 4)], "mailbox_id string, lo long, hi long")
    brute = keyset(st.join(ranges, "mailbox_id").where(F.col("uid").between(F.col("lo"), F.col("hi"))))
    for buckets in (1, 2, 1024):
        assert keyset(M.expand_uid_ranges(st, ranges, buckets)) == brute
    assert ("1", 4 * 10**12) in brute


def test_dates_on_orders_half_open(spark):
    from mailsift.sources.adapters import mail_orders
    st = build_state(mail_orders(spark, "/root/testdata/sf0.01"))
    p = spark.createDataFrame([], "mailbox_id string, field string, term string, uid long")
    closed = search(p, st, None, [C.date_on(dt.datetime(1997, 5, 1), "month")]).count()
    half = search(p, st, None, [C.date_on(dt.datetime(1997, 5, 1), "month", "half_open")]).count()
    assert (closed, half) == (218, 206)


def test_rejected_updates_chunked_equals_single_window(spark):
    ch = mail_changes(spark, "/root/testdata/sf0.01")
    a = sorted(map(tuple, M.rejected_updates(ch, chunk=7).collect()))
    b = sorted(map(tuple, M.rejected_updates(ch, chunk=10**9).collect()))
    assert a == b and a


def test_batch_neutral_queries_select_the_mailbox(spark, fixture_index):
    p, s = fixture_index
    rows = [(1, MB1, 0, "all", None, None, None, None), (2, MB1, 0, "body", None, "...", None, None),
            (3, MB1, 0, "all", None, None, None, None), (3, MB1, 1, "uid", None, None, 2, 2)]
    crit = spark.createDataFrame(rows, "query_id long, mailbox_id string, clause_id long, kind string, "
                                       "name string, value string, lo long, hi long")
    for match in ("any", "all"):
        got = sorted(map(tuple, B.search_batch(p, s, crit, match).collect()))
        assert got == [(1, MB1, 1), (1, MB1, 2), (1, MB1, 3), (2, MB1, 1), (2, MB1, 2), (2, MB1, 3),
                       (3, MB1, 2)], match


def test_search_dictionary_rewrite_equals_plain(spark):
    ix = load_index(spark, rebuild_index(mail_conv(spark, SF001), new_scratch_path(spark, "ix")))
    cases = [
        (None, [C.body_contains("the ou"), C.header_exists("Cc")], "any"),
        ("3", [C.text_contains("assistant")], "any"),
        (None, [C.header_contains("From", "SYS.EM", regex=True)], "any"),
        (None, [C.body_contains("que"), C.not_(C.header_exists("Cc"))], "all"),
        (None, [C.or_(C.and_(C.body_contains("de"), C.address_contains("Cc", "audit")), C.uid_eq(0))], "any"),
    ]
    for mb, crits, match in cases:
        plain = keyset(search(ix.postings, ix.state, mb, crits, match))
        via = keyset(search(ix.postings, ix.state, mb, crits, match, ix.dictionary, ix.grams, ix.gram_stats))
        assert plain == via and plain, (crits, match)
        assert keyset(ix.search(mb, crits, match, use_dictionary=True)) == plain


def test_batch_without_broadcasts_equals_single_searches(spark, fixture_index):
    """With broadcasts off every side takes the shuffle join path."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        test_batch_equals_single_searches(spark, fixture_index)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
