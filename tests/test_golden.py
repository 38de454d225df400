"""The reference's own cases on its five fixture messages (active and ignored tests)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mailsift.operators import criteria as C
from mailsift.operators.search import search, scan_message_postings, lookup_flags
from mailsift.operators.sort import sort_results
from tests.conftest import MB1, MB2, MB3, NOW


def uids(df):
    return sorted(r.uid for r in df.collect())


def run(idx, mailbox, crits, match="any"):
    p, s = idx
    return uids(search(p, s, mailbox, crits, match))


# ---------------------------------------------------------------- active tests

@pytest.mark.parametrize("text,expected", [
    ("CUSTARD", [10]), ("CUSTARDCUSTARD", []), ("Rhubard", [10]),
    ("Harry <harry@example.org>", []), ("Mixed", []),
])
def test_body_contains(fixture_index, text, expected):
    assert run(fixture_index, MB3, [C.body_contains(text)]) == expected


@pytest.mark.parametrize("texts,expected", [
    (["CUSTARD"], [10]), (["Rhubard"], [10]), (["rhubard"], [10]), (["CUSTARDCUSTARD"], []),
    (["Harry <harry@example.org>"], [10]), (["Harry <harry@example.org>", "Mixed"], [10]),
])
def test_text_contains(fixture_index, texts, expected):
    assert run(fixture_index, MB3, [C.text_contains(t) for t in texts]) == expected


@pytest.mark.parametrize("value", ["Harry <harry@example.org>", "Harry", "Harry@example.org"])
def test_address_to(fixture_index, value):
    assert run(fixture_index, MB3, [C.address_contains("To", value)]) == [10]


def test_address_from_substring(fixture_index):
    assert run(fixture_index, MB3, [C.address_contains("From", "ser-from@domain.or")]) == [10]


def test_all(fixture_index):
    assert run(fixture_index, MB2, [C.all_()]) == [1]


def test_flag_set(fixture_index):
    assert run(fixture_index, MB1, [C.flag_set("DELETED")]) == [2, 3]


def test_flag_unset(fixture_index):
    assert run(fixture_index, MB1, [C.flag_unset("DRAFT")]) == [1, 2, 3]


def test_body_and_mail_substring(fixture_index):
    assert run(fixture_index, MB1, [C.body_contains("body")]) == [1, 2, 3]
    assert run(fixture_index, MB1, [C.text_contains("body")]) == [1, 2, 3]


def test_header_contains_and_exists(fixture_index):
    assert run(fixture_index, MB1, [C.header_contains("Subject", "test")]) == [1, 3]
    assert run(fixture_index, MB1, [C.header_exists("Subject")]) == [1, 3]


def test_dates_by_day(fixture_index):
    assert run(fixture_index, MB1, [C.date_before(NOW, "day")]) == [2]
    assert run(fixture_index, MB1, [C.date_after(NOW, "day")]) == [3]
    assert run(fixture_index, MB1, [C.date_on(NOW, "day")]) == [1]


def test_uids(fixture_index):
    assert run(fixture_index, MB1, [C.uid_eq(1)]) == [1]
    assert run(fixture_index, MB1, [C.uid_ranges([(1, 1), (2, 3)])]) == [1, 2, 3]


def test_read_mail_from_store(fixture_index):
    p, s = fixture_index
    rows = scan_message_postings(p, MB3, 10).collect()
    assert rows and all(r.uid == 10 and r.mailbox_id == MB3 for r in rows)
    assert [r.flags for r in lookup_flags(s, MB1, 2).collect()] == [["\\DELETED"]]


# ---------------------------------------------------------------- ignored tests (the contract)

def test_sizes(fixture_index):
    assert run(fixture_index, MB1, [C.size_eq(200)]) == [1]
    assert run(fixture_index, MB1, [C.size_lt(200)]) == [2, 3]
    assert run(fixture_index, MB1, [C.size_gt(6)]) == [1, 2, 3]


def test_not_and_or(fixture_index):
    assert run(fixture_index, MB1, [C.not_(C.uid_eq(2))]) == [1, 3]
    assert run(fixture_index, MB1, [C.and_(C.uid_ranges([(1, 2)]), C.uid_ranges([(2, 3)]))]) == [2]
    assert run(fixture_index, MB1, [C.or_(C.uid_eq(2), C.uid_eq(3))]) == [2, 3]


@pytest.mark.parametrize("key,asc,desc", [
    ("uid", [1, 2, 3], [3, 2, 1]),
    ("sent_date", [2, 3, 1], [1, 3, 2]),
    ("base_subject", [2, 1, 3], [3, 1, 2]),
    ("mailbox_from", [2, 3, 1], [1, 3, 2]),
    ("mailbox_cc", [1, 2, 3], [2, 3, 1]),
    ("mailbox_to", [3, 1, 2], [2, 1, 3]),
    ("display_to", [3, 1, 2], [2, 1, 3]),
    ("display_from", [2, 3, 1], [1, 3, 2]),
    ("arrival", [2, 1, 3], [3, 1, 2]),
    ("size", [2, 3, 1], [1, 2, 3]),
])
def test_sorts(fixture_index, key, asc, desc):
    p, s = fixture_index
    res = search(p, s, MB1, [C.all_()])
    assert [r.uid for r in sort_results(res, s, key).collect()] == asc
    assert [r.uid for r in sort_results(res, s, key, reverse=True).collect()] == desc


# ---------------------------------------------------------------- semantics ledger

def test_q2_all_adds_nothing(fixture_index):
    assert run(fixture_index, MB1, [C.all_(), C.uid_eq(2)]) == [2]


def test_q3_empty_text_is_whole_mailbox(fixture_index):
    assert run(fixture_index, MB1, [C.body_contains("...")]) == [1, 2, 3]


def test_q1_any_vs_all(fixture_index):
    crits = [C.body_contains("otherbody"), C.header_exists("Subject")]
    assert run(fixture_index, MB1, crits, "any") == [1, 2, 3]
    assert run(fixture_index, MB1, crits, "all") == [3]


def test_q5_seen_is_not_flagged(spark):
    from mailsift.operators.ingest import build_state
    from mailsift.schema import MESSAGES
    rows = [("m", 1, NOW, 1, ["\\FLAGGED"], [], "x"), ("m", 2, NOW, 1, ["\\Seen", "urgent"], [], "y")]
    st = build_state(spark.createDataFrame(rows, MESSAGES))
    got = sorted(r.uid for r in st.where(C.flag_set("SEEN").predicate()).collect())
    assert got == [2]
    assert sorted(r.uid for r in st.where(C.custom_flag("URGENT").predicate()).collect()) == [2]
    assert sorted(r.uid for r in st.where(C.custom_flag("urgent", False).predicate()).collect()) == [1]


def test_q6_half_open_and_q7_pre_1970(spark):
    from mailsift.schema import MESSAGES
    from mailsift.operators.ingest import build_state
    rows = [("m", 1, dt.datetime(1960, 1, 1), 1, [], [], ""), ("m", 2, dt.datetime(1997, 6, 1), 1, [], [], ""),
            ("m", 3, dt.datetime(1997, 5, 20), 1, [], [], "")]
    st = build_state(spark.createDataFrame(rows, MESSAGES))
    on = lambda b: sorted(r.uid for r in st.where(C.date_on(dt.datetime(1997, 5, 3), "month", b).predicate()).collect())
    assert on("closed") == [2, 3]
    assert on("half_open") == [3]
    assert sorted(r.uid for r in st.where(C.date_before(dt.datetime(1970, 1, 1), "day").predicate()).collect()) == [1]


def test_q9_literal_and_regex(fixture_index):
    assert run(fixture_index, MB3, [C.header_contains("From", "SER.FROM")]) == []
    assert run(fixture_index, MB3, [C.header_contains("From", "SER.FROM", regex=True)]) == [10]


def test_uid_star_is_neutral(fixture_index):
    star = C.UID_STAR
    assert run(fixture_index, MB1, [C.uid_ranges([(1, 1), (star, star)])]) == [1, 2, 3]


def test_unsupported(fixture_index):
    with pytest.raises(ValueError):
        run(fixture_index, MB1, ["not a criterion"])


def test_q4_flag_unset_excludes_set_flags(fixture_index):
    assert run(fixture_index, MB1, [C.flag_unset("DELETED")]) == [1]


def test_q8_month_steps_are_utc():
    from mailsift.functions.dates import upper_bound_py, truncate_py
    t = dt.datetime(2024, 12, 31, 23, 30)
    assert truncate_py(t, "month") == dt.datetime(2024, 12, 1)
    assert upper_bound_py(t, "month") == dt.datetime(2025, 1, 1)
    assert upper_bound_py(t, "year") == dt.datetime(2025, 1, 1)
    assert upper_bound_py(t, "millisecond") == t


def test_q10_mailbox_by_equality(spark):
    from mailsift.operators.ingest import build_postings, build_state
    from mailsift.schema import MESSAGES
    rows = [("a.b(c", 1, NOW, 1, [], [], "word"), ("aXb(c", 2, NOW, 1, [], [], "word")]
    m = spark.createDataFrame(rows, MESSAGES)
    assert uids(search(build_postings(m), build_state(m), "a.b(c", [C.body_contains("word")])) == [1]


def test_q16_delete_is_final_until_a_later_add(spark):
    from mailsift.operators import maintain as M
    rows = [(1, "add", "m", 1, []), (2, "flags", "m", 1, ["\\SEEN"]), (3, "delete", "m", 1, []),
            (4, "flags", "m", 1, ["\\FLAGGED"]), (5, "add", "m", 2, []), (6, "delete", "m", 2, []),
            (7, "add", "m", 2, []), (8, "flags", "m", 2, ["\\SEEN"])]
    ch = spark.createDataFrame(rows, "seq long, op string, mailbox_id string, uid long, flags array<string>")
    live = M.live_flags(M.fold_changes(ch)).collect()
    assert [(r.uid, r.flags) for r in live] == [(2, ["\\SEEN"])]
    assert sorted(map(tuple, M.rejected_updates(ch).collect())) == [("m", 1, 4)]


def test_q18_one_state_row_per_message(spark):
    from mailsift.operators.ingest import build_state
    from mailsift.sources.mime import parse_mime
    raw = (b"From: a <a@x.org>\r\nSubject: outer\r\nContent-Type: multipart/mixed; boundary=B\r\n\r\n"
           b"--B\r\nContent-Type: message/rfc822\r\n\r\nFrom: b <b@y.org>\r\nSubject: inner\r\n\r\nhello\r\n--B--\r\n")
    df = spark.createDataFrame([("m", 1, bytearray(raw))], "mailbox_id string, uid long, raw binary")
    parsed = parse_mime(df).withColumn("internal_date", F.lit(None).cast("timestamp_ntz")) \
        .withColumn("size", F.lit(1).cast("bigint")).withColumn("flags", F.array().cast("array<string>"))
    st = build_state(parsed).collect()
    assert len(st) == 1 and st[0].first_from == "a" and st[0].base_subject == "OUTER"


def test_q9_regex_keeps_escapes(fixture_index):
    # \w and \d must keep their meaning (an upper-cased pattern would read \W and \D)
    assert run(fixture_index, MB3, [C.header_contains("From", r"ser-\w+@domain", regex=True)]) == [10]
    assert run(fixture_index, MB1, [C.body_contains(r"otherbody\d", regex=True)]) == [3]


def test_q12_exact_header_name(spark, fixture_messages, fixture_index):
    from mailsift.operators.search import header_contains_exact
    # routed (reference) form: an unknown name searches every header value; TEST1 is inside
    # TEST1 (uid 2's From) and inside TEST12 / TEST211 (uid 3's From and Cc)
    assert run(fixture_index, MB1, [C.header_contains("X-Anything", "test1")]) == [2, 3]
    # exact form: only headers called "Test" (uids 2 and 3 have one, with value "test")
    assert uids(header_contains_exact(fixture_messages, MB1, "test", "tes")) == [2, 3]
    assert uids(header_contains_exact(fixture_messages, MB1, "test", "test1")) == []
