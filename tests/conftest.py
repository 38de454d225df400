import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mailsift.session import get_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_session(cores=8, shuffle_partitions=8, app="mailsift-tests")
    yield s


# Mailboxes of the reference's test: UUID(0,0), UUID(1,0), UUID(2,0)
MB1 = "00000000-0000-0000-0000-000000000000"
MB2 = "00000000-0000-0001-0000-000000000000"
MB3 = "00000000-0000-0002-0000-000000000000"
NOW = dt.datetime(2024, 6, 15, 10, 0, 0)

BODY3 = ("This is a simple email\r\n It has Rhubard.\r\nIt has CUSTARD.\r\nIt needs naught else.\r\n")


def fixture_rows():
    h_subject = [("Subject", "test (fwd)"), ("From", "test99 <test99@localhost>"),
                 ("To", "test2 <test2@localhost>, test3 <test3@localhost>")]
    h_test = [("Test", "test"), ("From", "test1 <test1@localhost>"),
              ("To", "test3 <test3@localhost>, test4 <test4@localhost>"),
              ("Cc", "test21 <test21@localhost>, test6 <test6@foobar>")]
    h_test_subject = [("Test", "test"), ("Subject", "test2"),
                      ("Date", "Thu, 14 Feb 1990 12:00:00 +0000 (GMT)"),
                      ("From", "test12 <test12@localhost>"),
                      ("Cc", "test211 <test21@localhost>, test6 <test6@foobar>")]
    h_mb3 = [("From", "test <user-from@domain.org>"), ("To", "Harry <harry@example.org>"),
             ("Subject", "A Mixed Multipart Mail"), ("Date", "Thu, 14 Feb 2008 12:00:00 +0000 (GMT)")]
    return [
        (MB2, 1, NOW, 20, ["\\ANSWERED"], h_subject, "My Body"),
        (MB1, 1, NOW, 200, ["\\ANSWERED"], h_subject, "My Body"),
        (MB1, 2, dt.datetime(1980, 3, 10, 10, 0, 0), 20, ["\\DELETED"], h_test, "My Otherbody"),
        (MB1, 3, dt.datetime(8000, 3, 10, 10, 0, 0), 20, ["\\DELETED"], h_test_subject, "My Otherbody2"),
        (MB3, 10, NOW, 8867, [], h_mb3, BODY3),
    ]


@pytest.fixture(scope="session")
def fixture_messages(spark):
    from mailsift.schema import MESSAGES
    rows = [(m, u, d, s, f, [{"name": n, "value": v} for n, v in h], b)
            for m, u, d, s, f, h, b in fixture_rows()]
    return spark.createDataFrame(rows, MESSAGES)


@pytest.fixture(scope="session")
def fixture_index(spark, fixture_messages):
    from mailsift.operators.ingest import build_postings, build_state
    p = build_postings(fixture_messages).cache()
    s = build_state(fixture_messages).cache()
    return p, s
