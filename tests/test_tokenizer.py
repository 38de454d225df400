"""The query-side tokenizer (Python) and the index-side tokenizer (Spark) must agree."""

from hypothesis import given, settings
from hypothesis import strategies as st

from mailsift.functions.headers import base_subject, group_members, header_date, parse_addresses
from mailsift.functions.text import tokenize, tokenize_py

ALPHABET = ("abcxyzABCXYZ0189 _.-'’:·@/%+<>\",;()\t\r\néèçàüößñÆœﬁİıǅΐ東京λΣς"
            "hHtTpPsS漢字かカテー\u3099한")

texts = st.text(alphabet=ALPHABET, max_size=60)


@settings(max_examples=5, deadline=None)
@given(st.lists(texts, min_size=200, max_size=200))
def test_python_and_spark_tokenizers_agree_on_generated_text(spark, batch):
    batch += ["http://a.example.com/x?y=1 mail@host.org", "HTTPS://X.ORG/A", "x@localhost", "a.b.c:d"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "i int, t string")
    got = {r.i: r.toks for r in df.select("i", tokenize("t").alias("toks")).collect()}
    for i, t in enumerate(batch):
        want = tokenize_py(t)
        assert got[i] == want, repr(t)


def test_long_chains_do_not_overflow(spark):
    """A chain of 100,000 parts, a long display name and a long subject stay one value each."""
    df = spark.createDataFrame([("a." * 100_000 + "b", '"' + "x" * 100_000 + '" <a@b.org>, ' + "y" * 100_000 + " <c@d.org>",
                                 "re: " * 25_000 + "[fwd: " * 100 + "hello" + "]" * 100)], "t string, a string, s string")
    r = df.select(tokenize("t").alias("t"), parse_addresses("a").alias("a"), base_subject("s").alias("s")).first()
    assert [len(x) for x in r.t] == [200_001]
    assert [x.address for x in r.a] == ["a@b.org", "c@d.org"] and len(r.a[1].display) == 100_000
    assert r.s == "HELLO"


def test_base_subject(spark):
    cases = {"Hello": "HELLO", "Re: [Fwd: hello]": "HELLO", "[Fwd: hello]": "HELLO", "[fwd: [fwd: [fwd: x]]]": "X", "[list]": "[LIST]",
             "[list] Re: a  b (fwd)": "A B", "fw: re[2]: x [y]": "X [Y]", "Fwd: [a] [b]": "[B]", "": "", "RE:": "", "re: [fwd: a (fwd)]": "A"}
    df = spark.createDataFrame(list(cases.items()), "s string, want string")
    assert [(r.s, r.got) for r in df.select("s", base_subject("s").alias("got")).collect()] == list(cases.items())


def test_header_date(spark):
    cases = {"Thu, 14 Feb 2008 12:00:00 +0000": "2008-02-14 12:00:00", "14 Feb 2008 12:00 +0530": "2008-02-14 06:30:00",
             "14 Feb 08 12:00:00 GMT": "2008-02-14 12:00:00", "Thu, 14 Feb 99 23:30:05 EST (comment)": "1999-02-15 04:30:05",
             "1 JAN 2020 0:05 -0100": "2020-01-01 01:05:00", "14 Feb 2008 12:00": "2008-02-14 12:00:00", "31 Feb 2008 12:00:00 +0000": None,
             "nonsense": None, "": None}
    df = spark.createDataFrame(list(cases.items()), "v string, want string") \
        .selectExpr("v", "array(named_struct('name', 'Date', 'value', v)) AS h")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            got = {r.v: r.d for r in df.select("v", header_date("h").cast("string").alias("d")).collect()}
            assert got == cases, tz
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_group_members_with_quoted_commas(spark):
    df = spark.createDataFrame([('team: "Doe, John" <j@x.org>, b@y.org; other: c@z.org;',)], "v string")
    assert df.select(group_members("v")).first()[0] == ["DOE, JOHN <J@X.ORG>", "B@Y.ORG", "C@Z.ORG"]


def test_comments_in_address_lists(spark):
    cases = {
        "a@x.org (Comment, with comma)": [("", "a@x.org")],
        "a@x.org (one (two, three) four), b@y.org": [("", "a@x.org"), ("", "b@y.org")],
        '"Doe, (John)" <j@x.org> (x, y)': [("Doe, (John)", "j@x.org")],
        "Foo (bar: a; b) <a@b.org>, c@d.org": [("Foo", "a@b.org"), ("", "c@d.org")],
        'a@x.org (it is "quoted) , b@y.org': [("", "a@x.org"), ("", "b@y.org")],
        "a@x.org (escaped \\) still, in), b@y.org": [("", "a@x.org"), ("", "b@y.org")],
        "team: a@x.org (p, q), B <b@y.org>; c@z.org": [("", "a@x.org"), ("B", "b@y.org"), ("", "c@z.org")],
        "<a(b)@x.org>": [("", "a(b)@x.org")], "": [], "(only a comment)": [],
    }
    df = spark.createDataFrame([(v,) for v in cases], "v string")
    got = {r.v: [(a.display, a.address) for a in r.a] for r in df.select("v", parse_addresses("v").alias("a")).collect()}
    assert got == cases
    df = spark.createDataFrame([("team: a@x.org (p, q; r), B <b@y.org>;",), ("x" * 50_000 + "(" * 50_000,), ("a@b.org" + " (c, d)" * 10_000,)], "v string")
    rows = df.select(group_members("v").alias("g"), parse_addresses("v").alias("a")).collect()
    assert rows[0].g == ["A@X.ORG", "B <B@Y.ORG>"] and [x.address for x in rows[2].a] == ["a@b.org"]


def test_scripts_and_urls(spark):
    cases = {
        "漢字テスト": ["漢", "字", "テスト"], "ひらがな": ["ひ", "ら", "が", "な"], "カタカナー x": ["カタカナー", "X"], "ABC漢DEFテ1": ["ABC", "漢", "DEF", "テ", "1"],
        "3月 か\u3099": ["3", "月", "か\u3099"], "한국어 text": ["한국어", "TEXT"], "ไทย": ["ไทย"],
        "(see http://x.org/a).": ["SEE", "HTTP://X.ORG/A"], "http://x.org/?q=1&b=2, then": ["HTTP://X.ORG/?Q=1&B=2", "THEN"], "https://x.org/a/": ["HTTPS://X.ORG/A/"],
        "http://x.org/漢": ["HTTP://X.ORG/", "漢"], "http://...": ["HTTP"], "mail a.b@c.org!": ["MAIL", "A.B@C.ORG"],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.k for r in df.select("t", tokenize("t").alias("k")).collect()} == cases
    assert {t: tokenize_py(t) for t in cases} == cases
    import duckdb
    from mailsift.functions.text import duckdb_token_sql
    con = duckdb.connect()
    for t, want in cases.items():
        assert con.execute(f"SELECT {duckdb_token_sql('x')} FROM (SELECT ? AS x)", [t]).fetchone()[0] == want, t
