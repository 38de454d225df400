"""The operators that SQL can express, against DuckDB."""

import os

import duckdb
import pytest

from pyspark.sql import functions as F

from mailsift.llm.op1_secrets import digest, find_secrets, redact
from mailsift.llm.oracle import secrets_sql
from mailsift.llm.queries import ORACLE, QUERIES
from tests.llm.conftest import SF001


@pytest.mark.parametrize("name", sorted(ORACLE))
@pytest.mark.parametrize("where", ["odd", "sf"])
def test_query_matches_oracle(spark, odd, where, name):
    folder = odd if where == "odd" else SF001
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(folder, t)}.parquet'")
    df = QUERIES[name](spark, folder)
    got = sorted(map(repr, (tuple(r) for r in df.collect())))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE[name]})").fetchall()
    assert got == sorted(map(repr, want))


def test_weak_parts_need_company(spark, odd):
    spans = {(r.doc_id, r.spans) for r in QUERIES["op1_secrets"](spark, odd).collect()}
    assert (9, "") in spans  # a weak secret alone
    with_company = next(s for i, s in spans if i == 8)
    assert [x.split(":")[0] for x in with_company.split(",")] == ["user", "url", "pass", "assign", "access", "hex"]
    # a match whose value is short still uses up its text
    assert (10, "") in spans


WEAK = [
    ("user=deploy host=https://db.example.org pwd=P@ssw0rd!", ["P@ssw0rd!", "deploy", "db.example.org"]),
    ('user: "deploy" pwd: "p&s;s#w$rd" host=db.example.org', ["p&s;s#w$rd", "deploy", "db.example.org"]),
    ("see https://deploy:hunter22@host/x for it", ["hunter22", "deploy"]),
    ("postgres://app:s3cr%t!@db/x", ["s3cr%t!"]), ("mongodb+srv://app:hunter22@cluster0.net/x", ["hunter22"]), ("redis://:hunter22@cache:6379/0 user=app", ["hunter22"]),
    ("user=müller pwd=ß?öä9x", ["müller", "ß?öä9x"]),
]


def test_weak_parts_are_whole(spark):
    rows = [(k, text) for k, (text, _) in enumerate(WEAK)] + [(99, "see https://host:8080/x and mail a@b.org")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in redact(docs).collect()}
    for k, (_, gone) in enumerate(WEAK):
        assert not [x for x in gone if x in clean[k]], clean[k]
    assert clean[99] == rows[-1][1]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = {r.doc_id: r.d for r in find_secrets(docs, ["doc_id"]).select("doc_id", digest(F.col("_s_spans")).alias("d")).collect()}
    assert got == dict(con.execute(f"SELECT doc_id, spans FROM ({secrets_sql()})").fetchall())
