"""Regex and short terms on the dictionary = the full scan."""

import random

from pyspark.sql import functions as F

from mailsift.operators import batch as B
from mailsift.operators import criteria as C
from mailsift.operators import patterns as P
from mailsift.operators.ingest import load_index, rebuild_index
from mailsift.session import new_scratch_path
from mailsift.sources.adapters import mail_conv
from tests.conftest import SF001


def test_required_grams():
    cases = {
        "(?i)abcd": ("and", "ABC", "BCD"), "ab": None, "abc|xyz": ("or", "ABC", "XYZ"), "abc|x": None, "abc.*xyz": ("and", "ABC", "XYZ"),
        "(abc)+d": "ABC", "(abc)*d": None, "a(bcd|efg)h": ("or", "BCD", "EFG"), "[abc]def": "DEF", r"abc\d{2}xyz?": "ABC", "(?:abc|(?:def|ghi)jkl)": ("or", "ABC", ("and", ("or", "DEF", "GHI"), "JKL")),
        "(?x) abc": None, r"\Qabc\E": None, "abc(?!def)": "ABC", r"\.com": ("and", ".CO", "COM"), r"x\.com": ("and", "X.C", ".CO", "COM"), "étab": ("and", "éTA", "TAB"), "(": None,
    }
    assert {p: P.required_grams(p) for p in cases} == cases


def test_random_patterns_equal_the_full_scan(spark):
    ix = load_index(spark, rebuild_index(mail_conv(spark, SF001), new_scratch_path(spark, "ix")))
    terms = [r.term for r in ix.dictionary.where("field = 'BODY'").select("term").collect()]
    dictionary, grams = ix.dictionary.cache(), ix.grams.cache()
    dice = random.Random(1)

    def some(depth):
        t = dice.choice(terms).lower()
        a = dice.randrange(len(t))
        plain = t[a:a + dice.randint(1, 6)].replace(".", r"\.").replace("'", ".")
        if depth == 0:
            return plain
        return dice.choice([lambda: plain + dice.choice([".*", ".", "[a-e]", r"\w?", "x*"]) + some(depth - 1), lambda: f"(?:{some(depth - 1)}|{some(depth - 1)})",
                            lambda: f"({some(depth - 1)}){dice.choice(['+', '*', '?', '{1,2}'])}", lambda: "^" + some(depth - 1), lambda: some(depth - 1) + "$"])()

    narrowed = 0
    for k in range(40):
        pattern = "(?i)" + some(k % 3)
        got = sorted(r.term for r in P.matching_terms(dictionary, grams, "BODY", pattern).collect())
        want = sorted(r.term for r in dictionary.where((F.col("field") == "BODY") & F.col("term").rlike(pattern)).collect())
        assert got == want, pattern
        narrowed += P.required_grams(pattern) is not None
    assert narrowed > 5
    tested = P.candidate_terms(dictionary, grams, "BODY", "(?i)ation").count()
    assert 0 < tested < len(terms) / 10
    for leaf in (C.body_contains("at.on", regex=True), C.body_contains("ing$", regex=True)):
        plain = {tuple(r) for r in ix.search(None, [leaf]).collect()}
        assert plain and {tuple(r) for r in ix.search(None, [leaf], use_dictionary=True).collect()} == plain


def test_short_terms_by_equi_join(spark):
    ix = load_index(spark, rebuild_index(mail_conv(spark, SF001), new_scratch_path(spark, "ix")))
    asked = [("BODY", q) for q in ("A", "E", "TH", "ZZ", "", "ING", ".")] + [("FROM", q) for q in ("A", "@", "RG", "")] + [("CC", "")]
    qterms = spark.createDataFrame(asked, "field string, qterm string")
    hits = B.match_terms(ix.dictionary, qterms, ix.grams, ix.gram_stats)
    assert "NestedLoop" not in hits._jdf.queryExecution().executedPlan().toString()
    want = sorted((r.field, r.term, q) for r in ix.dictionary.collect() for f, q in asked if f == r.field and q in r.term)
    assert sorted(map(tuple, hits.select("field", "term", "qterm").collect())) == want
