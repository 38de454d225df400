"""Registered queries: one per operator of SURVEY §2, each with its DuckDB oracle twin.

Every query reads the driver's tables through the adapter views (so its work grows with
them) and returns scalar columns only (arrays are joined to strings), named the same as in
its SQL twin.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.operators import criteria as C
from mailsift.operators.ingest import build_postings, build_state
from mailsift.operators.search import search
from mailsift.plans import oracle as O
from mailsift.session import ensure_utc
from mailsift.sources.adapters import mail_conv, mail_docs, mail_orders

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_utc(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return deco


# ------------------------------------------------------------------ index helpers

def docs_index(spark, sf):
    """Postings from documents (no labels join: postings need no flags), state with flags."""
    return build_postings(mail_docs(spark, sf, with_flags=False)), build_state(mail_docs(spark, sf))


def conv_index(spark, sf):
    msgs = mail_conv(spark, sf)
    return build_postings(msgs), build_state(msgs)


def conv_to_index(spark: SparkSession, sf_dir: str):
    """The state of the conversations with To headers."""
    return None, build_state(mail_conv(spark, sf_dir, with_to=True))


def orders_index(spark, sf):
    msgs = mail_orders(spark, sf)
    return build_postings(msgs), build_state(msgs)


def flags_str(col="flags"):
    return F.array_join(F.col(col), " ").alias("flags")


def _keys_sql(ctes: list[str], table: str, where: str) -> str:
    return O.with_(*ctes) + f"SELECT DISTINCT mailbox_id, uid FROM {table} WHERE {where}"


# ------------------------------------------------------------------ C: criteria (single search)

@register("C1_body_contains", _keys_sql([O.DOC_POSTINGS], "doc_postings",
                                        "mailbox_id = 'src1' AND field = 'BODY' AND contains(term, 'THE')"))
def c1(spark, sf):
    """Body contains 'the' in mailbox src1."""
    p, s = docs_index(spark, sf)
    return search(p, s, "src1", [C.body_contains("the")])


@register("C2_text_contains", _keys_sql([O.CONV_POSTINGS], "conv_postings",
                                        "field IN ('BODY', 'HEADERS') AND contains(term, 'ASSISTANT')"))
def c2(spark, sf):
    """Full text (body or header lines) contains 'assistant', every mailbox."""
    p, s = conv_index(spark, sf)
    return search(p, s, None, [C.text_contains("assistant")])


@register("C3_header_contains", _keys_sql([O.CONV_POSTINGS], "conv_postings",
                                          "field = 'FROM' AND contains(term, 'ASSISTANT@EXAMPLE')"))
def c3(spark, sf):
    """From header contains the whole value 'assistant@example' inside one term."""
    p, s = conv_index(spark, sf)
    return search(p, s, None, [C.header_contains("From", "assistant@example")])


@register("C4_header_exists", _keys_sql([O.CONV_POSTINGS], "conv_postings", "field = 'CC'"))
def c4(spark, sf):
    """C4: messages that have a Cc header."""
    p, s = conv_index(spark, sf)
    return search(p, s, None, [C.header_exists("Cc")])


@register("C5_address_contains", _keys_sql(
    [O.CONV_POSTINGS], "conv_postings",
    "field = 'CC' AND (contains(term, 'AUDIT') OR contains(term, 'AUDIT@EXAMPLE.ORG'))"))
def c5(spark, sf):
    """Cc address criterion, tokenized: any token matches."""
    p, s = conv_index(spark, sf)
    return search(p, s, None, [C.address_contains("cc", "audit <audit@example.org>")])


@register("C6_header_route", _keys_sql([O.CONV_POSTINGS], "conv_postings",
                                       "field = 'PREFIX_HEADER' AND contains(term, 'SYSTEM')"))
def c6(spark, sf):
    """An unknown header name routes to PREFIX_HEADER (values of every header, Q12)."""
    p, s = conv_index(spark, sf)
    return search(p, s, None, [C.header_contains("X-Role", "system")])


@register("C7_flag_set", _keys_sql([O.DOC_STATE], "doc_state",
                                   r"list_contains(string_split(flags, ' '), '\FLAGGED')"))
def c7(spark, sf):
    """FLAGGED set (case-insensitive flag name)."""
    p, s = docs_index(spark, sf)
    return search(p, s, None, [C.flag_set("flagged")])


@register("C8_flag_unset", _keys_sql([O.DOC_STATE], "doc_state",
                                     r"NOT list_contains(string_split(flags, ' '), '\DELETED')"))
def c8(spark, sf):
    """DELETED not set (Q4 fixed)."""
    p, s = docs_index(spark, sf)
    return search(p, s, None, [C.flag_unset("DELETED")])


@register("C9_custom_flag", _keys_sql([O.ORD_STATE], "ord_state",
                                      "list_contains(string_split(flags, ' '), 'URGENT')"))
def c9(spark, sf):
    """User flag 'urgent' set."""
    p, s = orders_index(spark, sf)
    return search(p, s, None, [C.custom_flag("urgent")])


@register("C10_date_on", _keys_sql([O.ORD_STATE], "ord_state",
                                   "internal_date BETWEEN TIMESTAMP '1997-05-01' AND TIMESTAMP '1997-06-01'"))
def c10(spark, sf):
    """Internal date ON May 1997 (month resolution, closed bounds as the reference)."""
    p, s = orders_index(spark, sf)
    return search(p, s, None, [C.date_on(dt.datetime(1997, 5, 17), "month")])


@register("C11_date_before", _keys_sql([O.ORD_STATE], "ord_state",
                                       "internal_date <= TIMESTAMP '1995-03-15'"))
def c11(spark, sf):
    """C11: internal date BEFORE 1995-03-15 (day resolution)."""
    p, s = orders_index(spark, sf)
    return search(p, s, None, [C.date_before(dt.datetime(1995, 3, 15, 14, 0), "day")])


@register("C12_date_after", _keys_sql([O.ORD_STATE], "ord_state",
                                      "internal_date >= TIMESTAMP '2001-07-01'"))
def c12(spark, sf):
    """Internal date AFTER 2001-06-30 (day resolution)."""
    p, s = orders_index(spark, sf)
    return search(p, s, None, [C.date_after(dt.datetime(2001, 6, 30), "day")])


@register("C13a_uid_eq", _keys_sql([O.ORD_STATE], "ord_state", "uid = 7"))
def c13a(spark, sf):
    """uid = 7 in every mailbox."""
    p, s = orders_index(spark, sf)
    return search(p, s, None, [C.uid_eq(7)])


@register("C13b_uid_ranges", _keys_sql([O.ORD_STATE], "ord_state",
                                       "uid BETWEEN 1 AND 100 OR uid BETWEEN 5000 AND 5100"))
def c13b(spark, sf):
    """Uid in any of two ranges."""
    p, s = orders_index(spark, sf)
    return search(p, s, None, [C.uid_ranges([(1, 100), (5000, 5100)])])


@register("C13c_uid_star", _keys_sql([O.ORD_STATE], "ord_state", "true"))
def c13c(spark, sf):
    """A `*:*` range makes the uid criterion neutral: every message."""
    p, s = orders_index(spark, sf)
    return search(p, s, None, [C.uid_ranges([(1, 10), (C.UID_STAR, C.UID_STAR)])])


@register("C14_term_match", _keys_sql([O.DOC_POSTINGS], "doc_postings",
                                      "field = 'BODY' AND contains(term, 'TION')"))
def c14(spark, sf):
    """C14: term test is a substring test (prefix included): 'tion' anywhere in a term."""
    p, s = docs_index(spark, sf)
    return search(p, s, None, [C.body_contains("tion")])


@register("C15_all", _keys_sql([O.DOC_STATE], "doc_state", "mailbox_id = 'src3'"))
def c15(spark, sf):
    """All messages of mailbox src3."""
    p, s = docs_index(spark, sf)
    return search(p, s, "src3", [C.all_()])


@register("C16_match_any", O.with_(O.DOC_POSTINGS, O.DOC_STATE) + r"""
SELECT mailbox_id, uid FROM doc_postings WHERE field = 'BODY' AND contains(term, 'MAISON')
UNION
SELECT mailbox_id, uid FROM doc_state WHERE list_contains(string_split(flags, ' '), '\DELETED')""")
def c16(spark, sf):
    """Several criteria are ORed (body 'maison' or DELETED)."""
    p, s = docs_index(spark, sf)
    return search(p, s, None, [C.body_contains("maison"), C.flag_set("DELETED")])


@register("C17_bounds_conjunction", _keys_sql(
    [O.ORD_STATE], "ord_state",
    "internal_date >= TIMESTAMP '1996-01-01' AND internal_date <= TIMESTAMP '1997-01-01'"))
def c17(spark, sf):
    """C17: lower AND upper bound of one criterion (ON 1996, year resolution)."""
    p, s = orders_index(spark, sf)
    return search(p, s, None, [C.date_on(dt.datetime(1996, 7, 4), "year")])


# ------------------------------------------------------------------ T1-T6: sizes and boolean trees

@register("T1_size_eq", _keys_sql([O.DOC_STATE], "doc_state", "size = 416"))
def t1(spark, sf):
    """size = 416 (documents, size = n_chars)."""
    p, s = docs_index(spark, sf)
    return search(p, s, None, [C.size_eq(416)])


@register("T2_size_lt", _keys_sql([O.DOC_STATE], "doc_state", "size < 300"))
def t2(spark, sf):
    """Size < 300."""
    p, s = docs_index(spark, sf)
    return search(p, s, None, [C.size_lt(300)])


@register("T3_size_gt", _keys_sql([O.DOC_STATE], "doc_state", "size > 15000"))
def t3(spark, sf):
    """Size > 15000."""
    p, s = docs_index(spark, sf)
    return search(p, s, None, [C.size_gt(15000)])


@register("T4_match_not", O.with_(O.DOC_POSTINGS, O.DOC_STATE) + """
SELECT mailbox_id, uid FROM doc_state
EXCEPT
SELECT mailbox_id, uid FROM doc_postings WHERE field = 'BODY' AND contains(term, 'THE')""")
def t4(spark, sf):
    """T4: NOT body contains 'the'."""
    p, s = docs_index(spark, sf)
    return search(p, s, None, [C.not_(C.body_contains("the"))])


@register("T5_match_all", O.with_(O.DOC_POSTINGS) + """
SELECT mailbox_id, uid FROM doc_postings WHERE field = 'BODY' AND contains(term, 'QUE')
INTERSECT
SELECT mailbox_id, uid FROM doc_postings WHERE field = 'BODY' AND contains(term, 'DER')""")
def t5(spark, sf):
    """T5: AND of two criteria (match='all')."""
    p, s = docs_index(spark, sf)
    return search(p, s, None, [C.body_contains("que"), C.body_contains("der")], match="all")


@register("T6_match_or", O.with_(O.DOC_POSTINGS, O.DOC_STATE) + r"""
SELECT mailbox_id, uid FROM doc_state
WHERE (list_contains(string_split(flags, ' '), '\FLAGGED')
       AND EXISTS (SELECT 1 FROM doc_postings p WHERE p.mailbox_id = doc_state.mailbox_id
                   AND p.uid = doc_state.uid AND p.field = 'BODY' AND contains(p.term, 'UND')))
   OR size < 300""")
def t6(spark, sf):
    """OR of (FLAGGED AND body 'und') and size < 300: a nested tree in one pass."""
    p, s = docs_index(spark, sf)
    return search(p, s, None, [C.or_(C.and_(C.flag_set("FLAGGED"), C.body_contains("und")), C.size_lt(300))])


# the other query modules register themselves on import
from mailsift.plans import queries_index  # noqa: E402,F401
from mailsift.plans import queries_bitmaps  # noqa: E402,F401
from mailsift.plans import queries_functions  # noqa: E402,F401
from mailsift.plans import queries_stream  # noqa: E402,F401
