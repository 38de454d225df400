"""Registered queries: the scalar and array functions (F1-F24) over the adapter views."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.functions import headers as H
from mailsift.functions.dates import date_truncate, date_upper_bound
from mailsift.functions.flags import booleans_to_flags, flag_name_col, flags_to_string
from mailsift.functions.text import octets, tokenize, upper_en
from mailsift.plans import oracle as O
from mailsift.plans.registry import conv_index, conv_to_index, orders_index, register
from mailsift.sources.adapters import mail_conv, mail_docs, read_table
from mailsift.sources.mime import parse_mime

P_COLS = ["mailbox_id", "field", "term", "uid"]
CRLF_SQL = "chr(13) || chr(10)"


@register("F1_tokenize", f"""
SELECT source AS mailbox_id, doc_id AS uid, CAST(len({O.tok('text')}) AS BIGINT) AS n_tokens FROM documents""")
def f1(spark, sf):
    """number of tokens (repeats included) of each document."""
    d = mail_docs(spark, sf, with_flags=False)
    return d.select("mailbox_id", "uid", F.size(tokenize("body")).cast("bigint").alias("n_tokens"))


@register("F2_upper_en", """
SELECT CAST(conv_id AS VARCHAR) AS mailbox_id, turn AS uid, md5(replace(upper(text), 'ẞ', 'SS')) AS upper_md5
FROM conversations""")
def f2(spark, sf):
    """English upper case of each message text (digest)."""
    m = mail_conv(spark, sf)
    return m.select("mailbox_id", "uid", F.md5(upper_en("body")).alias("upper_md5"))


@register("F3_header_lines", O.with_(O.CONV_H) + """
SELECT mailbox_id, uid, CAST(0 AS BIGINT) AS pos, 'From' AS name, h_from AS value FROM conv_h
UNION ALL SELECT mailbox_id, uid, 1, 'Subject', h_subject FROM conv_h
UNION ALL SELECT mailbox_id, uid, 2, 'Cc', h_cc FROM conv_h WHERE h_cc IS NOT NULL""")
def f3(spark, sf):
    """header block of the rendered raw mail -> (name, value) lines in order."""
    raw = mail_conv(spark, sf).select("mailbox_id", "uid", H.render_raw("headers", "body").alias("raw"))
    head, _ = H.split_raw("raw")
    return raw.select("mailbox_id", "uid", F.posexplode(H.header_lines(head)).alias("pos", "h")) \
        .select("mailbox_id", "uid", F.col("pos").cast("bigint").alias("pos"),
                F.col("h.name").alias("name"), F.col("h.value").alias("value"))


@register("F4_unfold", O.with_(O.CONV_H) + "SELECT mailbox_id, uid, h_subject AS subject FROM conv_h")
def f4(spark, sf):
    """a Subject folded over two lines is read back as one line."""
    conv = mail_conv(spark, sf)
    folded = F.concat(F.lit("Subject: Re:\r\n Conversation "), F.col("mailbox_id"),
                      F.lit("\r\nFrom: "), H.first_header_value("headers", "From"))
    lines = H.header_lines(folded)
    return conv.select("mailbox_id", "uid", F.get(lines, 0)["value"].alias("subject"))


def _field_postings(fields):
    def q(spark, sf):
        p, _ = conv_index(spark, sf)
        return p.where(F.col("field").isin(*fields)).select(*P_COLS)
    q.__doc__ = f"Postings of field(s) {', '.join(fields)} built from the conversations."
    return q


for _name, _fields in [("F5_index_full_header", ["HEADERS"]), ("F6_index_any_header", ["PREFIX_HEADER"]),
                       ("F7_index_named_header", ["FROM", "CC", "BASE_SUBJECT"]), ("F15_index_body", ["BODY"])]:
    _in = ", ".join(f"'{f}'" for f in _fields)
    register(_name, O.with_(O.CONV_POSTINGS) +
             f"SELECT mailbox_id, field, term, uid FROM conv_postings WHERE field IN ({_in})")(_field_postings(_fields))


@register("F8_parse_addresses", O.with_(O.CONV_H) + """
SELECT mailbox_id, uid, CAST(0 AS BIGINT) AS pos, 'desk' AS display, 'desk@example.org' AS address FROM conv_h WHERE h_cc IS NOT NULL
UNION ALL
SELECT mailbox_id, uid, 1, 'audit', 'audit@example.org' FROM conv_h WHERE h_cc IS NOT NULL
UNION ALL SELECT mailbox_id, uid, 2, '', role || '@example.net' FROM conv_h WHERE h_cc IS NOT NULL
UNION ALL SELECT mailbox_id, uid, 3, 'Doe, (J)', 'doe' || mailbox_id || '@example.net' FROM conv_h WHERE h_cc IS NOT NULL""")
def f8(spark, sf):
    """F8: Cc address list, with comments and quotes that hold commas, -> (display, address) entries."""
    conv = mail_conv(spark, sf)
    role = F.regexp_extract(H.first_header_value("headers", "From"), "^([^ ]*)", 1)
    value = F.concat(H.first_header_value("headers", "Cc"), F.lit(", "), role, F.lit('@example.net (the, one (of "many: a; b)), "Doe, (J)" (x) <doe'),
                     F.col("mailbox_id"), F.lit("@example.net>"))
    addrs = H.parse_addresses(value)
    return conv.select("mailbox_id", "uid", F.posexplode(addrs).alias("pos", "a")) \
        .select("mailbox_id", "uid", F.col("pos").cast("bigint").alias("pos"),
                F.col("a.display").alias("display"), F.col("a.address").alias("address"))


def _group_value():
    return F.concat(F.lit("team"), F.col("mailbox_id"), F.lit(": "), H.first_header_value("headers", "From"),
                    F.lit(", desk@example.org;"))


@register("F9_group_members", O.with_(O.CONV_H) + """
SELECT mailbox_id, uid, upper(h_from) AS member FROM conv_h
UNION ALL SELECT mailbox_id, uid, 'DESK@EXAMPLE.ORG' FROM conv_h""")
def f9(spark, sf):
    """members of a group address (``teamN: role <...>, desk@...;``), one term each."""
    conv = mail_conv(spark, sf)
    return conv.select("mailbox_id", "uid", F.explode(H.group_members(_group_value())).alias("member"))


@register("F10_first_address", O.with_(O.CONV_H) + """
SELECT mailbox_id, uid, role AS first_from, CASE WHEN h_cc IS NOT NULL THEN 'desk' END AS first_cc,
       CASE WHEN uid % 3 <> 2 THEN 'team' || CAST(conv_id % 7 AS VARCHAR) END AS first_to FROM conv_h""")
def f10(spark, sf):
    """local part of the first From / Cc / To address."""
    _, s = conv_to_index(spark, sf)
    return s.select("mailbox_id", "uid", "first_from", "first_cc", "first_to")


@register("F11_first_display", O.with_(O.CONV_H) + """
SELECT mailbox_id, uid, role AS display_from,
       CASE WHEN uid % 3 <> 2 THEN 'Team ' || CAST(conv_id % 7 AS VARCHAR) END AS display_to FROM conv_h""")
def f11(spark, sf):
    """display name of the first From / To address."""
    _, s = conv_to_index(spark, sf)
    return s.select("mailbox_id", "uid", "display_from", "display_to")


@register("F12_base_subject", O.with_(O.CONV_H) + """
SELECT mailbox_id, uid, 'CONVERSATION ' || CAST(conv_id AS VARCHAR) AS base_subject,
       'CONVERSATION ' || CAST(conv_id AS VARCHAR) AS base_marked FROM conv_h""")
def f12(spark, sf):
    """base subject of the Subject header and of a heavily marked variant."""
    conv = mail_conv(spark, sf)
    subj = H.first_header_value("headers", "Subject")
    marked = F.concat(F.lit("Fwd: RE: ["), H.first_address("headers", "From"), F.lit("] "),
                      F.regexp_replace(subj, "^Re: ", ""), F.lit(" (fwd)"))
    return conv.select("mailbox_id", "uid", H.base_subject(subj).alias("base_subject"),
                       H.base_subject(marked).alias("base_marked"))


def _mime_raw():
    """A multipart/mixed mail per message: the text as base64 UTF-8, a part with an unknown
    charset, and a binary attachment that must not be indexed."""
    b = F.concat(F.lit("b-"), F.col("mailbox_id"), F.lit("-"), F.col("uid").cast("string"))
    role = H.first_address("headers", "From")
    crlf = F.lit("\r\n")
    return F.concat(
        F.lit("From: "), H.first_header_value("headers", "From"), crlf,
        F.lit("Subject: "), H.first_header_value("headers", "Subject"), crlf,
        F.lit("MIME-Version: 1.0"), crlf,
        F.lit('Content-Type: multipart/mixed; boundary="'), b, F.lit('"'), crlf, crlf,
        F.lit("--"), b, crlf, F.lit("Content-Type: text/plain; charset=utf-8"), crlf,
        F.lit("Content-Transfer-Encoding: base64"), crlf, crlf,
        F.base64(F.encode(F.coalesce(F.col("body"), F.lit("")), "UTF-8")), crlf,
        F.lit("--"), b, crlf, F.lit("Content-Type: text/plain; charset=x-no-such-charset"), crlf, crlf,
        F.lit("role "), role, crlf,
        F.lit("--"), b, crlf, F.lit("Content-Type: application/octet-stream"), crlf,
        F.lit("Content-Transfer-Encoding: base64"), crlf, crlf,
        F.base64(F.encode(F.concat(F.lit("attachment "), b), "UTF-8")), crlf,
        F.lit("--"), b, F.lit("--"), crlf)


MIME_SQL = O.with_(O.CONV_H) + """
SELECT mailbox_id, uid, md5(coalesce(text, '') || chr(10) || 'role ' || role) AS body_md5,
       CAST(2 AS BIGINT) AS n_text_parts, 'From=' || h_from || '|Subject=' || h_subject AS top_headers
FROM conv_h"""


def _mime(spark, sf):
    """Multipart mail parsed by mapInArrow: text parts only, unknown charset -> US-ASCII."""
    conv = mail_conv(spark, sf)
    parsed = parse_mime(conv.select("mailbox_id", "uid", _mime_raw().alias("raw")))
    top = F.filter("headers", lambda h: h["name"].isin("From", "Subject"))
    return parsed.select("mailbox_id", "uid", F.md5("body").alias("body_md5"),
                         F.col("n_text_parts").cast("bigint").alias("n_text_parts"),
                         F.array_join(F.transform(top, lambda h: F.concat(h["name"], F.lit("="), h["value"])), "|")
                         .alias("top_headers"))


for _name in ("F13_text_parts", "F14_charset_decode", "F16_parse_mime"):
    register(_name, MIME_SQL)(_mime)


@register("F17_message_date_uid", O.with_(O.ORD_STATE) + "SELECT mailbox_id, uid, internal_date FROM ord_state")
def f17(spark, sf):
    """internal date and uid as plain state columns (orders)."""
    _, s = orders_index(spark, sf)
    return s.select("mailbox_id", "uid", "internal_date")


UNITS = ("year", "month", "day", "hour", "minute", "second", "millisecond")
#: Orders with a time of day: hours, minutes, seconds and microseconds from the key.
TIMED = "internal_date + to_microseconds(uid * 977001 % 86400000000)"


def timed_orders(spark, sf):
    _, s = orders_index(spark, sf)
    return s.withColumn("internal_date", F.timestamp_micros(F.unix_micros(F.col("internal_date").cast("timestamp")) + F.col("uid") * 977001 % 86400000000)
                        .cast("timestamp_ntz"))


@register("F18_date_truncate", O.with_(O.ORD_STATE) + "SELECT mailbox_id, uid, "
          + ", ".join(f"CAST(date_trunc('{u}', {TIMED}) AS TIMESTAMP) AS {u}_start" for u in UNITS) + " FROM ord_state")
def f18(spark, sf):
    """internal date cut to each of the seven units (UTC)."""
    return timed_orders(spark, sf).select("mailbox_id", "uid", *[date_truncate("internal_date", u).alias(f"{u}_start") for u in UNITS])


@register("F19_date_upper_bound", O.with_(O.ORD_STATE) + "SELECT mailbox_id, uid, "
          + ", ".join(f"CAST(date_trunc('{u}', {TIMED}) + INTERVAL {0 if u == 'millisecond' else 1} {u} AS TIMESTAMP) AS {u}_end" for u in UNITS) + " FROM ord_state")
def f19(spark, sf):
    """end of each of the seven units of the internal date; a millisecond ends where it begins."""
    return timed_orders(spark, sf).select("mailbox_id", "uid", *[date_upper_bound("internal_date", u).alias(f"{u}_end") for u in UNITS])


@register("F20_flags_to_string", r"""
SELECT CAST(o_custkey AS VARCHAR) AS mailbox_id, o_orderkey AS uid,
       concat_ws('', CASE WHEN o_orderstatus = 'O' THEN '\FLAGGED' END,
                     CASE WHEN o_orderstatus = 'F' THEN '\SEEN' END,
                     upper(split_part(o_orderpriority, '-', 2))) AS flags_joined
FROM orders""")
def f20(spark, sf):
    """flags joined without separator (orders: status flag + priority user flag)."""
    _, s = orders_index(spark, sf)
    return s.select("mailbox_id", "uid", flags_to_string("flags").alias("flags_joined"))


@register("F21_flag_name", r"""
SELECT doc_id, CASE WHEN toxic = 1 THEN '\DELETED' WHEN quality = 1 THEN '\FLAGGED' ELSE 'CUSTOM-OK' END AS flag
FROM labels""")
def f21(spark, sf):
    """flag names (lower-case system names become ``\\NAME``; others are user flags)."""
    lab = read_table(spark, sf, "labels")
    name = F.when(F.col("toxic") == 1, F.lit("deleted")).when(F.col("quality") == 1, F.lit("\\Flagged")) \
        .otherwise(F.lit("custom-ok"))
    return lab.select("doc_id", flag_name_col(name).alias("flag"))


@register("F22_booleans_to_flags", r"""
SELECT doc_id, concat_ws(' ', CASE WHEN toxic = 1 THEN '\DELETED' END, CASE WHEN quality = 1 THEN '\FLAGGED' END,
                         CASE WHEN quality = 0 THEN '\SEEN' END) AS flags
FROM labels""")
def f22(spark, sf):
    """booleans (toxic, quality) -> flag list in system order."""
    lab = read_table(spark, sf, "labels")
    fl = booleans_to_flags(deleted=F.col("toxic") == 1, flagged=F.col("quality") == 1, seen=F.col("quality") == 0)
    return lab.select("doc_id", F.array_join(fl, " ").alias("flags"))


@register("F23_octets", """
SELECT CAST(conv_id AS VARCHAR) AS mailbox_id, turn AS uid, CAST(strlen(text) AS BIGINT) AS octets FROM conversations""")
def f23(spark, sf):
    """octets of each message text (UTF-8 bytes)."""
    m = mail_conv(spark, sf)
    return m.select("mailbox_id", "uid", octets("body").cast("bigint").alias("octets"))


@register("F24_render_raw", O.with_(O.CONV_H) + f"""
SELECT mailbox_id, uid, md5('From: ' || h_from || {CRLF_SQL} || 'Subject: ' || h_subject
    || coalesce({CRLF_SQL} || 'Cc: ' || h_cc, '') || {CRLF_SQL} || {CRLF_SQL} || coalesce(text, '')) AS raw_md5
FROM conv_h""")
def f24(spark, sf):
    """digest of each message rendered as raw mail."""
    m = mail_conv(spark, sf)
    return m.select("mailbox_id", "uid", F.md5(H.render_raw("headers", "body")).alias("raw_md5"))


@register("F1b_tokenize_urls", f"""
SELECT DISTINCT 'pages' AS mailbox_id, page_id AS uid, term FROM (
  SELECT page_id, unnest({O.tok('url')}) AS term FROM pages)""")
def f1b(spark, sf):
    """F1 on web addresses: each page URL (pages.url) tokenized; http(s) URLs stay one token."""
    pages = read_table(spark, sf, "pages")
    return pages.select(F.lit("pages").alias("mailbox_id"), F.col("page_id").alias("uid"),
                        F.explode(F.array_distinct(tokenize("url"))).alias("term"))


@register("C6b_exact_header_name", O.with_(O.CONV_H) + f"""
SELECT mailbox_id, uid FROM conv_h
WHERE len(list_filter({O.tok('h_subject')}, lambda x: contains(x, '1'))) > 0""")
def c6b(spark, sf):
    """Q12 exact_name: messages whose Subject header (by exact name) has a token containing '1'."""
    from mailsift.operators.search import header_contains_exact
    return header_contains_exact(mail_conv(spark, sf), None, "subject", "1")
