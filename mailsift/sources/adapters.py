"""Adapter views: the driver's tables read as mail.

The test data has no mail, so these views map its tables onto the `messages` / `changes`
schemas. Each view is a projection (plus one join for `mail_docs` flags), so Parquet column
pruning and filter pushdown reach the scans.

| view          | from                       | mailbox_id  | uid        |
| mail_docs     | documents (+ labels)       | source      | doc_id     |
| mail_conv     | conversations              | conv_id     | turn       |
| mail_orders   | orders                     | o_custkey   | o_orderkey |
| mail_changes  | events                     | user_id     | props.$.k  |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.functions.flags import booleans_to_flags
from mailsift.session import table_path

EMPTY_HEADERS = "array<struct<name:string,value:string>>"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def _hdr(name: str, value) -> F.Column:
    return F.struct(F.lit(name).alias("name"), value.alias("value"))


def mail_docs(spark: SparkSession, sf_dir: str, with_flags: bool = True) -> DataFrame:
    """documents as messages: mailbox = source, uid = doc_id, body = text, size = n_chars.

    Flags come from labels (quality=1 -> FLAGGED, toxic=1 -> DELETED). With
    ``with_flags=False`` the labels join is left out: postings never need flags, and the
    join would otherwise shuffle the document text.
    """
    docs = read_table(spark, sf_dir, "documents")
    if with_flags:
        labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
        docs = docs.join(labels, "doc_id", "left")
        flags = booleans_to_flags(deleted=F.col("toxic") == 1, flagged=F.col("quality") == 1)
    else:
        flags = F.array().cast("array<string>")
    return docs.select(
        F.col("source").alias("mailbox_id"),
        F.col("doc_id").alias("uid"),
        F.lit(None).cast("timestamp_ntz").alias("internal_date"),
        F.col("n_chars").cast("bigint").alias("size"),
        flags.alias("flags"),
        F.array().cast(EMPTY_HEADERS).alias("headers"),
        F.col("text").alias("body"),
    )


def mail_conv(spark: SparkSession, sf_dir: str, with_to: bool = False) -> DataFrame:
    """conversations as messages: mailbox = conv_id, uid = turn, body = text.

    Headers: From ``role <role@example.org>``, Subject ``Re: Conversation <conv_id>``, and on
    odd turns Cc ``desk <desk@example.org>, audit <audit@example.org>``; with ``with_to`` also To
    ``Team k <teamk@example.org>, audit@example.org``, k = conv_id mod 7, on two turns of three.
    """
    conv = read_table(spark, sf_dir, "conversations")
    base = F.array(
        _hdr("From", F.concat(F.col("role"), F.lit(" <"), F.col("role"), F.lit("@example.org>"))),
        _hdr("Subject", F.concat(F.lit("Re: Conversation "), F.col("conv_id").cast("string"))),
    )
    cc = F.array(_hdr("Cc", F.lit("desk <desk@example.org>, audit <audit@example.org>")))
    headers = F.when(F.col("turn") % 2 == 1, F.concat(base, cc)).otherwise(base)
    if with_to:
        team = (F.col("conv_id") % 7).cast("string")
        to = F.array(_hdr("To", F.concat(F.lit("Team "), team, F.lit(" <team"), team, F.lit("@example.org>, audit@example.org"))))
        headers = F.when(F.col("turn") % 3 != 2, F.concat(headers, to)).otherwise(headers)
    return conv.select(
        F.col("conv_id").cast("string").alias("mailbox_id"),
        F.col("turn").alias("uid"),
        F.lit(None).cast("timestamp_ntz").alias("internal_date"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.array().cast("array<string>").alias("flags"),
        headers.alias("headers"),
        F.col("text").alias("body"),
    )


def mail_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as messages: mailbox = o_custkey, uid = o_orderkey, date = o_orderdate.

    Status F -> SEEN, O -> FLAGGED, P -> none, plus the priority name (the text after its
    ``N-`` prefix, e.g. ``URGENT``) as a user flag; Subject = o_orderpriority; no body.
    """
    o = read_table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    user_flag = F.array(F.upper(F.substring_index(F.col("o_orderpriority"), "-", -1)))
    return o.select(
        F.col("o_custkey").cast("string").alias("mailbox_id"),
        F.col("o_orderkey").alias("uid"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("internal_date"),
        F.lit(None).cast("bigint").alias("size"),
        booleans_to_flags(seen=status == "F", flagged=status == "O", user_flags=user_flag).alias("flags"),
        F.array(_hdr("Subject", F.col("o_orderpriority"))).alias("headers"),
        F.lit("").alias("body"),
    )


def mail_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a change log: seq = event_id, mailbox = user_id, uid = props.$.k.

    signup -> add (no flags), error -> delete, click -> flags SEEN, view -> flags ANSWERED,
    purchase -> flags FLAGGED.
    """
    ev = read_table(spark, sf_dir, "events")
    et = F.col("event_type")
    op = F.when(et == "signup", "add").when(et == "error", "delete").otherwise("flags")
    flags = F.when(et == "click", F.array(F.lit("\\SEEN"))) \
        .when(et == "view", F.array(F.lit("\\ANSWERED"))) \
        .when(et == "purchase", F.array(F.lit("\\FLAGGED"))) \
        .otherwise(F.array().cast("array<string>"))
    return ev.select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        op.alias("op"),
        F.col("user_id").cast("string").alias("mailbox_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("uid"),
        flags.alias("flags"),
        F.array().cast(EMPTY_HEADERS).alias("headers"),
        F.lit(None).cast("string").alias("body"),
        F.lit(None).cast("bigint").alias("size"),
    )
