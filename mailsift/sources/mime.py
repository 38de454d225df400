"""Raw mail parsing (S1, F13, F14, F16) as a Spark job.

MIME (multipart walk, base64 / quoted-printable decoding, charsets) has no built-in Spark
expression, so this is the one place Python runs beside the data: `mapInArrow` hands each task
Arrow batches of raw messages and Python's standard `email` parser decodes them. Spark still
partitions the work (a task per file split) and nothing passes through the driver.

Plain (non-MIME) mail can use the JVM-side `functions.headers.split_raw` + `header_lines`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARSED_SCHEMA = ("mailbox_id string, uid bigint, "
                 "headers array<struct<name:string,value:string>>, body string, n_text_parts int")

# Media types whose parts are indexed, and the fallback charset.
TEXT_MEDIA_TYPES = ("text", "message")
DEFAULT_CHARSET = "us-ascii"


def _decode_part(part) -> str | None:
    """F13 + F14: decoded text of one leaf part, or None when it is not text/message."""
    if part.get_content_maintype() not in TEXT_MEDIA_TYPES:
        return None
    payload = part.get_payload(decode=True)
    if payload is None:
        return None
    charset = part.get_content_charset() or DEFAULT_CHARSET
    try:
        return payload.decode(charset, errors="replace")
    except LookupError:                       # unknown charset name -> US-ASCII
        return payload.decode(DEFAULT_CHARSET, errors="replace")


def _parse_one(raw) -> tuple[list, str, int]:
    import email
    import email.policy
    import re

    if raw is None:
        return [], "", 0
    data = raw if isinstance(raw, (bytes, bytearray)) else str(raw).encode("utf-8", "surrogateescape")
    msg = email.message_from_bytes(bytes(data), policy=email.policy.compat32)
    headers = [{"name": k, "value": re.sub(r"\r?\n([ \t])", r"\1", str(v)).strip()} for k, v in msg.items()]
    texts = []
    for part in msg.walk():
        if part.is_multipart():
            continue
        t = _decode_part(part)
        if t is not None:
            texts.append(t)
    return headers, "\n".join(texts), len(texts)


def _parse_batches(batches):
    import pyarrow as pa

    out_type = pa.struct([("name", pa.string()), ("value", pa.string())])
    for batch in batches:
        cols = batch.to_pydict()
        parsed = [_parse_one(r) for r in cols["raw"]]
        yield pa.RecordBatch.from_arrays([
            pa.array(cols["mailbox_id"], pa.string()),
            pa.array(cols["uid"], pa.int64()),
            pa.array([p[0] for p in parsed], pa.list_(out_type)),
            pa.array([p[1] for p in parsed], pa.string()),
            pa.array([p[2] for p in parsed], pa.int32()),
        ], names=["mailbox_id", "uid", "headers", "body", "n_text_parts"])


def parse_mime(raw_df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """F16: (mailbox_id, uid, raw STRING|BINARY) -> (mailbox_id, uid, headers, body, n_text_parts).

    Only text/* and message/* parts reach the body (F13); a missing or unknown charset decodes
    as US-ASCII with replacement characters (F14). No length limit.
    """
    return raw_df.select("mailbox_id", F.col("uid").cast("bigint").alias("uid"),
                         F.col(raw_col).alias("raw")).mapInArrow(_parse_batches, PARSED_SCHEMA)


def read_eml(spark: SparkSession, path: str, mailbox_id: str | None = None) -> DataFrame:
    """``.eml`` files as raw messages via the binaryFile source.

    mailbox_id defaults to the parent folder name, uid to the file name when it is numeric
    (``<uid>.eml``), else NULL.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml") \
        .option("recursiveFileLookup", "true").load(path)
    return eml_columns(files, mailbox_id)


def eml_columns(files: DataFrame, mailbox_id: str | None = None) -> DataFrame:
    """binaryFile rows (batch or stream) -> (mailbox_id, uid, raw)."""
    name = F.regexp_extract("path", r"([^/]+)\.eml$", 1)
    mbox = F.lit(mailbox_id) if mailbox_id else F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return files.select(mbox.alias("mailbox_id"), name.try_cast("bigint").alias("uid"),
                        F.col("content").alias("raw"))
