"""Registered queries: Structured Streaming operators.

Each query stages its input from the driver's tables as several Parquet files in the scratch
folder, runs the stream to completion (`availableNow`), and returns the sink as a DataFrame.
The results equal the batch operators, so the oracle twins are the batch SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.operators import criteria as C
from mailsift.operators.maintain import live_flags
from mailsift.plans import oracle as O
from mailsift.plans.registry import flags_str, register
from mailsift.schema import CHANGES, MESSAGES
from mailsift.session import new_scratch_path
from mailsift.sources.adapters import mail_changes, mail_conv, read_table
from mailsift.streaming.stream import read_state, stage_files, stream_changes, stream_dedup, stream_dedup_sessions, stream_index, stream_state


@register("R1_stream_index", O.with_(O.CONV_POSTINGS) + "SELECT mailbox_id, field, term, uid FROM conv_postings")
def r1(spark, sf):
    """Messages arrive as files; postings are appended per micro-batch."""
    src = stage_files(mail_conv(spark, sf).select(*MESSAGES.fieldNames()), new_scratch_path(spark, "in-msgs"))
    sink = stream_index(spark, src, MESSAGES, new_scratch_path(spark, "out-postings"))
    return spark.read.parquet(sink).select("mailbox_id", "field", "term", "uid")


@register("R1b_stream_changes", O.with_(O.CHANGES) + f"""
, live AS (SELECT mailbox_id, uid, last_add, flags FROM fold WHERE {O.LIVE})
SELECT l.mailbox_id, l.uid FROM live l JOIN events e ON e.event_id = l.last_add
WHERE l.flags = '\\SEEN' AND contains(upper(e.props), 'K')""")
def r1b(spark, sf):
    """R1 + R2: adds, flag updates and deletes stream into one index, which is then searched for
    a body term and a flag."""
    ev = read_table(spark, sf, "events").select(F.col("event_id").alias("seq"), "props")
    body = F.when(F.col("op") == "add", F.col("props"))
    changes = mail_changes(spark, sf).drop("body").join(ev, "seq").withColumn("body", body)
    src = stage_files(changes.select(*CHANGES.fieldNames()), new_scratch_path(spark, "in-log"))
    ix = stream_changes(spark, src, CHANGES, new_scratch_path(spark, "log-index")).index()
    return ix.search(None, [C.body_contains("k"), C.flag_set("SEEN")], match="all")


@register("R2_stream_state", O.with_(O.CHANGES) + f"SELECT mailbox_id, uid, flags FROM fold WHERE {O.LIVE}")
def r2(spark, sf):
    """R2: the change log arrives in micro-batches; versioned state equals the batch fold."""
    src = stage_files(mail_changes(spark, sf).select(*CHANGES.fieldNames()), new_scratch_path(spark, "in-chg"))
    root = stream_state(spark, src, CHANGES, new_scratch_path(spark, "state"))
    return live_flags(read_state(spark, root)).select("mailbox_id", "uid", flags_str())


@register("R3_stream_dedup", O.with_(O.CHANGES) + "SELECT DISTINCT mailbox_id, uid FROM chg WHERE op = 'add'")
def r3(spark, sf):
    """Repeated adds of one key (in different micro-batches) are kept once."""
    adds = mail_changes(spark, sf).where(F.col("op") == "add").select(*CHANGES.fieldNames())
    src = stage_files(adds, new_scratch_path(spark, "in-adds"))
    sink = stream_dedup(spark, src, CHANGES, new_scratch_path(spark, "out-adds"))
    return spark.read.parquet(sink).select("mailbox_id", "uid")


@register("R3b_stream_dedup_sessions", O.with_(O.CHANGES) + """
, adds AS (SELECT *, lag(ts) OVER (PARTITION BY mailbox_id, uid ORDER BY ts, seq) AS prev
           FROM chg WHERE op = 'add' AND ts IS NOT NULL),
runs AS (SELECT *, count(*) FILTER (WHERE prev IS NULL OR ts > prev + INTERVAL 168 HOUR)
                   OVER (PARTITION BY mailbox_id, uid ORDER BY ts, seq) AS k FROM adds),
mark AS (SELECT make_timestamp(epoch_ms(max(ts)) * 1000) - INTERVAL 24 HOUR AS w FROM adds)
SELECT mailbox_id, uid, arg_min(seq, (ts, seq)) AS seq, count(*) AS n_adds
FROM runs GROUP BY mailbox_id, uid, k HAVING max(ts) + INTERVAL 168 HOUR <= (SELECT w FROM mark)""")
def r3b(spark, sf):
    """R3 with bounded state: adds of a key less than a week apart are one; the weeks that the
    watermark has closed at the end of the log."""
    src = stage_files(mail_changes(spark, sf).select(*CHANGES.fieldNames()), new_scratch_path(spark, "in-log"))
    sink = stream_dedup_sessions(spark, src, CHANGES, new_scratch_path(spark, "out-sessions"), "ts", "168 hours", "24 hours")
    return spark.read.schema("mailbox_id string, uid bigint, seq bigint, n_adds bigint").parquet(sink)
